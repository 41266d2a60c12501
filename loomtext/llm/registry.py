"""The queries of this subpackage, one for each operator, and their SQL where it can express them."""

from loomtext.llm import embedding_dedup, katz, language_id, license_scan, mixing, order_minhash, packing, token_output, warc, winnowing

QUERIES = {
    "op1_katz": katz.op1_katz,
    "op2_language_id": language_id.op2_language_id,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_packing": packing.op5_packing,
    "op6_token_output": token_output.op6_token_output,
    "op7_warc": warc.op7_warc,
    "op8_mixing": mixing.op8_mixing,
    "op9_winnowing": winnowing.op9_winnowing,
    "op10_order_minhash": order_minhash.op10_order_minhash,
}

SQL = {
    "op1_katz": katz.SQL,
    "op4_embedding_dedup": embedding_dedup.SQL,
    "op7_warc": warc.SQL,
    "op9_winnowing": winnowing.SQL,
}
