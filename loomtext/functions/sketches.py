"""MinHash, SimHash and TLSH as columns, their comparison, their serial forms, and their metadata.

Unsigned 64-bit numbers are kept as the bit patterns of bigints. A text without tokens has no sketch and the error
``empty document``; a null text has neither. The sketching functions take the text in one trip to Python: canonical form, tokens,
hashes and sketch come out of one pass over each Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.config import SCHEMA, Canonical, MinHash, SimHash, config_hash_of
from loomtext.errors import ConfigError, InvalidInput
from loomtext.functions.text import col, failing, mapped, pieces, settled
from loomtext.kernels import sketch, tlsh
from loomtext.kernels.canon import canonical
from loomtext.kernels.hashing import hash128

SIGNATURE = "struct<schema: smallint, hashes: array<bigint>>"
_SIGNATURE = pa.struct([("schema", pa.int16()), ("hashes", pa.list_(pa.int64()))])


def hash_tokens(token_list: Column | str, family: str, seed: int) -> Column:
    """low and high half of each token's hash."""

    @F.arrow_udf("array<struct<low: bigint, high: bigint>>")
    def run(values: pa.Array) -> pa.Array:
        rows = values.to_pylist()
        lo, hi = hash128([t.encode("utf-8", "surrogatepass") for r in rows if r for t in r], family, seed)
        off = np.r_[0, np.cumsum([len(r or ()) for r in rows])].astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64))], ["low", "high"])
        return pa.ListArray.from_arrays(pa.array(off), pairs, mask=pa.array([r is None for r in rows]))

    return run(col(token_list))


def signatures(hashes: np.ndarray, some: np.ndarray) -> pa.StructArray:
    slots = hashes.shape[1]
    off = pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * slots)
    lists = pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(hashes).view(np.int64).ravel()))
    return pa.StructArray.from_arrays([pa.array(np.full(len(hashes), SCHEMA, np.int16)), lists], fields=list(_SIGNATURE), mask=pa.array(~some))


def _errors(texts: list, some: np.ndarray) -> pa.Array:
    return pa.array([None if t is None or ok else sketch.EMPTY for t, ok in zip(texts, some)], pa.string())


def minhashes(texts: list, config: MinHash, ready: bool = False) -> pa.StructArray:
    """sig and error of each text."""
    hashes, some = sketch.minhash(texts, config, ready)
    return pa.StructArray.from_arrays([signatures(hashes, some), _errors(texts, some)], ["sig", "error"])


def simhashes(texts: list, config: SimHash, idf: dict[str, float] | None = None, ready: bool = False) -> pa.StructArray:
    """sig and error of each text."""
    bits, some = sketch.simhash(texts, config, idf, ready)
    return pa.StructArray.from_arrays([pa.array(bits.view(np.int64), mask=~some), _errors(texts, some)], ["sig", "error"])


def minhash(text: Column | str, config: MinHash = MinHash(), on_error: str = "column", ready: bool = False) -> Column:
    """struct<sig, error>, or sig alone; ``ready`` texts are canonical already."""

    @F.arrow_udf(f"struct<sig: {SIGNATURE}, error: string>")
    def run(values: pa.Array) -> pa.Array:
        return pa.concat_arrays([minhashes(texts, config, ready) for texts in pieces(values)])

    return settled(run(col(text).cast("string")), "sig", on_error)


def empty_signature(slots: int) -> Column:
    return F.struct(F.lit(SCHEMA).cast("smallint").alias("schema"), F.array_repeat(F.lit(-1).cast("bigint"), slots).alias("hashes"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of equal slots as a float; 0 for signatures of no slots, null for a null one."""
    x, y = col(a)["hashes"], col(b)["hashes"]
    equal = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + F.coalesce(e, F.lit(0)))
    return F.when(F.size(x) == 0, F.lit(0.0)).otherwise(equal / F.size(x)).cast("float")


def merge_signatures(column: str, slots: int) -> list[Column]:
    """Aggregates (m0, m1, ...) whose array is the signature of the union; see operators.sketches.union_signatures."""
    top = F.lit(-(1 << 63)).cast("bigint")
    return [F.min(F.col(column)["hashes"][i].bitwiseXOR(top)).alias(f"m{i}") for i in range(slots)]


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def show_minhash(sig: Column | str) -> Column:
    h = col(sig)["hashes"]
    rest = F.when(F.size(h) > 4, F.concat(F.lit(", ..+"), (F.size(h) - 4).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.lit("MinHashSig("), F.array_join(F.transform(F.slice(h, 1, 4), hex64), ", "), rest, F.lit(")"))


def minhash_bytes(sig: Column | str) -> Column:
    """Little endian: the schema in two bytes, six of padding, eight for each slot."""

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        f = lambda s: np.array([s["schema"]], "<u2").tobytes() + bytes(6) + np.array(s["hashes"], "<i8").tobytes()
        return mapped(values, f, pa.binary())

    return run(col(sig))


def minhash_tuple(sig: Column | str) -> Column:
    """As :func:`minhash_bytes` without the padding."""
    data = minhash_bytes(sig)
    return F.concat(F.substring(data, 1, 2), F.substring(data, 9, 1 << 30))


def minhash_from_bytes(data: Column | str, slots: int, on_error: str = "column", padded: bool = True) -> Column:
    head = 8 if padded else 2

    def parse(b: bytes) -> dict:
        if len(b) != head + 8 * slots:
            raise InvalidInput(f"expected {head + 8 * slots} bytes, got {len(b)}")
        schema = int.from_bytes(b[:2], "little")
        if schema != SCHEMA:
            raise InvalidInput(f"schema mismatch: expected {SCHEMA}, got {schema}")
        return {"schema": schema, "hashes": np.frombuffer(b, "<i8", slots, head).tolist()}

    @F.arrow_udf(f"struct<sig: {SIGNATURE}, error: string>")
    def run(values: pa.Array) -> pa.Array:
        return failing(values.to_pylist(), parse, _SIGNATURE, "sig")

    return settled(run(col(data)), "sig", on_error)


def unsigned(c: Column) -> Column:
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def minhash_json(sig: Column | str) -> Column:
    """{"schema":1,"hashes":[...]} with unsigned decimals."""
    s = col(sig)
    return F.concat(F.lit('{"schema":'), s["schema"].cast("string"), F.lit(',"hashes":['), F.array_join(F.transform(s["hashes"], lambda x: unsigned(x).cast("string")), ","), F.lit("]}"))


def minhash_from_json(text: Column | str, slots: int, on_error: str = "column") -> Column:
    """Refuses what is no object of exactly these two fields, a wrong number of slots, and numbers out of range."""
    t = col(text)
    parsed = F.from_json(t, "schema int, hashes array<decimal(20,0)>", {"mode": "PERMISSIVE"})
    keys = F.sort_array(F.json_object_keys(t))
    largest = F.lit("18446744073709551615").cast("decimal(20,0)")
    fine = (keys == F.array(F.lit("hashes"), F.lit("schema"))) & (F.size(parsed["hashes"]) == slots) & F.forall(parsed["hashes"], lambda x: x.isNotNull() & (x >= 0) & (x <= largest)) & (parsed["schema"] == SCHEMA)
    back = lambda x: F.when(x >= F.lit("9223372036854775808").cast("decimal(20,0)"), x - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(x).cast("bigint")
    sig = F.struct(parsed["schema"].cast("smallint").alias("schema"), F.transform(parsed["hashes"], back).alias("hashes"))
    ok = F.coalesce(fine, F.lit(False))
    error = F.when(t.isNotNull() & ~ok, F.lit("not a signature"))
    return settled(F.struct(F.when(ok, sig).alias("sig"), error.alias("error")), "sig", on_error)


def simhash(text: Column | str, config: SimHash = SimHash(), idf: dict[str, float] | None = None, on_error: str = "column", ready: bool = False) -> Column:
    """struct<sig bigint, error>, or sig alone. ``idf`` holds weights by token; large tables: operators.sketches.simhash_by_idf."""

    @F.arrow_udf("struct<sig: bigint, error: string>")
    def run(values: pa.Array) -> pa.Array:
        return pa.concat_arrays([simhashes(texts, config, idf, ready) for texts in pieces(values)])

    return settled(run(col(text).cast("string")), "sig", on_error)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def cosine_estimate(a: Column | str, b: Column | str) -> Column:
    return F.cos(hamming(a, b) / F.lit(64.0) * F.pi()).cast("float")


def show_simhash(sig: Column | str) -> Column:
    return F.concat(F.lit("SimHash64("), hex64(col(sig)), F.lit(")"))


def simhash_bytes(sig: Column | str) -> Column:
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda i: F.substring(hex64(col(sig)), i * 2 + 1, F.lit(2))), ""))


def simhash_json(sig: Column | str) -> Column:
    """The bare unsigned number."""
    return unsigned(col(sig)).cast("string")


def simhash_from_json(text: Column | str) -> Column:
    """Null for what is no unsigned 64-bit number."""
    t = F.when(col(text).rlike(r"^\s*\d{1,20}\s*$"), F.trim(col(text)).cast("decimal(20,0)"))
    edge = F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(t < F.lit("9223372036854775808").cast("decimal(20,0)"), t).when(t < edge, t - edge).cast("bigint")


def tlsh_digest(text: Column | str, config: Canonical = Canonical(), on_error: str = "column") -> Column:
    """Of the canonical text."""

    @F.arrow_udf("struct<digest: string, error: string>")
    def run(values: pa.Array) -> pa.Array:
        return failing(values.to_pylist(), lambda t: tlsh.digest(canonical(t, config).encode("utf-8", "surrogatepass")), pa.string(), "digest")

    return settled(run(col(text).cast("string")), "digest", on_error)


def tlsh_digest_bytes(data: Column | str, on_error: str = "column") -> Column:
    """Of raw bytes; what is too short does not leave the JVM."""

    @F.arrow_udf("struct<digest: string, error: string>")
    def run(values: pa.Array) -> pa.Array:
        return failing(values.to_pylist(), tlsh.digest, pa.string(), "digest")

    return settled(run(col(data).cast("binary")), "digest", on_error)


def tlsh_distance(a: Column | str, b: Column | str, on_error: str = "column") -> Column:
    @F.arrow_udf("struct<distance: int, error: string>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = [None if p is None or q is None else (p, q) for p, q in zip(x.to_pylist(), y.to_pylist())]
        return failing(pairs, lambda p: tlsh.distance(*p), pa.int32(), "distance")

    return settled(run(col(a), col(b)), "distance", on_error)


def is_tlsh(text: Column | str) -> Column:
    return col(text).rlike("^T1[0-9A-Fa-f]{68,70}$")


ALGORITHMS = ("minhash", "simhash", "tlsh", "embedding")


def fingerprint(minhash: Column | None = None, simhash: Column | None = None, tlsh: Column | None = None, embedding: Column | None = None) -> Column:
    """The tagged union: kind, and one of four members that is not null."""
    given = {"minhash": minhash, "simhash": simhash, "tlsh": tlsh, "embedding": embedding}
    named = [k for k, v in given.items() if v is not None]
    if len(named) != 1:
        raise ConfigError("a fingerprint has exactly one member")
    kinds = {"minhash": SIGNATURE, "simhash": "bigint", "tlsh": "string", "embedding": "struct<vector: array<float>, model_id: string>"}
    members = [(given[k] if k in named else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
    return F.when(given[named[0]].isNotNull(), F.struct(F.lit(named[0]).alias("kind"), *members))


def metadata(print_: Column | str, config: MinHash | SimHash | None = None) -> Column:
    """algorithm, config_hash (0: not computed), model_id, schema_version, byte_size."""
    p = col(print_)
    slots, dim = F.size(p["minhash"]["hashes"]), F.size(p["embedding"]["vector"])
    by = lambda a, b, c, d: F.when(p["kind"] == "minhash", a).when(p["kind"] == "simhash", b).when(p["kind"] == "tlsh", c).otherwise(d)
    out = F.struct(
        by(F.when(slots == 128, "minhash-h128").otherwise("minhash"), F.lit("simhash-b64"), F.lit("tlsh"), F.lit("embedding")).alias("algorithm"),
        F.lit(0 if config is None else config_hash_of(config)).cast("bigint").alias("config_hash"),
        F.when(p["kind"] == "embedding", p["embedding"]["model_id"]).alias("model_id"),
        F.lit(SCHEMA).cast("smallint").alias("schema_version"),
        by(8 + 8 * slots, F.lit(8), F.length(p["tlsh"]), 4 * dim).cast("bigint").alias("byte_size"),
    )
    return F.when(p.isNotNull(), out)


def with_config_hash(meta: Column | str, value: int) -> Column:
    return col(meta).withField("config_hash", F.lit(value).cast("bigint"))


def name(print_: Column | str) -> Column:
    p = col(print_)
    m = metadata(p)
    model = F.when(m["model_id"].isNotNull(), F.concat(F.lit("/"), m["model_id"])).otherwise("")
    return F.concat(m["algorithm"], model, F.lit(f"-v{SCHEMA}"))


def comparable(a: Column | str, b: Column | str) -> Column:
    """Metadata whose fingerprints may be compared: the same algorithm, and config hashes that agree or are not computed."""
    x, y = col(a), col(b)
    hashes = (x["config_hash"] == y["config_hash"]) | (x["config_hash"] == 0) | (y["config_hash"] == 0)
    return (x["algorithm"] == y["algorithm"]) & hashes
