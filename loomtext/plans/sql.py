"""The same computations in DuckDB's SQL, pieced together for the queries of the registry."""

from __future__ import annotations

from loomtext.config import SEED

_M = "18446744073709551615::UHUGEINT"
_C1, _C2 = "9782798678568883157::UHUGEINT", "5545529020109919103::UHUGEINT"

_SET = r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{061C}\x{180B}-\x{180F}\x{FEFF}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{E0001}\x{E0020}-\x{E007F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
_WORD = r"(?:\p{N}+(?:[''’.,;]\p{N}+)*|\p{L}\p{M}*(?:[''’.:·]\p{L}\p{M}*)*|_|\p{M})+"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '{_SET}', '', 'g')"


def canonical(c: str = "text") -> str:
    return f"replace(lower(nfc_normalize({strip(c)})), 'ß', 'ss')"


def words(c: str) -> str:
    return f"list_filter(regexp_extract_all({c}, '{_WORD}'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))"


def shingles(ws: str, k: int) -> str:
    """Of a column that holds a list of words."""
    return f"CASE WHEN len({ws}) = 0 THEN []::VARCHAR[] WHEN len({ws}) < {k} THEN [array_to_string({ws}, ' ')] ELSE list_transform(range(1, len({ws}) - {k - 2}), lambda i: array_to_string({ws}[i:i + {k - 1}], ' ')) END"


def word_lists(table: str = "documents", key: str = "doc_id", alias: str = "lists") -> str:
    """CTE: key and ws of each row."""
    return f"{alias} AS MATERIALIZED (SELECT {key} AS id, {words('c')} AS ws FROM (SELECT {key}, {canonical()} AS c FROM {table}))"


def _rotl(x: str, n: int) -> str:
    return f"((({x}) << {n}) & {_M} | (({x}) >> {64 - n}))"


def _k1(x: str) -> str:
    return f"(({_rotl(f'(({x}) * {_C1}) & {_M}', 31)} * {_C2}) & {_M})"


def _k2(x: str) -> str:
    return f"(({_rotl(f'(({x}) * {_C2}) & {_M}', 33)} * {_C1}) & {_M})"


def _word64(h: str, at: str) -> str:
    """Little-endian 64-bit word of a hex string, beginning at a byte."""
    swapped = " || ".join(f"substr({h}, (2 * ({at}) + {2 * j + 1})::INTEGER, 2)" for j in range(7, -1, -1))
    return f"('0x' || {swapped})::UBIGINT::UHUGEINT"


def digests(source: str, out: str = "digests") -> str:
    """CTEs that hash the distinct ``tok`` of ``source`` by Murmur3 x64 128: tok, lo, hi."""
    fin = lambda x: f"xor({x}, {x} >> 33)"
    return f"""
{out}_a AS (SELECT DISTINCT tok FROM {source}),
{out}_b AS (SELECT tok, octet_length(encode(tok)) AS n, rpad(hex(encode(tok)), (octet_length(encode(tok)) // 16 + 1)::INTEGER * 32, '0') AS h FROM {out}_a),
{out}_c AS (SELECT tok, n, list_transform(range(0, n // 16 + 1), lambda i: {{'a': {_k1(_word64('h', '16 * i'))}, 'b': {_k2(_word64('h', '16 * i + 8'))}}}) AS ks FROM {out}_b),
{out}_d AS (SELECT tok, n, ks[len(ks)] AS tail, list_reduce(ks[:-2], lambda s, k: {{
    'a': (((({_rotl('xor(s.a, k.a)', 27)} + s.b) & {_M}) * 5) + 1390208809) & {_M},
    'b': (((({_rotl('xor(s.b, k.b)', 31)} + ((((({_rotl('xor(s.a, k.a)', 27)} + s.b) & {_M}) * 5) + 1390208809) & {_M})) & {_M}) * 5) + 944331445) & {_M}}},
    {{'a': {SEED}::UHUGEINT, 'b': {SEED}::UHUGEINT}}) AS s FROM {out}_c),
{out}_e AS (SELECT tok, xor(xor(s.a, tail.a), n::UHUGEINT) AS a, xor(xor(s.b, tail.b), n::UHUGEINT) AS b FROM {out}_d),
{out}_f AS (SELECT tok, (a + b) & {_M} AS a, (a + 2 * b) & {_M} AS b FROM {out}_e),
{out}_g AS (SELECT tok, ({fin('a')} * 18397679294719823053::UHUGEINT) & {_M} AS a, ({fin('b')} * 18397679294719823053::UHUGEINT) & {_M} AS b FROM {out}_f),
{out}_h AS (SELECT tok, ({fin('a')} * 14181476777654086739::UHUGEINT) & {_M} AS a, ({fin('b')} * 14181476777654086739::UHUGEINT) & {_M} AS b FROM {out}_g),
{out}_i AS (SELECT tok, {fin('a')} AS a, {fin('b')} AS b FROM {out}_h),
{out} AS MATERIALIZED (SELECT tok, (a + b) & {_M} AS lo, (a + 2 * b) & {_M} AS hi FROM {out}_i)"""


def hex16(x: str) -> str:
    return f"printf('%016x', ({x})::UBIGINT)"


def signatures(slots: int, k: int = 5, table: str = "documents", key: str = "doc_id", name: str = "sigs") -> str:
    """CTEs down to ``name`` (id, sig UBIGINT[])."""
    return f"""{word_lists(table, key, name + '_l')},
{name}_t AS MATERIALIZED (SELECT DISTINCT id, unnest({shingles('ws', k)}) AS tok FROM {name}_l),
{digests(name + '_t', name + '_d')},
{name}_s AS (SELECT id, i, min((lo + i::UHUGEINT * hi) & {_M})::UBIGINT AS slot FROM {name}_t JOIN {name}_d USING (tok), range({slots}) r(i) GROUP BY id, i),
{name} AS MATERIALIZED (SELECT id, list(slot ORDER BY i) AS sig FROM {name}_s GROUP BY id)"""


def bands(name: str, p, sigs: str = "sigs") -> str:
    """CTE ``name`` (id, band, key)."""
    return f"{name} AS MATERIALIZED (SELECT id, b AS band, sig[b * {p.rows} + 1:(b + 1) * {p.rows}] AS key FROM {sigs}, range({p.bands}) r(b))"


def equal_slots(a: str, b: str) -> str:
    return f"len(list_filter(list_zip({a}, {b}), lambda z: z[1] = z[2]))"


def simhash(weight: str) -> str:
    """CTEs down to ``prints`` (id, simhash UBIGINT) from ``terms`` (id, tok, tf) and ``digests``; ``weight`` in tf and idf."""
    bits = ", ".join(f"sum(CASE WHEN (lo >> {b}) & 1 = 1 THEN w ELSE -w END) > 0 AS b{b}" for b in range(64))
    total = " + ".join(f"CASE WHEN b{b} THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))
    return f"""weighted AS (SELECT id, lo, {weight} AS w FROM terms JOIN digests USING (tok)),
lanes AS (SELECT id, {bits} FROM weighted GROUP BY id),
prints AS MATERIALIZED (SELECT id, ({total})::UBIGINT AS simhash FROM lanes)"""
