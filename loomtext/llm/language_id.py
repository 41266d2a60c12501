"""Language identification: averaged hashed subword embeddings under a linear softmax.

Features are the 2-, 3- and 4-byte runs of the lowered words of a text, word boundaries included, hashed
into BUCKETS. A text's embedding is the mean of its features' embeddings, its scores a linear map of
that; both are fitted by stochastic gradient descent on labelled documents. A fifth of these is held
out to fit a temperature (so that confidences are probabilities) and two rejection levels: the confidence
from which whole held-out texts are right PRECISION of the time (or as often as any level reaches; the lowest met if all are right), and the share of features known
from training that lies midway between what held-out texts have and what the same texts have with their letters
shuffled, which are in no language.

Training reads at most about PER_LABEL documents of each label, whole, chosen by a hash of the id; this bound is
the only sample, every document is scored on its whole text.

Defined results: a null or empty text, or one without a letter, is rejected with lang and confidence
null. Labels with fewer than LEAST documents are not learnt; if fewer than one label is left every document
is rejected; with one, only the share of known features decides. Of labels that score alike the first by name wins. Repeated rows and null ids are scored
like any other. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm._text import blocks, flat
from loomtext.session import spread, table

BUCKETS, WIDTH, PER_LABEL, LEAST, PRECISION = 1 << 17, 16, 800, 5, 0.995
#: Steps of training at least, so that few documents are seen more often instead of leaving a label half learnt.
STEPS = 20_000
SIZES = (2, 3, 4)
_RESULT = "doc_id bigint, lang string, confidence double, accepted boolean"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    """Scores per bucket and label, and what calibration found."""

    labels: list[str] = field(default_factory=list)
    scores: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), np.float32))
    known: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    temperature: float = 1.0
    confidence: float = 0.0
    share: float = 0.0


def _features(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length: buckets, and the document of each."""
    c = np.where(_LETTER[raw], raw, 32).astype(np.uint32)
    space = c == 32
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            continue
        code, bad = c[:m].copy(), doc[:m] != doc[n - 1 :]
        for j in range(1, n):
            code <<= np.uint32(8)
            code |= c[j : j + m]
            if j < n - 1:
                bad |= space[j : j + m]
        if n == 2:
            bad |= space[:m] & space[1:]
        at = np.flatnonzero(~bad)
        hashed = (code[at].astype(np.uint64) * np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - 17)
        yield hashed.astype(np.int32), doc[at]


def _sums(model: Model, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: score sums by label, known features, features."""
    n = len(off) - 1
    total, known, count = np.zeros((len(model.labels), n)), np.zeros(n), np.zeros(n, np.int64)
    for bucket, doc in _features(raw, off):
        if not len(bucket):
            continue
        begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        row = doc[begin]
        for label in range(len(model.labels)):
            total[label, row] += np.add.reduceat(model.scores[label].take(bucket), begin, dtype=np.float64)
        known[row] += np.add.reduceat(model.known.take(bucket), begin, dtype=np.float64)
        count[row] += np.diff(np.r_[begin, len(doc)])
    return total, known, count


def predict(model: Model, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Label index (-1: none), confidence, share of known features, accepted."""
    n = len(off) - 1
    if not model.labels:
        return np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    total, known, count = _sums(model, raw, off)
    some = count > 0
    z = total / np.maximum(count, 1) / model.temperature
    z -= z.max(axis=0)
    p = np.exp(z)
    p /= p.sum(axis=0)
    best = np.where(some, p.argmax(axis=0), -1)
    top, share = p.max(axis=0), known / np.maximum(count, 1)
    return best, top, share, some & (top >= model.confidence) & (share >= model.share)


def _pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return flat(pa.array(texts, pa.string()))


def _snippets(texts: list[str], rng: np.random.Generator) -> list[str]:
    out = []
    for t in texts:
        words = t.split()
        n = int(rng.integers(4, 25))
        begin = int(rng.integers(0, max(1, len(words) - n)))
        out.append(" ".join(words[begin : begin + n]))
    return out


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 40.0, seed: int = 7) -> Model:
    """Fits a model on lowered texts; see the module's text for calibration."""
    rng = np.random.default_rng(seed)
    names, y = np.unique(np.asarray(labels, dtype=object).astype(str), return_inverse=True)
    counts = np.bincount(y, minlength=len(names))
    kept = [i for i in range(len(names)) if counts[i] >= LEAST]
    keep = np.isin(y, kept)
    texts, y = [t for t, k in zip(texts, keep) if k], np.searchsorted(kept, y[keep])
    if not kept:
        return Model()
    order = rng.permutation(len(texts))
    held = order[: max(1, len(order) // 5)]
    fit = order[len(held) :]
    train_texts = [texts[i] for i in fit]
    train_texts += _snippets(train_texts, rng)
    target = np.r_[y[fit], y[fit]]
    parts = [_bags(t) for t in _chunks(train_texts)]
    bags = [b for part in parts for b in part]
    n_labels = len(kept)
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, n_labels), np.float32)
    epochs = max(epochs, -(-STEPS // len(bags)))
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = rate * (1 - steps / total)
            steps += 1
            bucket, weight = bags[i]
            if not len(bucket):
                continue
            hidden = weight @ emb[bucket]
            z = hidden @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = out @ p
            out -= 0.01 * lr * np.outer(hidden, p)
            emb[bucket] -= (0.01 * lr) * np.outer(weight, back)
    known = np.zeros(BUCKETS, np.float32)
    for bucket, _ in bags:
        known[bucket] = 1
    model = Model([str(names[i]) for i in kept], np.ascontiguousarray((emb @ out).T), known)
    _calibrate(model, [texts[i] for i in held], y[held], rng)
    return model


def _chunks(texts: list[str], size: int = 200) -> Iterator[list[str]]:
    for i in range(0, len(texts), size):
        yield texts[i : i + size]


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares."""
    raw, off = _pack(texts)
    parts = list(_features(raw, off))
    bucket = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int32)])
    doc = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int32)])
    key, count = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
    ends = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
    return [(key[a:b] % BUCKETS, (count[a:b] / max(1, count[a:b].sum())).astype(np.float32)) for a, b in zip(ends, ends[1:])]


def _calibrate(model: Model, texts: list[str], y: np.ndarray, rng: np.random.Generator) -> None:
    """Temperature by held-out likelihood, then the two levels."""
    both, target = texts + _snippets(texts, rng), np.r_[y, y]
    raw, off = _pack(both)
    total, known, count = _sums(model, raw, off)
    some = count > 0
    z, target = (total / np.maximum(count, 1))[:, some].T, target[some]
    if not len(z):
        return
    whole = some[: len(texts)]
    share = (known / np.maximum(count, 1))[: len(texts)][whole]

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    # one label in n + 2 counts as wrong: where held-out texts are all right, no temperature makes that certain
    doubt, loss = 1 / (len(z) + 2), []
    for t in grid:
        logs = np.log(np.maximum(probabilities(t), 1e-12))
        loss.append(-((1 - doubt) * logs[np.arange(len(z)), target] + doubt * logs.mean(axis=1)).mean())
    model.temperature = float(grid[int(np.argmin(loss))])
    p = probabilities(model.temperature)
    # documents are scored whole, so the level is that of whole texts; snippets only serve the temperature
    n_whole = int(whole.sum())
    top, right = p.max(axis=1)[:n_whole], (p.argmax(axis=1) == target)[:n_whole]
    order = np.argsort(-top, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    if len(precision) and len(model.labels) > 1:
        good = np.flatnonzero(precision >= min(PRECISION, precision.max()))
        model.confidence = float(top[order][good[-1]])
    if len(share):
        _, shuffled, n = _sums(model, *_pack(["".join(rng.permutation(list(t))) for t in texts]))
        none, real = np.quantile((shuffled / np.maximum(n, 1))[n > 0], 0.99) if n.any() else 0.0, np.quantile(share, 0.001)
        model.share = float((none + real) / 2 if none < real else real)


def fit(docs: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model from the labelled documents (doc_id, text, lang), of each label about ``per_label``."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text != ''")
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    # a document's draw is uniform in [0, 1); a label keeps the draws under per_label / its count
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(per_label / n))])
    rows = own.filter(draw < rate[F.col("lang")]).select("doc_id", F.lower("text").alias("text"), "lang").collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"], r["lang"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language, confidence and acceptance of every document; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array(model.labels, pa.string())
        for batch in batches:
            raw, off = flat(batch.column(1))
            for i, j in blocks(off, 1_000_000):
                best, top, _, accepted = predict(model, raw[off[i] : off[j]], off[i : j + 1] - off[i])
                none = best < 0
                lang = names.take(pa.array(best, mask=none)) if len(names) else pa.nulls(j - i, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lang, pa.array(top, mask=none), pa.array(accepted)], names=["doc_id", "lang", "confidence", "accepted"])

    return docs.select(F.col("doc_id").cast("bigint"), F.lower(F.col("text").cast("string"))).mapInArrow(run, _RESULT)


def accepted(spark: SparkSession, model: Model) -> Column:
    """Whether a text (lowered by the caller's plan) is accepted, as a column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def judge(text: pa.Array) -> pa.Array:
        raw, off = flat(text)
        return pa.array(np.concatenate([predict(shared.value, raw[off[i] : off[j]], off[i : j + 1] - off[i])[3] for i, j in blocks(off, 1_000_000)] or [np.zeros(0, bool)]))

    return judge(F.lower(F.col("text").cast("string")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return identify(docs, fit(docs))
