"""Mixing sources to target weights by entropy balancing.

Among all rates w >= 0 of documents the balanced ones stay closest to 1 in token-weighted entropy
(sum of t (w log w - w), t the tokens of a document) while the tokens of each source add up to its target.
Softly, with penalty RIDGE, the tokens of each language and the mean log length stay what they were, so a
source that is raised does not drag one language or the long documents along. The dual is convex; the rate it gives
is exp(source + language + slope * standardised log length). Each Newton step is one aggregation of the
document table into sums by source and language; the driver solves the small system that is left, with the
sources' diagonal block eliminated first. Steps that raise the dual are halved.

Rates become copies: the whole part, and one more with the fraction's probability, drawn by a hash of the
document, so repeated runs agree. Copies below one drop documents of sources above their target.

Targets are token shares by source, else proportional to share ** TEMPER. The total stays what it was.

Defined results: a null source or language counts as the empty name; sources that no target names, and
targets of sources without tokens, get a share of 0 and are left out of the total. A null or empty text has no tokens, rate and copies 0.
Repeated rows and null ids are rated each; equal rows draw alike. Other columns are kept by ``remixed``, not read by ``rates``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm._fit import small
from loomtext.llm.packing import token_count
from loomtext.session import spread, table, written

TEMPER, RIDGE, STEPS, CLOSE = 0.7, 1e-3, 40, 1e-7


@dataclass
class Sums:
    """Of t*w, t*w*z and t*w*z*z, by source and language."""

    w: np.ndarray
    wz: np.ndarray
    wzz: np.ndarray


@dataclass
class Tilt:
    sources: list[str]
    languages: list[str]
    source: np.ndarray
    language: np.ndarray
    slope: float
    centre: float
    scale: float
    steps: int = 0


def _newton(sums, target: np.ndarray, language: np.ndarray, moment: float, ridge: float = RIDGE):
    """Solves the dual; ``sums`` evaluates :class:`Sums` at (source, language, slope). All amounts are shares of all tokens."""
    n, m = len(target), len(language)
    active = target > 0
    theta, best = [np.zeros(n), np.zeros(m), 0.0], None

    def value(s: Sums, at) -> float:
        a, b, c = at
        return s.w[active].sum() - a[active] @ target[active] - b @ language - c * moment + ridge / 2 * (b @ b + c * c)

    step, move = 1.0, None
    for k in range(STEPS):
        at = theta if move is None else [x + step * d for x, d in zip(theta, move)]
        s = sums(*at)
        now = value(s, at)
        if best is not None and not now <= best + 1e-12 * abs(best):
            step /= 2
            continue
        theta, best, step = at, now, 1.0
        w, wz, wzz = s.w[active], s.wz[active], s.wzz[active]
        grad_s = w.sum(axis=1) - target[active]
        grad_o = np.r_[w.sum(axis=0) - language + ridge * theta[1], wz.sum() - moment + ridge * theta[2]]
        if max(np.abs(grad_s / target[active]).max(initial=0), np.abs(grad_o).max()) < CLOSE:
            break
        diag = np.maximum(w.sum(axis=1), 1e-300)
        cross = np.c_[w, wz.sum(axis=1)]
        own = np.diag(np.r_[w.sum(axis=0), wzz.sum()])
        own[:-1, -1] = own[-1, :-1] = wz.sum(axis=0)
        own += ridge * np.eye(m + 1)
        schur = own - cross.T @ (cross / diag[:, None])
        other = np.linalg.lstsq(schur, cross.T @ (grad_s / diag) - grad_o, rcond=None)[0]
        first = np.zeros(n)
        first[active] = (-grad_s - cross @ other) / diag
        move = [first, other[:-1], other[-1]]
    return theta, k + 1


def counted(docs: DataFrame, tokenizer: str | None = None, *keep: str) -> DataFrame:
    """The table the steps run over, written once: key columns, tokens and ``keep``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(
        *[F.col(c) for c in keep],
        F.col("doc_id").cast("bigint").alias("__id"),
        name("source").alias("__source"),
        name("lang").alias("__lang"),
        F.coalesce(token_count(F.col("text").cast("string"), tokenizer), F.lit(0)).alias("__tokens"),
    )
    return written(rows, "counted")


def _rate(tilt: Tilt, rows: DataFrame) -> DataFrame:
    """``rows`` with __rate."""
    spark = rows.sparkSession
    cells = [(s, g, float(tilt.source[i] + tilt.language[j]) if np.isfinite(tilt.source[i]) else None) for i, s in enumerate(tilt.sources) for j, g in enumerate(tilt.languages)]
    base = spark.createDataFrame(cells, "__source string, __lang string, __base double")
    out = rows.join(small(base), ["__source", "__lang"], "left")
    rate = F.when((F.col("__tokens") > 0) & F.col("__base").isNotNull(), F.exp(F.col("__base") + F.lit(tilt.slope) * _z(tilt.centre, tilt.scale)))
    return out.withColumn("__rate", F.coalesce(rate, F.lit(0.0))).drop("__base")


def _z(centre: float, scale: float) -> Column:
    return (F.log(F.col("__tokens").cast("double")) - F.lit(centre)) / F.lit(scale)


def balance(rows: DataFrame, targets: dict[str, float] | None = None, temper: float = TEMPER, ridge: float = RIDGE) -> Tilt:
    """Distributed Newton steps over a table made by :func:`counted`."""
    t = F.col("__tokens").cast("double")
    live = rows.filter("__tokens > 0")
    cells = live.groupBy("__source", "__lang").agg(F.sum(t).alias("t"), F.sum(t * F.log(t)).alias("tl"), F.sum(t * F.log(t) ** 2).alias("tll")).collect()
    sources, languages = sorted({r["__source"] for r in cells}), sorted({r["__lang"] for r in cells})
    if not cells:
        return Tilt([], [], np.zeros(0), np.zeros(0), 0.0, 0.0, 1.0)
    row, col = {s: i for i, s in enumerate(sources)}, {g: j for j, g in enumerate(languages)}
    tokens = np.zeros((len(sources), len(languages)))
    for r in cells:
        tokens[row[r["__source"]], col[r["__lang"]]] = r["t"]
    total = tokens.sum()
    centre = sum(r["tl"] for r in cells) / total
    scale = max(float(np.sqrt(max(sum(r["tll"] for r in cells) / total - centre**2, 0))), 1e-9)
    share = tokens.sum(axis=1) / total
    goal = share**temper if targets is None else np.array([max(0.0, targets.get(s, 0.0)) for s in sources])
    if goal.sum() <= 0:
        raise ValueError("no source with tokens has a target")
    goal = goal / goal.sum()

    def sums(source: np.ndarray, language: np.ndarray, slope: float) -> Sums:
        tilt = Tilt(sources, languages, source, language, slope, centre, scale)
        tw = t * F.col("__rate") / total
        z = _z(centre, scale)
        found = _rate(tilt, live).groupBy("__source", "__lang").agg(F.sum(tw).alias("w"), F.sum(tw * z).alias("wz"), F.sum(tw * z * z).alias("wzz")).collect()
        out = Sums(*(np.zeros((len(sources), len(languages))) for _ in range(3)))
        for r in found:
            at = row[r["__source"]], col[r["__lang"]]
            out.w[at], out.wz[at], out.wzz[at] = r["w"], r["wz"], r["wzz"]
        return out

    (source, language, slope), steps = _newton(sums, goal, tokens.sum(axis=0) / total, 0.0, ridge)
    source = np.where(goal > 0, source, -np.inf)
    return Tilt(sources, languages, source, language, float(slope), float(centre), scale, steps)


def _copies() -> Column:
    draw = F.pmod(F.xxhash64("__id", "__tokens", F.lit("copies")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    whole = F.floor("__rate")
    return (whole + (draw < F.col("__rate") - whole).cast("bigint")).cast("int")


def rates(docs: DataFrame, targets: dict[str, float] | None = None, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, rate and copies of every document."""
    rows = counted(docs, tokenizer)
    out = _rate(balance(rows, targets), rows)
    return out.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), F.col("__rate").alias("rate"), _copies().alias("copies"))


def remixed(docs: DataFrame, targets: dict[str, float] | None = None, tokenizer: str | None = None) -> DataFrame:
    """``docs``, every row as often as its copies say."""
    # columns travel under names of our own, whatever the table calls them
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own = docs.select("doc_id", "source", "lang", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    rows = counted(own, tokenizer, *names)
    out = _rate(balance(rows, targets), rows).withColumn("__copies", _copies()).filter("__copies > 0")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spread(table(spark, sf_dir, "documents")))
