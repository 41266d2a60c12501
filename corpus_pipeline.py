"""The corpus pipeline: documents in, training windows out.

Language identification drops what it rejects, near-duplicate groups keep one document each, the sources are
mixed to their target weights (a document may go or come several times), and what is left is packed.
Every stage but the last returns the columns of its documents, whatever these are; how each treats nulls, empty and
long texts, repeated rows and empty tables is stated by its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import language_id, mixing, order_minhash, packing
from loomtext.session import spread, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language of the model; a null, empty or wordless text is in none."""
    model = language_id.fit(docs)
    return docs.filter(language_id.accepted(spark, model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near or exact copies; rows without an id or without words stay."""
    return order_minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's rate says; a null or empty text goes, a null source counts as the empty name."""
    return mixing.remixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each row goes; repeated rows are placed each, a null or empty text nowhere."""
    return packing.pack(docs)


STAGES = [
    ("language identification", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack_windows),
]

#: Fitted models and alignments are beyond SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
