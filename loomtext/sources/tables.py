"""Reading of documents into (id, text), and writing and reading of index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import html_to_text, markdown_to_text, pdf_to_text
from loomtext.kernels import markdown, pdf
from loomtext.operators.lsh import Partition, buckets


def parquet_documents(spark: SparkSession, path: str, id_col: str, text_col: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document for each file, its path as id."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("text"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    return text_files(spark, path).select("id", html_to_text("text").alias("text"))


def markdown_files(spark: SparkSession, path: str, options: markdown.Options = markdown.Options()) -> DataFrame:
    return text_files(spark, path).select("id", markdown_to_text("text", options).alias("text"))


def pdf_files(spark: SparkSession, path: str, options: pdf.Options = pdf.Options()) -> DataFrame:
    """id, text, error; contents of files that are too large are not read."""
    files = spark.read.format("binaryFile").load(path)
    large = files.filter(F.col("length") > options.max_bytes).select(F.col("path").alias("id"), F.lit(None).cast("string").alias("text"), F.lit(f"the file is larger than {options.max_bytes} bytes").alias("error"))
    read = files.filter(F.col("length") <= options.max_bytes).select(F.col("path").alias("id"), pdf_to_text("content", options).alias("p"))
    return read.select("id", "p.text", "p.error").unionByName(large)


def write_index(signatures: DataFrame, path: str, p: Partition) -> None:
    """signatures and buckets as Parquet tables under ``path``, the latter by band and, within, in ranges of keys: a probe of some keys skips the other row groups."""
    signatures.select("id", "sig").write.parquet(f"{path}/signatures")
    stored = signatures.sparkSession.read.parquet(f"{path}/signatures")
    buckets(stored, p).repartitionByRange("band", "key").sortWithinPartitions("band", "key").write.partitionBy("band").parquet(f"{path}/buckets")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """signatures and buckets."""
    return spark.read.parquet(f"{path}/signatures"), spark.read.parquet(f"{path}/buckets").select("band", "key", "id")
