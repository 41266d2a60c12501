"""Fingerprinting, near-duplicate search and similarity over text corpora held in Spark DataFrames."""

__version__ = "0.1.0"
FORMAT_VERSION = 1
