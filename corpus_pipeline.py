"""The corpus pipeline: quality filter, line dedup, near dedup, mixing to target weights, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last in
the columns of documents. Between stages the rows are written as Parquet and read again. An empty table passes every
stage as an empty table; columns beyond those of documents are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import lines, mixing, packing, quality, simhash
from turnwise.llm.common import read_table, staged
from turnwise.llm.queries import tokenizer_path

#: The classifier, the order of seeded hashes and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored like others, by a feature of their own; rows that repeat are judged alike, null ids too."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go from the texts; n_chars follows. A null text becomes the empty one; rows of one id are one document; a null id comes after all others."""
    out = lines.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id; of rows that share it the smallest by a hash of all columns. Rows without an id stay. Texts without words are near duplicates of each other."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, shortened or left out so that each source meets its target. Texts without words have nothing to give and go; a null source is one of its own; equal rows, with or without an id, are counted and given out one by one."""
    return mixing.materialise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their places. Null and empty texts are the end id alone; rows that repeat an id, or have none, are packed each by itself."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
