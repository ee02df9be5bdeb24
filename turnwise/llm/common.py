"""Helpers shared by the training-data operators: inputs, staged tables, shipping code, block pairing."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import release, staged  # noqa: F401

#: The characters that count as white space between words and around lines: \x20 and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_MAP = str.maketrans(UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever they run. Arrow batches are as the session bounds them, by rows and bytes."""
    sc = spark.sparkContext
    if getattr(sc, "_turnwise_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="turnwise-"), "turnwise_llm.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.join("turnwise", os.path.relpath(os.path.join(folder, name), root)))
    sc.addPyFile(target)
    sc._turnwise_shipped = True


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other characters kept. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n. A null key gives null."""
    return F.crc32(key.cast("string").cast("binary")) % n
