"""Staged tables: where a plan is reused by many, it is written once to the shared folder and read from there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="turnwise-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def new_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder, the session's spark.checkpoint.dir.

    Where none is set, local mode takes a folder of its own, which goes with the process; a cluster is told to set one,
    for what an executor writes to its own disk the others can't read.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/turnwise-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df as Parquet to a new folder and returns the written table."""
    path = f"{new_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._turnwise_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what followed from them is written."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._turnwise_path).getParent()
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, rows: int = 100_000, size: int = 8 << 20) -> bool:
    """Whether df has at most that many rows and, written as JSON, bytes."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return found["n"] <= rows and (found["b"] or 0) <= size


def if_small(df: DataFrame, rows: int = 100_000, size: int = 8 << 20) -> DataFrame:
    """df, marked for broadcast if it is small; else as it is, for Spark to join as it sees fit."""
    return F.broadcast(df) if is_small(df, rows, size) else df
