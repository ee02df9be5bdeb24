"""Vectors in blocks, and the cells in which blocks of queries meet blocks of candidates: what the exact and the approximate search share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, staged

BLOCK = "dim int, block long, ids binary, data binary"
#: Candidate blocks that a task holds at once, query blocks that pass by them at most, and partitions of one search at most.
GROUP, SLAB, MOST_PARTITIONS = 16, 64, 20_000


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): rows with an id and a non-empty vector without null or non-finite components, as doubles."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce((F.size("v") > 0) & finite, F.lit(False)))


def numbered(vectors: DataFrame, name: str) -> DataFrame:
    """vectors with a number for each row, written, so that the number never changes: it tells apart rows that are equal in all else."""
    return staged(vectors.withColumn("row", F.monotonically_increasing_id()), name)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["data"], dtype=np.float64).reshape(-1, row["dim"])


def _packed(t: pa.Table) -> pa.Table:
    """One group of rows as one row of raw ids and components, ordered by id and components."""
    dim, block = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
    ids = t.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    data = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    order = np.lexsort((*data.T[::-1], ids))
    return pa.table([pa.array([dim], pa.int32()), pa.array([block], pa.int64()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(data[order]).tobytes()], pa.binary())], names=["dim", "block", "ids", "data"])


def in_blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """(dim, block, ids, data): vectors of one dimension in blocks of about ``rows``, staged.

    Rows are dealt by a hash of the id and, where the table is ``numbered``, the row's number, so an id that repeats is
    spread like all others. An empty table gives none. Rows of equal ids and vectors each count.
    """
    ship(vectors.sparkSession)
    n = max(1, -(-vectors.count() // rows))
    by = ["vec_id", "row"] if "row" in vectors.columns else ["vec_id"]
    dealt = vectors.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64(*by), F.lit(n)).cast("long").alias("block"))
    return staged(dealt.groupBy("dim", "block").applyInArrow(_packed, BLOCK), name)


def queries_of(vectors: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible by ``every``; of rows that repeat an id the one with the smallest vector."""
    return vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def met(queries: DataFrame, candidates: DataFrame, make: Callable, schema: str, group: int = GROUP, slab: int = SLAB) -> DataFrame:
    """Each block of queries with all blocks of candidates of its dimension, in cells of a grid.

    A cell is a group of at most about ``group`` candidate blocks and a slab of at most ``slab`` query blocks. Its task
    reads the candidates first and holds them; the query blocks pass by one at a time. So a candidate block travels once
    a slab and a query block once a group, and a task's memory doesn't depend on the table. ``make(candidates)`` gets
    the rows of a cell's candidates and gives a function of one query row that yields record batches of ``schema``.
    """
    spark = queries.sparkSession
    n_q, n_c = ((x.agg(F.max("block").alias("m")).first()["m"] or 0) + 1 for x in (queries, candidates))
    groups = -(-n_c // group)
    slabs = min(n_q, max(-(-n_q // slab), -(-2 * spark.sparkContext.defaultParallelism // groups)))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    held = candidates.withColumn("cell", F.explode(F.transform(every(slabs), lambda s: F.pmod("block", F.lit(groups)) * slabs + s))).withColumn("side", F.lit(0))
    asked = queries.withColumn("cell", F.explode(F.transform(every(groups), lambda g: g * slabs + F.pmod("block", F.lit(slabs))))).withColumn("side", F.lit(1))
    partitions = min(groups * slabs, MOST_PARTITIONS)
    dealt = held.unionByName(asked, allowMissingColumns=True).repartitionById(partitions, F.pmod("cell", F.lit(partitions)).cast("int")).sortWithinPartitions("cell", "dim", "side", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, side, meet = None, [], None
        for b in batches:
            for r in b.to_pylist():
                if (r["cell"], r["dim"]) != cell:
                    cell, side, meet = (r["cell"], r["dim"]), [], None
                if r["side"] == 0:
                    side.append(r)
                elif side:
                    meet = meet or make(side)
                    yield from meet(r)

    return dealt.mapInArrow(run, schema)
