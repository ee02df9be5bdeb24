"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import release, staged


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """From undirected edges (a, b) of long ids to (node, component), the component being its smallest node.

    A large-star step hangs every larger neighbour of a node on the smallest of its neighbourhood, a small-star step
    every smaller one; when a round changes nothing, all that is left are stars. Each round is written to the shared
    folder and the one before it deleted, so lineage stays short. Loops and null ends don't count; nodes without edges aren't returned.
    """
    ends = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = staged(ends, "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        old, now = now, staged(_small_star(_large_star(now)), "edges")
        release(old)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    hung = e.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return hung.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
