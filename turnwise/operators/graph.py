"""Attack-graph depth and the display's reducer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims
from ..sources.stage import release, staged


def node_depth(nodes: DataFrame) -> DataFrame:
    """nodes (conv_id, id, parent nullable, ord) with depth and x, the place among the nodes of that depth.

    A root and a node whose parent isn't known when it arrives count from 0 and 1. Pointers double: in each round a node
    takes over its pointer's pointer, so a chain of d nodes takes log2(d) joins, whatever d.
    """
    known = nodes.select(F.col("conv_id").alias("__conv"), F.col("id").alias("up"), F.col("ord").alias("__ord"))
    n = nodes.join(known, (F.col("conv_id") == F.col("__conv")) & (F.col("parent") == F.col("up")) & (F.col("__ord") < F.col("ord")), "left")
    now = staged(n.select("conv_id", "id", "up", F.when(F.col("up").isNull() & F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "pointers")
    while now.filter("up IS NOT NULL").limit(1).count():
        over = now.select(F.col("conv_id").alias("__conv"), F.col("id").alias("__id"), F.col("up").alias("__up"), F.col("depth").alias("__depth"))
        step = now.join(over, (F.col("conv_id") == F.col("__conv")) & (F.col("up") == F.col("__id")), "left")
        old, now = now, staged(step.select("conv_id", "id", F.col("__up").alias("up"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth")), "pointers")
        release(old)
    x = F.row_number().over(W.partitionBy("conv_id", "depth").orderBy("ord")) - 1
    return nodes.join(now.select("conv_id", "id", "depth"), ["conv_id", "id"]).withColumn("x", x)


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent IS NOT NULL").select("conv_id", F.col("parent").alias("source"), F.col("id").alias("target"))


def reduce_events(events: DataFrame) -> DataFrame:
    """State per conversation from events (conv_id, at, seq, type, payload): lists of transcript, signal and graph events in order, the last of every other kind."""
    last = lambda t: F.max_by(F.when(F.col("type") == t, F.col("payload")), F.when(F.col("type") == t, F.struct("at", "seq")))
    every = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("at", "seq", "payload")))), lambda e: e["payload"])
    kinds = [every(t).alias(n) for t, n in (("transcript", "transcript"), ("signal", "signals"), ("graph_node", "nodes"))]
    return events.groupBy("conv_id").agg(*kinds, *[last(t).alias(t) for t in ("stage", dims.PATTERN_EVENT, dims.PREDICTION_EVENT, "privacy", "risk", dims.PAUSE_EVENT)])


def replay(events: DataFrame, speed: float = 1.0) -> DataFrame:
    """events with due_ms, when a player at this speed shows them."""
    return events.withColumn("due_ms", F.col("at") / F.lit(float(speed)))
