"""Variable-order Markov model of workflow steps with back-off, and the next-step prediction built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.sequences import first_unseen

END = "END"


def train(sequences: DataFrame, order_by: str = "conv_id", max_order: int = dims.MAX_ORDER) -> DataFrame:
    """ctx (joined by >), k, nxt, n, first_seen from sequences (order_by, steps): how often each next step or END follows each context of 1 to max_order steps.

    Sequences are first reduced to distinct ones with a count, so the explosion doesn't see every conversation.
    """
    kinds = sequences.groupBy("steps").agg(F.count("*").alias("m"), F.min(F.col(order_by).cast("string")).alias("f"))
    toks = F.concat("steps", F.array(F.lit(END)))
    spots = kinds.select("m", "f", toks.alias("t"), F.posexplode(toks).alias("i", "nxt"))
    ctx = spots.select("m", "f", "i", "nxt", "t", F.explode(F.sequence(F.lit(1), F.lit(max_order))).alias("k")).filter("i >= k")
    ctx = ctx.withColumn("ctx", F.array_join(F.slice("t", F.col("i") - F.col("k") + 1, F.col("k")), ">"))
    seen = F.concat_ws("#", "f", F.lpad(F.col("i").cast("string"), 6, "0"))
    return ctx.groupBy("ctx", "k", "nxt").agg(F.sum("m").alias("n"), F.min(seen).alias("first_seen"))


def backoff(live: DataFrame, model: DataFrame, min_support: int = dims.MIN_SUPPORT, max_order: int = dims.MAX_ORDER) -> DataFrame:
    """For each distinct live step list: key (joined by >), steps, k and ctx of the longest known context with enough support, its rows nxt, n, first_seen and its total."""
    totals = model.groupBy("ctx", "k").agg(F.sum("n").alias("total")).filter(F.col("total") >= min_support)
    kinds = live.select("steps").distinct().withColumn("key", F.array_join("steps", ">"))
    suffix = kinds.select("key", "steps", F.explode(F.sequence(F.lit(1), F.lit(max_order))).alias("k")).filter(F.size("steps") >= F.col("k"))
    suffix = suffix.withColumn("ctx", F.array_join(F.slice("steps", F.size("steps") - F.col("k") + 1, F.col("k")), ">"))
    longest = suffix.join(totals, ["ctx", "k"]).groupBy("key", "steps").agg(F.max(F.struct("k", "ctx", "total")).alias("b")).select("key", "steps", "b.k", "b.ctx", "b.total")
    return longest.join(model, ["ctx", "k"])


def confidence(probability: Column, support: Column) -> Column:
    return F.bround(100 * probability * F.least(F.lit(1.0), F.sqrt(support / F.lit(float(dims.FULL_SUPPORT))))).cast("int")


def predict(live: DataFrame, model: DataFrame) -> DataFrame:
    """Next-step prediction for live rows (steps, match_score, novel, prototype, pattern_name), one per distinct combination.

    Returns those columns with next, probability (3 dp), support, order, confidence, and evidence sentences. Candidates
    are steps not yet seen; END counts in the total. A matched pattern's first unseen step gets a bonus of half the total,
    scaled by the match. Without candidates there is no row.
    """
    cols = ["steps", "match_score", "novel", "prototype", "pattern_name"]
    kinds = live.select(*cols).distinct().withColumn("key", F.array_join("steps", ">")).filter(F.size("steps") > 0)
    dist = backoff(kinds, model)
    per = dist.groupBy("key").agg(F.max("k").alias("order"), F.max("total").alias("all"), F.collect_list(F.struct("first_seen", "nxt", "n")).alias("d"))
    j = kinds.join(per, "key", "left").withColumn("d", F.array_sort(F.coalesce("d", F.array().cast("array<struct<first_seen:string,nxt:string,n:bigint>>"))))
    j = j.withColumn("proto_next", F.when(~F.col("novel"), first_unseen(F.col("prototype"), F.col("steps"))))
    alive = F.filter("d", lambda x: ~F.array_contains(F.col("steps"), x["nxt"]))
    j = j.withColumn("alive", alive).withColumn("base", F.aggregate("alive", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    bonus = F.when(F.col("proto_next").isNotNull(), F.greatest(F.lit(1).cast("long"), F.floor(F.col("base") * 0.5 * F.col("match_score")))).otherwise(F.lit(0).cast("long"))
    j = j.withColumn("bonus", bonus)
    mine = F.transform(F.filter("alive", lambda x: x["nxt"] != END), lambda x, i: F.struct((x["n"] + F.when(x["nxt"] == F.col("proto_next"), F.col("bonus")).otherwise(F.lit(0).cast("long"))).alias("n"), (-i).alias("o"), x["nxt"].alias("nxt")))
    j = j.withColumn("cand", mine)
    extra = F.when(F.col("proto_next").isNotNull() & ~F.exists("cand", lambda x: x["nxt"] == F.col("proto_next")), F.array(F.struct(F.col("bonus").alias("n"), F.lit(-99).alias("o"), F.col("proto_next").alias("nxt")))).otherwise(F.array().cast("array<struct<n:bigint,o:int,nxt:string>>"))
    j = j.withColumn("best", F.array_max(F.concat("cand", extra))).filter("best IS NOT NULL")
    total = F.col("base") + F.col("bonus")
    order = F.coalesce("order", F.lit(0))
    p = F.when(total > 0, F.col("best.n") / total).otherwise(F.lit(0.0))
    j = j.withColumns({"next": F.col("best.nxt"), "probability": F.bround(p, 3), "support": total, "order": order, "confidence": confidence(F.bround(p, 3), total)})
    names = lambda steps: F.array_join(F.transform(steps, lambda s: F.lower(dims.step_label(s))), " → ")
    observed = F.coalesce(F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + F.when(x["nxt"] == F.col("next"), x["n"]).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"))
    tail = F.slice("steps", F.greatest(F.size("steps") - F.col("order") + 1, F.lit(1)), F.greatest(F.col("order"), F.lit(1)))
    after = F.when(F.col("order") > 0, F.concat(F.lit("After "), names(tail), F.lit(": "), observed, F.lit("/"), F.col("all"), F.lit(" known incidents went to "), F.lower(dims.step_label(F.col("next")))))
    matched = F.when(F.col("proto_next").isNotNull(), F.concat(F.lit("Matched pattern '"), "pattern_name", F.lit("' continues with "), F.lower(dims.step_label(F.col("proto_next")))))
    return j.withColumn("evidence", F.array_compact(F.array(after, matched))).select(*cols, "next", "probability", "support", "order", "confidence", "evidence")


def ranked_next(live: DataFrame, model: DataFrame, top: int = 3) -> DataFrame:
    """key, rank, nxt, n: unseen next steps of each live list by count, first seen first on ties."""
    d = backoff(live, model).filter((F.col("nxt") != END) & ~F.array_contains(F.col("steps"), F.col("nxt")))
    r = F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "first_seen"))
    return d.withColumn("rank", r).filter(F.col("rank") <= top).select("key", "rank", "nxt", "n")


def prefixes(sequences: DataFrame) -> DataFrame:
    """Each proper prefix of each distinct sequence with the step that followed and how often: steps, gold, n."""
    kinds = sequences.groupBy("steps").agg(F.count("*").alias("n")).filter(F.size("steps") > 1)
    return kinds.select("n", F.col("steps").alias("s"), F.explode(F.sequence(F.lit(1), F.size("steps") - 1)).alias("k")).select(F.slice("s", 1, F.col("k")).alias("steps"), F.get("s", F.col("k")).alias("gold"), "n")
