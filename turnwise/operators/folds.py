"""Ordered folds over the turns of a conversation: clock, pressure, stage evidence, progress, fingerprints, emitted signals.

Everything is partitioned by conv_id. Where the fold has a closed form it is a window or an aggregate; only the two kinds
of hysteresis, which compare with what was last emitted, fold over a conversation's array of turns.

Inputs: turns (conv_id, turn_idx, at_ms nullable, ...) and hits (conv_id, turn_idx, signal, evidence, confidence).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.sequences import bigrams


def clock_fill(turns: DataFrame, gap: int = dims.TURN_GAP_MS) -> DataFrame:
    """turns with ``at``: the given time, or ``gap`` after the turn before; before any given time the clock starts at 0."""
    so_far = W.partitionBy("conv_id").orderBy("turn_idx").rowsBetween(W.unboundedPreceding, 0)
    i = F.row_number().over(W.partitionBy("conv_id").orderBy("turn_idx")) - 1
    t = turns.withColumn("__i", i)
    last = F.last(F.when(F.col("at_ms").isNotNull(), F.struct("at_ms", "__i")), ignorenulls=True).over(so_far)
    at = F.when(last.isNull(), F.lit(gap).cast("long") * (F.col("__i") + 1)).otherwise(last["at_ms"] + F.lit(gap).cast("long") * (F.col("__i") - last["__i"]))
    return t.withColumn("at", at.cast("long")).drop("__i")


def history_window(turns: DataFrame, n: int = 4) -> DataFrame:
    """turns with ``context``: the last n rendered lines before each turn, and ``prompt_context``, which says so where there are none."""
    before = W.partitionBy("conv_id").orderBy("turn_idx").rowsBetween(-n, -1)
    t = turns.withColumn("context", F.collect_list(F.concat(F.lit("["), "speaker", F.lit("] "), "text")).over(before))
    return t.withColumn("prompt_context", F.when(F.size("context") == 0, F.lit("(start of conversation)")).otherwise(F.array_join("context", "\n")))


#: Sums of evidence of a turn, or of a conversation so far, by stage: of what asks for something, and of the rest.
SUMS = [f"{kind}_{i}" for i in range(len(dims.STAGES)) for kind in ("own", "ask")]


def turn_evidence(hits: DataFrame, gate: bool = True, before: DataFrame | None = None) -> DataFrame:
    """Per turn with hits: pressured so far, score_0 to score_5 of the stages, reached stage index, or null, and its score.

    Asks count in part until the conversation has pressure and in full, retroactively, from then on; so a stage's score is
    its sum of other evidence so far plus its sum of asks so far times the factor that holds now.

    ``before`` has what conversations hold from earlier hits (``carried``). It stands ahead of their turns, as a row that isn't
    ``fresh``, so sums go on in the same order; those sums, and the stage and progress held, stay as columns.
    """
    full = F.greatest(dims.weight_of(F.col("signal")), F.lit(dims.MIN_WEIGHT)) * F.col("confidence")
    stage, ask = dims.stage_index_of(F.col("signal")), F.col("signal").isin(*dims.ASKS)
    parts = [F.sum(F.when((stage == i) & (ask == a), full).otherwise(0.0)).alias(f"{'ask' if a else 'own'}_{i}") for i in range(len(dims.STAGES)) for a in (False, True)]
    per_turn = hits.groupBy("conv_id", "turn_idx").agg(F.max(F.col("signal").isin(*dims.PRESSURE)).alias("pressure"), *parts)
    order = ["turn_idx"]
    if before is not None:
        per_turn = per_turn.withColumn("fresh", F.lit(True)).unionByName(before.select(*per_turn.columns, F.lit(False).alias("fresh"), "stage", "progress"), allowMissingColumns=True)
        order = ["fresh", "turn_idx"]
    so_far = W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    factor = F.when(F.max("pressure").over(so_far), F.lit(1.0)).otherwise(F.lit(dims.UNPRESSURED if gate else 1.0))
    held = [] if before is None else ["fresh", "stage", "progress", *[F.sum(c).over(so_far).alias(c) for c in SUMS]]
    scored = per_turn.select("conv_id", "turn_idx", F.max("pressure").over(so_far).alias("pressured"), *held, *[(F.sum(f"own_{i}").over(so_far) + F.sum(f"ask_{i}").over(so_far) * factor).alias(f"score_{i}") for i in range(len(dims.STAGES))])
    reached = F.greatest(*[F.when(F.col(f"score_{i}") >= dims.THRESHOLD, F.lit(i)) for i in range(len(dims.STAGES))])
    scored = scored.withColumn("reached", reached)
    return scored.withColumn("reached_score", reduce(lambda c, i: F.when(F.col("reached") == i, F.col(f"score_{i}")).otherwise(c), range(len(dims.STAGES)), F.lit(None).cast("double")))


def raw_progress(index: Column, score: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), (index + F.least(F.lit(1.0), score / dims.SATURATION)) / 6), 2)


def progress_emissions(evidence: DataFrame) -> DataFrame:
    """From turn_evidence to emitted stage events: conv_id, turn_idx, stage_idx, progress.

    A turn emits if it reaches a further stage than the last emitted one or its progress is PROGRESS_STEP or more beyond
    the last emitted; progress never falls. The fold runs over one conversation's turns that have reached a stage.
    """
    row = F.struct("turn_idx", F.col("reached").alias("stage_idx"), raw_progress(F.col("reached"), F.col("reached_score")).alias("progress"))
    seq = evidence.filter("reached IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    return seq.select("conv_id", F.inline(emissions(F.col("turns"), F.lit(-1), F.lit(0.0))["out"]))


def emissions(turns: Column, stage: Column, at: Column) -> Column:
    """Last emitted stage, its progress (``at``) and emitted events (``out``) after an array of turns (turn_idx, stage_idx, progress), from the stage and progress emitted before."""
    kind = "array<struct<turn_idx:int,stage_idx:int,progress:double>>"
    zero = F.struct(stage.alias("stage"), at.alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        p = F.greatest(t["progress"], acc["at"])
        emit = (t["stage_idx"] > acc["stage"]) | (p - acc["at"] >= dims.PROGRESS_STEP)
        new = F.struct(t["turn_idx"].cast("int").alias("turn_idx"), t["stage_idx"].cast("int").alias("stage_idx"), p.alias("progress"))
        return F.struct(F.when(emit, t["stage_idx"].cast("int")).otherwise(acc["stage"]).alias("stage"), F.when(emit, p).otherwise(acc["at"]).alias("at"), F.when(emit, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, zero, step)


def carried(evidence: DataFrame) -> DataFrame:
    """What each conversation holds after a part of its hits, from turn_evidence with ``before``: sums, pressure, last turn, last emitted stage and progress, and ``out``, the events of this part."""
    turn = F.struct("turn_idx", F.col("reached").alias("stage_idx"), raw_progress(F.col("reached"), F.col("reached_score")).alias("progress"))
    last = F.max_by(F.struct("turn_idx", F.col("pressured").alias("pressure"), *SUMS), F.struct("fresh", "turn_idx")).alias("last")
    held = F.max(F.when(~F.col("fresh"), F.struct("stage", "progress"))).alias("held")
    seq = evidence.groupBy("conv_id").agg(last, held, F.array_sort(F.collect_list(F.when(F.col("fresh") & F.col("reached").isNotNull(), turn))).alias("turns"))
    now = emissions(F.col("turns"), F.coalesce(F.col("held.stage"), F.lit(-1)), F.coalesce(F.col("held.progress"), F.lit(0.0)))
    return seq.withColumn("now", now).select("conv_id", "last.*", F.col("now.stage").alias("stage"), F.col("now.at").alias("progress"), F.col("now.out").alias("out"))


def stage_history(evidence: DataFrame) -> DataFrame:
    """conv_id, turn_idx, stage_idx of each advance."""
    so_far = W.partitionBy("conv_id").orderBy("turn_idx")
    best = F.max("reached").over(so_far.rowsBetween(W.unboundedPreceding, 0))
    before = F.max("reached").over(so_far.rowsBetween(W.unboundedPreceding, -1))
    return evidence.withColumns({"__now": best, "__before": before}).filter("__now > coalesce(__before, -1)").select("conv_id", "turn_idx", F.col("__now").alias("stage_idx"))


def stage_reasons(hits: DataFrame) -> DataFrame:
    """conv_id, stage_idx, evidence: the first hit of each stage, under its threshold or not."""
    h = hits.withColumn("stage_idx", dims.stage_index_of(F.col("signal"))).filter("stage_idx IS NOT NULL")
    return h.groupBy("conv_id", "stage_idx").agg(F.min_by("evidence", F.struct("turn_idx", "signal")).alias("evidence"))


def fingerprints(hits: DataFrame) -> DataFrame:
    """conv_id, steps in order of first occurrence, tactics sorted; safety advice is neither.

    Inside a turn signals come by name. Partial aggregation leaves at most one row for each of nine steps.
    """
    h = hits.withColumn("step", dims.step_of(F.col("signal"))).filter("step IS NOT NULL")
    firsts = h.groupBy("conv_id", "step").agg(F.min(F.struct("turn_idx", "signal")).alias("first"), F.collect_set("signal").alias("tactics"))
    out = firsts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "step"))).alias("s"), F.array_sort(F.flatten(F.collect_list("tactics"))).alias("tactics"))
    return out.select("conv_id", F.transform("s", lambda x: x["step"]).alias("steps"), "tactics")


def running_fingerprints(turns: DataFrame, hits: DataFrame) -> DataFrame:
    """conv_id, turn_idx, steps and tactics known after each turn."""
    h = hits.withColumn("step", dims.step_of(F.col("signal"))).filter("step IS NOT NULL")
    firsts = h.groupBy("conv_id", "signal").agg(F.min("turn_idx").alias("turn_idx"), F.first("step").alias("step"))
    per_conv = firsts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "signal", "step"))).alias("s"))
    t = turns.select("conv_id", "turn_idx").join(per_conv, "conv_id", "left").withColumn("s", F.coalesce(F.filter("s", lambda x: x["turn_idx"] <= F.col("turn_idx")), F.array().cast("array<struct<turn_idx:int,signal:string,step:string>>")))
    return t.select("conv_id", "turn_idx", F.array_distinct(F.transform("s", lambda x: x["step"])).alias("steps"), F.array_sort(F.transform("s", lambda x: x["signal"])).alias("tactics"))


def step_bigrams(fps: DataFrame) -> DataFrame:
    return fps.select("conv_id", F.explode(bigrams(F.col("steps"))).alias("bigram"))


def emitted_signals(hits: DataFrame, at: str = "at") -> DataFrame:
    """Hits that are shown: a signal's first in the conversation, and every critical one; with their place k in the turn and time."""
    first = F.row_number().over(W.partitionBy("conv_id", "signal").orderBy("turn_idx")) == 1
    h = hits.withColumns({"__first": first, "severity": dims.severity_of(F.col("signal")), "label": dims.label_of(F.col("signal"))}).filter(F.col("__first") | (F.col("severity") == "critical")).drop("__first")
    k = F.row_number().over(W.partitionBy("conv_id", "turn_idx").orderBy("signal")) - 1
    return h.withColumn("k", k).withColumn("event_at", F.col(at) + 100 + 50 * F.col("k"))


def evidence_scores(hits: DataFrame, reached: DataFrame, dna: DataFrame | None = None) -> DataFrame:
    """conv_id, score in 0..1: noisy-or of the signals' largest confidences, depth of the furthest stage, pattern match.

    reached: conv_id, stage_idx (furthest, or null); dna: conv_id, dna_score. Safety advice damps all three.
    """
    top = hits.groupBy("conv_id", "signal").agg(F.max("confidence").alias("c"))
    left = F.product(F.lit(1.0) - F.greatest(dims.weight_of(F.col("signal")), F.lit(0.0)) * F.col("c"))
    per = top.groupBy("conv_id").agg(left.alias("left"), F.max(F.col("signal") == "SAFETY_ADVICE").alias("safe")).join(reached, "conv_id", "left")
    per = per.join(dna, "conv_id", "left") if dna is not None else per.withColumn("dna_score", F.lit(0.0))
    score = F.when(F.col("safe"), F.lit(0.6)).otherwise(F.lit(1.0)) * (0.5 * (1 - F.col("left")) + 0.3 * F.coalesce(F.col("stage_idx"), F.lit(0)) / 5 + 0.2 * F.coalesce(F.col("dna_score"), F.lit(0.0)))
    return per.select("conv_id", F.bround(score, 4).alias("score"))


def emit_on_change(rows: DataFrame, name: str, value: str, step: int) -> DataFrame:
    """Rows (conv_id, turn_idx, name, value) that differ from the last emitted one in name, or by ``step`` or more in value."""
    seq = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", F.col(name).cast("string").alias("n"), F.col(value).cast("int").alias("v")))).alias("turns"))
    kind = "array<struct<turn_idx:int,n:string,v:int>>"
    zero = F.struct(F.lit(None).cast("string").alias("n"), F.lit(0).alias("v"), F.array().cast(kind).alias("out"))

    def fold(acc: Column, t: Column) -> Column:
        emit = acc["n"].isNull() | (acc["n"] != t["n"]) | (F.abs(t["v"] - acc["v"]) >= step)
        new = F.struct(t["turn_idx"].cast("int").alias("turn_idx"), t["n"].alias("n"), t["v"].alias("v"))
        return F.struct(F.when(emit, t["n"]).otherwise(acc["n"]).alias("n"), F.when(emit, t["v"]).otherwise(acc["v"]).alias("v"), F.when(emit, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"))

    out = seq.select("conv_id", F.inline(F.aggregate("turns", zero, fold)["out"]))
    return out.select("conv_id", "turn_idx", F.col("n").alias(name), F.col("v").alias(value))


def privacy_totals(turns: DataFrame, count: str = "n_pii") -> DataFrame:
    """Turns with personal data, and how much the conversation has had so far."""
    so_far = W.partitionBy("conv_id").orderBy("turn_idx").rowsBetween(W.unboundedPreceding, 0)
    return turns.withColumn("detected", F.sum(count).over(so_far)).filter(F.col(count) > 0)
