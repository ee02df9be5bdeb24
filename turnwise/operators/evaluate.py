"""Evaluation aggregates: confusion counts, precision and recall, rank AUROC, quantiles, thresholds, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims
from .ranks import running

AXES = ("family", "lang", "brand", "channel")


def confusion_counts(turns: DataFrame, gold: str = "gold", predicted: str = "predicted", group: str = "lang") -> DataFrame:
    """signal, group, tp, fp, fn per signal, per group and in total (null: all), from turns with two signal arrays.

    One pass: signals on either side are exploded, never all fourteen, and grouping sets sum them up.
    """
    both = F.array_union(gold, predicted)
    rows = turns.select(group, F.explode(both).alias("signal"), gold, predicted)
    rows = rows.withColumns({"g": F.array_contains(gold, F.col("signal")), "p": F.array_contains(predicted, F.col("signal"))})
    count = lambda c, n: F.sum(c.cast("long")).alias(n)
    return rows.groupingSets([["signal"], [group], []], "signal", group).agg(count(F.col("g") & F.col("p"), "tp"), count(~F.col("g") & F.col("p"), "fp"), count(F.col("g") & ~F.col("p"), "fn"))


def prf(counts: DataFrame) -> DataFrame:
    """counts with p, r and f1, rounded to 3 places from unrounded values, and support; zero where undefined."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.withColumns({"p": F.bround(p, 3), "r": F.bround(r, 3), "f1": F.bround(f1, 3), "support": (F.col("tp") + F.col("fn")).cast("long")})


def macro_f1(per_signal: DataFrame) -> DataFrame:
    """Mean of the rounded f1 of signals with gold support."""
    return per_signal.filter("support > 0").agg(F.coalesce(F.bround(F.avg("f1"), 3), F.lit(0.0)).alias("macro_f1"))


def accuracy(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One column of the share of equal values for each pair; two nulls are equal."""
    return rows.agg(*[F.bround(F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")), 3).alias(n) for n, (a, b) in pairs.items()])


def _with_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their group; null is a group."""
    named = groups.withColumnsRenamed({c: f"__{c}" for c in by})
    return rows.join(named, reduce(lambda a, b: a & b, [rows[c].eqNullSafe(named[f"__{c}"]) for c in by])).drop(*[f"__{c}" for c in by])


def _running_by(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of ``value`` over the rows of their group before them: one running sum over all groups, less what a group begins with, so no group is one task's work."""
    out = running(rows, [*map(F.col, by), F.col(order)], {name: F.col(value)})
    if not by:
        return out
    out = _with_groups(out, out.groupBy(*by).agg(F.min(name).alias("__first")), by)
    return out.withColumn(name, F.col(name) - F.col("__first")).drop("__first")


def auroc(rows: DataFrame, score: str = "score", positive: str = "positive", by: list[str] | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in which the positive scores higher, ties half; NaN if a side is empty.

    Equal scores are first counted together, so the running sums see one row per distinct score and no pair is formed.
    """
    by = by or []
    one = lambda c: F.sum(c.cast("long"))
    per = rows.groupBy(*by, score).agg(one(F.col(positive)).alias("np"), one(~F.col(positive)).alias("nn"))
    per = _running_by(per, by, score, "nn", "below")
    agg = per.withColumn("wins", F.col("np") * (F.col("below") + F.col("nn") / 2)).groupBy(*by).agg(F.sum("wins").alias("w"), F.sum("np").alias("p"), F.sum("nn").alias("n"))
    return agg.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).otherwise(F.lit(float("nan"))).alias("auroc"))


def at_rank(rows: DataFrame, value: str, index: Column, by: list[str] | None = None) -> DataFrame:
    """The value at a 0-based rank given as an expression of ``n``, by cumulative counts of distinct values."""
    by = by or []
    per = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    per = _running_by(per, by, value, "c", "ahead")
    if by:
        per = _with_groups(per, per.groupBy(*by).agg(F.sum("c").alias("n")), by)
    else:
        per = per.crossJoin(F.broadcast(per.agg(F.sum("c").alias("n"))))  # one row
    hit = per.withColumn("i", index).filter((F.col("i") < F.col("ahead") + F.col("c")) & (F.col("i") >= F.col("ahead")))
    return hit.select(*by, F.col(value).alias("value"), "n")


def nearest_rank(rows: DataFrame, value: str, p: float, by: list[str] | None = None) -> DataFrame:
    """sorted[min(n - 1, int(p n))], rounded to 2 places."""
    out = at_rank(rows, value, F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))), by)
    return out.select(*(by or []), F.bround("value", 2).alias("quantile"))


def fpr_threshold(rows: DataFrame, score: str = "score", positive: str = "positive", share: float = 0.95) -> DataFrame:
    """The negatives' score at rank int(share (n - 1)): one row; 0 without negatives."""
    t = at_rank(rows.filter(~F.col(positive)), score, F.floor(F.lit(share) * (F.col("n") - 1)))
    return t.agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("threshold"))


def recall_at_fpr(rows: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """threshold, recall strictly above it, share of positives and of negatives with any score."""
    t = fpr_threshold(rows, score, positive)
    share = lambda cond, who: F.bround(F.avg(F.when(who, cond.cast("double"))), 3)
    p, s = F.col(positive), F.col(score)
    return rows.crossJoin(F.broadcast(t)).agg(F.max("threshold").alias("threshold"), share(s > F.col("threshold"), p).alias("recall"), share(s > 0, p).alias("positive_any"), share(s > 0, ~p).alias("negative_any"))


def mean_by_type(rows: DataFrame, kind: str = "type", score: str = "score", positive: str = "positive") -> DataFrame:
    key = F.concat(kind, F.when(F.col(positive), "+").otherwise("-"))
    return rows.groupBy(key.alias("key")).agg(F.bround(F.avg(score), 3).alias("mean_score"))


def step_recovery(rows: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """tp, fp, fn summed over the conversations' step sets."""
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long")
    return rows.agg(n(F.array_intersect(predicted, gold)).alias("tp"), n(F.array_except(predicted, gold)).alias("fp"), n(F.array_except(gold, predicted)).alias("fn"))


def early_warning(turns: DataFrame, stage: str = "stage_idx", next_step: str = "next", confidence: str = "confidence") -> DataFrame:
    """conv_id, warned_at: the first turn at compliance or beyond, or with a likely step to credentials or money; null if none."""
    hot = (F.col(stage) >= dims.STAGES.index("COMPLIANCE")) | (F.col(next_step).isin("CREDENTIALS", "TRANSFER") & (F.col(confidence) >= 50))
    return turns.groupBy("conv_id").agg(F.min(F.when(hot, F.col("turn_idx"))).alias("warned_at"))


def leave_one_out(rows: DataFrame, axis: str, value) -> tuple[DataFrame, DataFrame]:
    """(rows without the value, rows with it) on one of the four axes."""
    if axis not in AXES:
        raise ValueError(f"axis {axis!r} is none of {', '.join(AXES)}")
    return rows.filter(~F.col(axis).eqNullSafe(F.lit(value))), rows.filter(F.col(axis) == value)


def axis_values(rows: DataFrame, axis: str) -> DataFrame:
    return rows.select(axis).distinct().orderBy(axis)


def partition_corpus(convs: DataFrame, test_families: tuple[str, ...], order: str = "id", every: int = 10) -> DataFrame:
    """convs with ``part``: test for the named families; of the others in order every tenth is val, the rest train."""
    rest = ~F.col("family").isin(*test_families)
    out = running(convs, [F.col(order)], {"__i": rest.cast("long")})
    return out.withColumn("part", F.when(~rest, "test").when(F.col("__i") % every == 0, "val").otherwise("train")).drop("__i")


def hash_split(text: Column) -> Column:
    """dev or test by the parity of the text's SHA-1."""
    return F.when(F.conv(F.right(F.sha1(text.cast("binary")), F.lit(1)), 16, 10).cast("int") % 2 == 0, "dev").otherwise("test")


def dedupe_first_label(rows: DataFrame, text: str = "text", label: str = "label", order: str = "ord") -> DataFrame:
    """One row per trimmed text with the label that came first."""
    return rows.groupBy(F.trim(text).alias("text")).agg(F.min_by(label, order).alias("label"))


def balanced(rows: DataFrame, n: int, positive: str = "positive", order: str = "ord") -> DataFrame:
    """The first n/2 positives and the first n/2 negatives, each by a limit that tasks apply before anything is sorted together; null is neither."""
    first = lambda side: rows.filter(side).orderBy(order).limit(n // 2)
    is_positive = F.col(positive).cast("boolean")
    return first(is_positive).unionByName(first(~is_positive))


def multilabel_micro(rows: DataFrame, logits: str = "logits", gold: str = "gold") -> DataFrame:
    """Micro P, R and F1 of multi-hot labels against sigmoid(logits) > 0.5."""
    hit = F.zip_with(logits, gold, lambda x, y: F.struct((F.lit(1) / (1 + F.exp(-x)) > 0.5).alias("p"), (y == 1).alias("g")))
    flat = rows.select(F.inline(hit))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return prf(flat.agg(n(F.col("g") & F.col("p")).alias("tp"), n(~F.col("g") & F.col("p")).alias("fp"), n(F.col("g") & ~F.col("p")).alias("fn")))


def multi_hot(signals: Column) -> Column:
    """Fourteen 0/1 labels in the order of the signal table."""
    return F.array(*[F.array_contains(signals, s).cast("int") for s in dims.SIGNALS])


def misses(rows: DataFrame, n: int = 15, score: str = "score", positive: str = "positive", order: str = "ord") -> DataFrame:
    """The report's list of positives without any score: the first n."""
    return rows.filter(F.col(positive) & (F.col(score) == 0)).orderBy(order).limit(n)


def false_hits(rows: DataFrame, n: int = 10, score: str = "score", positive: str = "positive", order: str = "ord") -> DataFrame:
    """The report's list of the n highest-scored negatives."""
    return rows.filter(~F.col(positive)).orderBy(F.desc(score), order).limit(n)


def latency(turns: DataFrame, ms: str = "latency_ms") -> DataFrame:
    """conv_id, last, most, mean of the recorded milliseconds of each turn; nulls don't count."""
    return turns.filter(F.col(ms).isNotNull()).groupBy("conv_id").agg(F.max_by(ms, "turn_idx").alias("last"), F.max(ms).alias("most"), F.bround(F.avg(ms), 2).alias("mean"))
