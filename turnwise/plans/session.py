"""The whole analysis of conversations, from turns to output events, as one declarative plan.

turns -> clock -> redact -> extract -> hits -> windows and folds -> match and predict -> events. Everything per conversation
is partitioned by conv_id; patterns and the Markov model are small tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.privacy import redact
from ..functions.sequences import percent
from ..operators import extract, folds, markov, patterns
from ..sources.stage import staged

NOVEL_NAME = "Emerging variant (no close match)"


@dataclass
class Library:
    """incidents (conv_id, steps, tactics, family), patterns and the next-step model built on them."""

    incidents: DataFrame
    patterns: DataFrame
    model: DataFrame


def build_library(incidents: DataFrame, labels: dict[str, str] | None = None, threshold: float = dims.CLUSTER_AT) -> Library:
    """Clusters the distinct fingerprints of incidents, names the clusters by their families, trains the next-step model."""
    incidents = staged(incidents, "incidents")
    kinds = patterns.distinct_fingerprints(incidents)
    member = staged(patterns.clusters(kinds, threshold), "members")
    proto = patterns.medoids(kinds, member).join(kinds.select("code", "steps", "tactics"), "code").select("cluster", "steps", "tactics")
    coded = incidents.withColumn("code", F.concat_ws("|", dims.step_code(F.col("steps")), F.array_join("tactics", ","))).join(member, "code")
    hist = patterns.family_histogram(coded.select("cluster", "family"))
    first = coded.groupBy("cluster", "family").agg(F.min("conv_id").alias("first_seen"))
    named = patterns.named_patterns(hist.join(first, ["cluster", "family"]), proto, labels)
    return Library(incidents, staged(named, "patterns"), staged(markov.train(incidents), "model"))


@dataclass
class Analysis:
    turns: DataFrame
    hits: DataFrame
    evidence: DataFrame
    stages: DataFrame
    matched: DataFrame
    predicted: DataFrame


def analyse(turns: DataFrame, library: Library, mode: str = "typed", extractor: str = "rules", gate: bool = True) -> Analysis:
    """turns: conv_id, turn_idx, speaker, text, at_ms. Nothing after redaction sees a raw text.

    The redacted, extracted turns are what all else reads many times; they are staged, and so is the prediction.
    """
    t = redact(folds.clock_fill(turns), "text", mode, "clean")
    t = t.select("conv_id", "turn_idx", "speaker", "at", "n_pii", F.col("clean").alias("text"))
    t = staged(extract.build_extractor(extractor)(t), "turns")
    hits = extract.hits_of(t)
    evidence = folds.turn_evidence(hits, gate)
    stages = folds.progress_emissions(evidence)
    live = folds.running_fingerprints(t, hits)
    matched = staged(patterns.best_match(live, library.patterns, ["conv_id", "turn_idx"]), "matched")
    predicted = markov.predict(matched, library.model)
    return Analysis(t, hits, evidence, stages, matched, staged(_with_prediction(matched, predicted), "predicted"))


def _with_prediction(matched: DataFrame, predicted: DataFrame) -> DataFrame:
    """matched with the prediction for its distinct combination, joined on two hashes of that."""
    cols = ["steps", "match_score", "novel", "prototype", "pattern_name"]
    key = F.to_json(F.struct(*cols))  # names what isn't null
    hashes = F.struct(F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))
    p = predicted.select(hashes.alias("__key"), "next", "probability", "support", "order", "confidence", "evidence")
    return matched.select("*", F.explode(F.array(hashes)).alias("__key")).join(p, "__key", "left").drop("__key")


def events(a: Analysis) -> DataFrame:
    """conv_id, at, seq, type, and the fields of every kind, null where they don't apply.

    Inside a turn the shown signals come from 100 ms on, 50 ms apart; stage, pattern and prediction each take the next
    slot if they are shown.
    """
    t = a.turns
    shown = folds.emitted_signals(a.hits)
    n_shown = shown.groupBy("conv_id", "turn_idx").agg(F.count("*").alias("n_signals"))
    name = F.when(F.col("novel"), NOVEL_NAME).otherwise(F.col("pattern_name"))
    dna = a.predicted.filter(F.size("steps") >= 2).select("conv_id", "turn_idx", name.alias("pattern"), percent(F.col("match_score")).alias("matchPct"))
    dna = folds.emit_on_change(dna, "pattern", "matchPct", dims.DNA_STEP).withColumn("has_dna", F.lit(1))
    pred = a.predicted.filter(F.col("confidence") >= dims.MIN_CONFIDENCE).select("conv_id", "turn_idx", "next", "confidence")
    pred = folds.emit_on_change(pred, "next", "confidence", dims.PREDICTION_STEP).withColumn("has_pred", F.lit(1))
    stage = a.stages.withColumn("has_stage", F.lit(1))
    at = t.select("conv_id", "turn_idx", "at").join(n_shown, ["conv_id", "turn_idx"], "left").fillna(0, ["n_signals"])
    for part in (stage.select("conv_id", "turn_idx", "has_stage"), dna.select("conv_id", "turn_idx", "has_dna"), pred.select("conv_id", "turn_idx", "has_pred")):
        at = at.join(part, ["conv_id", "turn_idx"], "left")
    at = at.fillna(0, ["has_stage", "has_dna", "has_pred"])
    free = F.col("at") + 100 + 50 * F.col("n_signals")
    slots = at.select("conv_id", "turn_idx", free.alias("stage_at"), (free + 50 * F.col("has_stage")).alias("dna_at"), (free + 50 * (F.col("has_stage") + F.col("has_dna"))).alias("pred_at"))
    keys = ["conv_id", "turn_idx"]
    reasons = folds.stage_reasons(a.hits).withColumnRenamed("evidence", "reason")
    members = a.predicted.select(*keys, F.when(F.col("novel"), F.lit(0).cast("long")).otherwise(F.col("members")).alias("incidents"))
    out = [
        t.select(*keys, F.col("at").alias("at"), F.lit(0).alias("seq"), F.lit("transcript").alias("type"), "speaker", "text"),
        folds.privacy_totals(t).select(*keys, (F.col("at") + 10).alias("at"), F.lit(1).alias("seq"), F.lit("privacy").alias("type"), F.col("detected").cast("long").alias("detected"), F.col("detected").cast("long").alias("removed"), F.lit(0).cast("long").alias("transmitted")),
        shown.select(*keys, F.col("event_at").alias("at"), (F.col("k") + 2).alias("seq"), F.lit("signal").alias("type"), "label", "severity", "evidence"),
        stage.join(slots, keys).join(reasons, ["conv_id", "stage_idx"], "left").select(*keys, F.col("stage_at").alias("at"), F.lit(90).alias("seq"), F.lit("stage").alias("type"), dims.stage_name(F.col("stage_idx")).alias("stage"), "progress", "reason"),
        dna.join(slots, keys).join(members, keys, "left").select(*keys, F.col("dna_at").alias("at"), F.lit(91).alias("seq"), F.lit(dims.PATTERN_EVENT).alias("type"), "matchPct", "pattern", "incidents"),
        pred.join(slots, keys).join(a.predicted.select(*keys, F.col("evidence").alias("evidence_list")), keys, "left").select(*keys, F.col("pred_at").alias("at"), F.lit(92).alias("seq"), F.lit(dims.PREDICTION_EVENT).alias("type"), dims.step_label(F.col("next")).alias("next"), "confidence", "evidence_list"),
    ]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), out)


def snapshot(a: Analysis, mode: str = "typed") -> DataFrame:
    """The state after the last turn, one row per conversation: stage, progress, fingerprint, match, prediction, evidence score, privacy."""
    last = a.predicted.groupBy("conv_id").agg(F.max_by(F.struct("steps", "tactics", "pattern_id", "pattern_name", "match_score", "novel", "next", "probability", "support", "confidence", "evidence"), "turn_idx").alias("l"))
    stage = a.stages.groupBy("conv_id").agg(F.max("stage_idx").alias("stage_idx"), F.max("progress").alias("progress"))
    scores = a.evidence.groupBy("conv_id").agg(*[F.bround(F.max_by(f"score_{i}", "turn_idx"), 3).alias(f"score_{s}") for i, s in enumerate(dims.STAGES)])
    dna = last.select("conv_id", F.when(F.size("l.steps") >= 2, F.col("l.match_score")).otherwise(0.0).alias("dna_score"))
    score = folds.evidence_scores(a.hits, stage.select("conv_id", "stage_idx"), dna)
    pii = a.turns.groupBy("conv_id").agg(F.sum("n_pii").cast("long").alias("pii_detected"))
    out = last.join(stage, "conv_id", "left").join(scores, "conv_id", "left").join(score, "conv_id", "left").join(pii, "conv_id")
    return out.select("conv_id", dims.stage_name(F.col("stage_idx")).alias("stage"), F.coalesce("progress", F.lit(0.0)).alias("progress"), dims.step_code(F.col("l.steps")).alias("code"), F.col("l.steps").alias("steps"), F.col("l.tactics").alias("tactics"), F.col("l.pattern_id").alias("pattern_id"), F.col("l.pattern_name").alias("pattern"), percent(F.col("l.match_score")).alias("match_pct"), F.col("l.novel").alias("novel"), F.col("l.next").alias("next"), F.col("l.confidence").alias("confidence"), F.col("l.probability").alias("probability"), F.col("l.support").alias("support"), F.col("l.evidence").alias("evidence"), F.coalesce("score", F.lit(0.0)).alias("evidence_score"), "pii_detected", F.lit(0).cast("long").alias("pii_transmitted"), F.lit(mode).alias("mode"), *[F.col(f"score_{s}") for s in dims.STAGES])
