"""The evaluation reports: extraction, held-out conversations, novelty by leaving families out, privacy against utility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims, privacy
from ..functions.sequences import fingerprint_similarity
from ..operators import evaluate, extract, folds, patterns
from ..sources.stage import if_small, staged
from . import datagen, session


def extraction(gold_turns: DataFrame, extractor: str = "rules", mode: str = "typed") -> dict[str, DataFrame]:
    """groups: p, r, f1 and support per signal, per language and in all; totals: turns, macro f1, action and stage accuracy, grounding rate.

    gold_turns: conv_id, turn_idx, speaker, text, lang, gold (an event). The extractor sees redacted texts.
    """
    t = privacy.redact(gold_turns.select("conv_id", "turn_idx", "speaker", "lang", "text", "gold"), "text", mode, "clean")
    t = t.select("conv_id", "turn_idx", "speaker", "lang", "gold", F.col("clean").alias("text"))
    t = staged(extract.build_extractor(extractor)(t), "extracted")
    names = lambda e: F.transform(f"{e}.manipulation_signals", lambda h: h["signal"])
    t = t.withColumns({"g": names("gold"), "p": names("event")})
    groups = evaluate.prf(evaluate.confusion_counts(t, "g", "p", "lang"))
    macro = evaluate.macro_f1(groups.filter("signal IS NOT NULL"))
    acc = t.agg(F.count("*").alias("turns"), F.bround(F.avg(F.expr("event.requested_action <=> gold.requested_action").cast("double")), 3).alias("action_accuracy"), F.bround(F.avg(F.expr("event.stage <=> gold.stage").cast("double")), 3).alias("stage_accuracy"))
    hits = t.select("text", F.inline("event.manipulation_signals"))
    found = F.contains(extract.normalise(F.col("text")), extract.normalise(F.col("evidence"))).cast("double")
    grounded = hits.agg(F.coalesce(F.bround(F.avg(found), 3), F.lit(1.0)).alias("grounding_rate"))
    return {"groups": groups, "totals": acc.crossJoin(macro).crossJoin(grounded)}


def conversations(convs: DataFrame, library: session.Library, extractor: str = "rules", mode: str = "typed") -> DataFrame:
    """One row per conversation of (conv_id, turn_idx, speaker, text, at_ms) turns: score, stage, pattern, match_pct, code, steps, warned_at."""
    a = session.analyse(convs, library, mode, extractor)
    current = F.max("reached").over(W.partitionBy("conv_id").orderBy("turn_idx").rowsBetween(W.unboundedPreceding, 0))
    per_turn = a.predicted.select("conv_id", "turn_idx", "next", "confidence").join(a.evidence.select("conv_id", "turn_idx", "reached"), ["conv_id", "turn_idx"], "left")
    warned = evaluate.early_warning(per_turn.withColumn("stage_idx", current))
    s = session.snapshot(a, mode).join(warned, "conv_id", "left")
    return s.select("conv_id", F.bround("evidence_score", 3).alias("score"), "stage", "pattern", "match_pct", "code", "steps", "warned_at")


def heldout(meta: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of held-out conversations: meta is conv_id, is_scam, novel_family, gold_steps, money_turn; scored as from ``conversations``."""
    size = lambda c: F.size(c)
    r = meta.join(scored, "conv_id").withColumn("gold_steps", F.coalesce("gold_steps", F.array().cast("array<string>")))
    r = r.withColumns({"step_tp": size(F.array_intersect("steps", "gold_steps")), "step_fp": size(F.array_except("steps", "gold_steps")), "step_fn": size(F.array_except("gold_steps", "steps"))})
    r = staged(r, "heldout")
    deep = F.coalesce(F.col("stage").isin("COMPLIANCE", "MONEY_MOVEMENT"), F.lit(False))
    scam, n = F.col("is_scam"), lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    counts = r.agg(F.count("*").alias("conversations"), n(scam).alias("scams"), n(~scam).alias("benign"), n(scam & (F.coalesce(F.col("warned_at") <= F.col("money_turn"), F.lit(False)))).alias("warned_by_money_turn"), n(~scam & deep).alias("benign_reaching_compliance"), n(scam & F.col("novel_family") & deep).alias("novel_detected"), n(scam & F.col("novel_family")).alias("novel"))
    steps = evaluate.prf(r.filter(scam).agg(*[F.coalesce(F.sum(f"step_{c}"), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])).select(F.col("p").alias("step_p"), F.col("r").alias("step_r"), F.col("f1").alias("step_f1"))
    auc = evaluate.auroc(r, "score", "is_scam").select(F.bround("auroc", 3).alias("detection_auroc"))
    return r, counts.crossJoin(steps).crossJoin(auc)


def leave_families_out(library: DataFrame, test: DataFrame, threshold: float = dims.CLUSTER_AT) -> tuple[DataFrame, DataFrame]:
    """(per family, summary): how well test fingerprints match a library without their family, against as many first ones of the other families.

    library and test: conv_id, steps, tactics, family. All libraries are built side by side, each under the family that it
    lacks; the pairs compared are of distinct fingerprints.
    """
    families = test.select(F.col("family").alias("excluded")).distinct()
    kinds = library.withColumn("kind", F.concat_ws("|", dims.step_code(F.col("steps")), F.array_join("tactics", ",")))
    per = kinds.join(if_small(families), F.col("family") != F.col("excluded")).groupBy("excluded", "kind").agg(F.first("steps").alias("steps"), F.first("tactics").alias("tactics"), F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))
    per = staged(per.withColumn("code", F.concat_ws("#", "excluded", "kind")), "kinds")
    member = patterns.clusters(per, threshold, "excluded").select("code", F.concat_ws("#", "excluded", F.col("cluster").cast("string")).alias("cluster"))
    proto = staged(patterns.medoids(per, member).join(per.select("code", "excluded", F.col("steps").alias("y"), F.col("tactics").alias("q")), "code").select("excluded", "y", "q"), "prototypes")
    n_held = test.groupBy("family").agg(F.count("*").alias("n_held")).withColumnRenamed("family", "excluded")
    held = test.select(F.col("family").alias("excluded"), "conv_id", "steps", "tactics", F.lit(True).alias("held"))
    others = test.join(if_small(n_held), F.col("family") != F.col("excluded"))
    first = F.row_number().over(W.partitionBy("excluded").orderBy("family", "conv_id"))
    known = others.withColumn("r", first).filter("r <= n_held").select("excluded", "conv_id", "steps", "tactics", F.lit(False).alias("held"))
    rows = held.unionByName(known)
    s = fingerprint_similarity(F.col("steps"), F.col("tactics"), F.col("y"), F.col("q"))
    scored = rows.join(proto, "excluded").groupBy("excluded", "conv_id", "held").agg(F.greatest(F.lit(0.0), F.max(s)).alias("score"))
    scored = staged(scored, "scored")
    by_family = scored.filter("held").groupBy(F.col("excluded").alias("family")).agg(F.bround(F.avg("score"), 3).alias("mean_match"))
    novelty = evaluate.auroc(scored.withColumn("novelty", 1 - F.col("score")), "novelty", "held").select(F.bround("auroc", 3).alias("novelty_auroc"))
    mean = lambda held: F.bround(F.avg(F.when(F.col("held") == held, F.col("score"))), 3)
    return by_family, scored.agg(mean(True).alias("mean_match_unseen"), mean(False).alias("mean_match_seen")).crossJoin(novelty)


def privacy_utility(gold_turns: DataFrame, meta: DataFrame, library: session.Library, extractor: str = "rules") -> DataFrame:
    """mode, pii_leak_rate, signal_micro_f1, detection_auroc, step_f1 for each way to redact. gold_turns also has pii and at_ms."""
    out = []
    for mode in privacy.MODES:
        r = privacy.redact(gold_turns, "text", mode)
        leak = r.agg(F.bround(F.coalesce(F.sum(F.size(privacy.leaked(F.col("pii"), F.col("redacted")))) / F.sum(F.size("pii")), F.lit(0.0)), 4).alias("pii_leak_rate"))
        micro = extraction(gold_turns, extractor, mode)["groups"].filter("signal IS NULL AND lang IS NULL").select(F.col("f1").alias("signal_micro_f1"))
        turns = gold_turns.select("conv_id", "turn_idx", "speaker", "text", "at_ms")
        held = heldout(meta, conversations(turns, library, extractor, mode))[1].select("detection_auroc", "step_f1")
        out.append(leak.crossJoin(micro).crossJoin(held).select(F.lit(mode).alias("mode"), "*"))
    return reduce(DataFrame.unionByName, out)


def compare(turns: DataFrame, meta: DataFrame, library: session.Library, extractors: list[str]) -> DataFrame:
    """The held-out summary of each extractor."""
    return reduce(DataFrame.unionByName, [heldout(meta, conversations(turns, library, e))[1].select(F.lit(e).alias("extractor"), "*") for e in extractors])


def teacher_labels(grounded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns whose grounding dropped nothing, counts kept and n) of turns with n_dropped."""
    return grounded.filter("n_dropped = 0"), grounded.agg(F.sum((F.col("n_dropped") == 0).cast("long")).alias("kept"), F.count("*").alias("n"))


def generated_meta(turns: DataFrame) -> DataFrame:
    """meta of generated conversations: their marked steps are the gold ones; the first request for credentials or money is the money turn."""
    hits = turns.select("conv_id", "turn_idx", F.inline("spans")).withColumn("confidence", F.lit(1.0))
    steps = folds.fingerprints(hits).select("conv_id", F.col("steps").alias("gold_steps"))
    money = hits.filter(dims.step_of(F.col("signal")).isin("CREDENTIALS", "TRANSFER")).groupBy("conv_id").agg(F.min("turn_idx").alias("money_turn"))
    per = turns.groupBy("conv_id").agg(F.first("is_scam").alias("is_scam"), F.first("family").alias("family"))
    return per.join(steps, "conv_id", "left").join(money, "conv_id", "left").select("conv_id", "family", "is_scam", F.lit(False).alias("novel_family"), "gold_steps", "money_turn")


def full_report(spark, per_family: int = 20, seed: int = 101, extractor: str = "rules") -> dict[str, DataFrame]:
    """Every report on generated conversations of one seed, with a library of another."""
    known = staged(datagen.incidents(datagen.turns(datagen.conversations(spark, 25, 7, None, 0.0), 7)), "known")
    lib = session.build_library(known, {f: v.label for f, v in datagen.FAMILIES.items()})
    t = staged(datagen.gold(datagen.turns(datagen.conversations(spark, per_family, seed), seed)), "test")
    ext, meta = extraction(t, extractor), staged(generated_meta(t), "meta")
    rows, summary = heldout(meta, conversations(t.select("conv_id", "turn_idx", "speaker", "text", "at_ms"), lib, extractor))
    unseen, novelty = leave_families_out(known, staged(datagen.incidents(t), "incidents"))
    return {"extraction_groups": ext["groups"], "extraction": ext["totals"], "heldout_rows": rows, "heldout": summary, "unseen_families": unseen, "novelty": novelty, "privacy_utility": privacy_utility(t, meta, lib, extractor)}
