"""The whole analysis as a stream: turns in, transcript, privacy, signal, stage, pattern and prediction events out.

Three queries, each exactly once from its own checkpoint, follow each other through folders of Parquet:

- ``turns``: redaction and extraction in the JVM, then one state per conversation (clock, totals, evidence, first signals);
  its events, and for each turn a ``live`` row with the fingerprint so far;
- ``predicted``: the live rows of a micro-batch meet patterns and model with the batch plan's own operators, whatever the
  library's size;
- ``shown``: pattern and prediction events, where they differ enough from the last ones of their conversation.

A conversation's state is a few arrays, bounded by the number of signals and stages, and never expires. Turns of a
conversation come in order; inside a micro-batch they are sorted. Null texts have no signals; ids are
strings here, and a null one is one conversation; rows that repeat a turn are turns of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import dims
from ..functions.privacy import redact
from ..functions.sequences import percent
from ..operators import extract, folds, markov, patterns
from ..plans import session
from ..sources.stage import new_folder, release, staged
from .session import _rocksdb, advance

LIVE = "live"
KEYS = "conv_id string, turn_idx int, at long, seq int, type string"
TURN_OUT = KEYS + ", speaker string, text string, detected long, label string, severity string, evidence string, stage_idx int, progress double, reason string, signals array<string>, slot long"
TURN_STATE = "at long, pii long, own array<double>, asks array<double>, pressured boolean, stage int, progress double, signals array<string>, tops array<double>, reasons array<string>"
PREDICTED = "conv_id string, turn_idx int, slot long, pattern string, matchPct int, incidents long, next string, confidence int, evidence_list array<string>"
SHOWN_OUT = KEYS + ", matchPct int, pattern string, incidents long, next string, confidence int, evidence_list array<string>"
SHOWN_STATE = "pattern string, pct int, next string, confidence int"


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows in the schema's columns; what a row lacks is null."""
    names = [f.split()[0] for f in schema.split(", ")]
    return pd.DataFrame([[r.get(c) for c in names] for r in rows], columns=names, dtype=object)


class TurnProcessor(StatefulProcessor):
    """State of a conversation after each turn, and what the turn shows."""

    def __init__(self, gate: bool = True) -> None:
        self.gate = gate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("conversation", TURN_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, n = self.state.get(), len(dims.STAGES)
        at, pii, *sums = known if known is not None else (0, 0, [0.0] * n, [0.0] * n, False, -1, 0.0, [], [], [None] * n)
        held, (signals, tops, reasons) = tuple(sums[:5]), map(list, sums[5:])
        out = []
        for t in pd.concat(list(rows)).sort_values("turn_idx", kind="stable").itertuples():
            at = int(at) + dims.TURN_GAP_MS if pd.isna(t.at_ms) else int(t.at_ms)
            show = lambda after, seq, kind, **more: out.append({"conv_id": key[0], "turn_idx": int(t.turn_idx), "at": at + after, "seq": seq, "type": kind, **more})  # noqa: E731, B023
            show(0, 0, "transcript", speaker=t.speaker, text=t.text)
            pii += int(t.n_pii)
            if t.n_pii:
                show(10, 1, "privacy", detected=pii)
            shown, hits = 0, sorted(zip(t.signals, t.evidences, t.confidences))
            for signal, quote, confidence in hits:
                _, stage, _, severity, label, _ = dims.SIGNALS[signal]
                if signal not in signals or severity == "critical":
                    show(100 + 50 * shown, 2 + shown, "signal", label=label, severity=severity, evidence=quote)
                    shown += 1
                if signal in signals:
                    tops[signals.index(signal)] = max(tops[signals.index(signal)], float(confidence))
                else:
                    signals.append(signal)
                    tops.append(float(confidence))
                if stage and reasons[dims.STAGES.index(stage)] is None:
                    reasons[dims.STAGES.index(stage)] = quote
            free = 100 + 50 * shown
            held, event = advance(held, [(s, c) for s, _, c in hits], self.gate) if hits else (held, None)
            if event:
                show(free, 90, "stage", stage_idx=int(event[0]), progress=float(event[1]), reason=reasons[event[0]])
                free += 50
            show(0, 0, LIVE, signals=list(signals), slot=at + free)
        own, asks, pressured, stage, progress = held
        self.state.update((at, pii, [float(x) for x in own], [float(x) for x in asks], bool(pressured), int(stage), float(progress), signals, tops, reasons))
        yield _frame(out, TURN_OUT)

    def close(self) -> None:
        pass


class ShownProcessor(StatefulProcessor):
    """Pattern and prediction events that differ from the last shown in name, or by the least step in value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("shown", SHOWN_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pattern, pct, step, confidence = self.state.get() or (None, 0, None, 0)
        out = []
        for t in pd.concat(list(rows)).sort_values("turn_idx", kind="stable").itertuples():
            base, at = {"conv_id": key[0], "turn_idx": int(t.turn_idx)}, int(t.slot)
            if not pd.isna(t.pattern) and (pattern != t.pattern or abs(t.matchPct - pct) >= dims.DNA_STEP):
                pattern, pct = t.pattern, int(t.matchPct)
                out.append(base | {"at": at, "seq": 91, "type": dims.PATTERN_EVENT, "matchPct": pct, "pattern": pattern, "incidents": None if pd.isna(t.incidents) else int(t.incidents)})
                at += 50
            if not pd.isna(t.next) and t.confidence >= dims.MIN_CONFIDENCE and (step != t.next or abs(t.confidence - confidence) >= dims.PREDICTION_STEP):
                step, confidence = t.next, int(t.confidence)
                out.append(base | {"at": at, "seq": 92, "type": dims.PREDICTION_EVENT, "next": step, "confidence": confidence, "evidence_list": list(t.evidence_list)})
        self.state.update((pattern, pct, step, confidence))
        if out:
            yield _frame(out, SHOWN_OUT)

    def close(self) -> None:
        pass


def turn_stream(turns: DataFrame, mode: str = "typed", extractor: str = "rules", gate: bool = True) -> DataFrame:
    """TURN_OUT of a stream of turns (conv_id, turn_idx, speaker, text, at_ms). Nothing after redaction sees a raw text."""
    t = redact(turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn_idx").cast("int").alias("turn_idx"), "speaker", "text", F.col("at_ms").cast("long").alias("at_ms")), "text", mode, "clean")
    t = t.select("conv_id", "turn_idx", "speaker", "at_ms", F.coalesce("n_pii", F.lit(0)).alias("n_pii"), F.col("clean").alias("text"))
    hits = F.col("event.manipulation_signals")
    t = extract.build_extractor(extractor)(t).select("conv_id", "turn_idx", "speaker", "text", "at_ms", "n_pii", hits["signal"].alias("signals"), hits["evidence"].alias("evidences"), hits["confidence"].alias("confidences"))
    return t.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=TurnProcessor(gate), outputStructType=TURN_OUT, outputMode="Append", timeMode="None")


def with_fingerprint(df: DataFrame, signals: str = "signals") -> DataFrame:
    """df with steps and tactics of its signals in order of first occurrence."""
    stepped = F.filter(signals, lambda s: dims.step_of(s).isNotNull())
    return df.withColumns({"steps": F.array_distinct(F.transform(stepped, dims.step_of)), "tactics": F.array_sort(stepped)})


def matched(live: DataFrame, library: session.Library) -> DataFrame:
    """Rows with steps and tactics, with their best pattern and next step."""
    m = patterns.best_match(live, library.patterns, ["conv_id"])
    return session._with_prediction(m, markov.predict(m, library.model))


def _write_predictions(library: session.Library, folder: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        """A batch that was written before is left as it is."""
        spark = batch.sparkSession
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{batch_id}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return
        live = staged(with_fingerprint(batch.select("conv_id", "turn_idx", "slot", "signals")), "live")
        enough = F.size("steps") >= 2
        name = F.when(F.col("novel"), session.NOVEL_NAME).otherwise(F.col("pattern_name"))
        incidents = F.when(F.col("novel"), F.lit(0).cast("long")).otherwise(F.col("members"))
        p = matched(live, library).select("conv_id", "turn_idx", "slot", F.when(enough, name).alias("pattern"), percent(F.col("match_score")).alias("matchPct"), incidents.alias("incidents"), "next", "confidence", F.col("evidence").alias("evidence_list"))
        p.filter("pattern IS NOT NULL OR next IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/{batch_id}")
        release(live)

    return write


def feed(turns: DataFrame, library: session.Library, folder: str, mode: str = "typed", extractor: str = "rules", gate: bool = True) -> DataFrame:
    """Takes in what has arrived on a stream of turns and returns all events so far, as session.events does.

    Everything is below ``folder``; called again with it, the next run goes on from the last one's state.
    """
    spark = turns.sparkSession
    spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/predicted/none").getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/predicted/none"))

    def run(stream: DataFrame, name: str, write=None) -> None:
        w = stream.writeStream.option("checkpointLocation", f"{folder}/state_{name}").outputMode("append").trigger(availableNow=True)
        w = w.foreachBatch(write) if write else w.format("parquet").option("path", f"{folder}/{name}")
        with _rocksdb(spark):
            w.start().awaitTermination()

    run(turn_stream(turns, mode, extractor, gate), "turns")
    run(spark.readStream.schema(TURN_OUT).parquet(f"{folder}/turns").filter(F.col("type") == LIVE), "predicted", _write_predictions(library, f"{folder}/predicted"))
    p = spark.readStream.schema(PREDICTED).parquet(f"{folder}/predicted/*")
    run(p.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=ShownProcessor(), outputStructType=SHOWN_OUT, outputMode="Append", timeMode="None"), "shown")
    return events(spark, folder)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """All events below a feed's folder, in the columns of session.events."""
    t = spark.read.schema(TURN_OUT).parquet(f"{folder}/turns").filter(F.col("type") != LIVE).drop("signals", "slot")
    privacy = lambda n: F.when(F.col("type") == "privacy", n)
    t = t.withColumns({"removed": F.col("detected"), "transmitted": privacy(F.lit(0).cast("long")), "stage": F.when(F.col("type") == "stage", dims.stage_name(F.col("stage_idx")))}).drop("stage_idx")
    s = spark.read.schema(SHOWN_OUT).parquet(f"{folder}/shown").withColumn("next", dims.step_label(F.col("next")))
    return t.unionByName(s, allowMissingColumns=True)


def state_snapshot(spark: SparkSession, folder: str, library: session.Library) -> DataFrame:
    """The state of every conversation of a running feed, read from its state store: the columns of session.snapshot that it shares."""
    s = spark.read.format("statestore").option("stateVarName", "conversation").load(f"{folder}/state_turns")
    s = staged(with_fingerprint(s.select("key.conv_id", "value.*")).withColumn("stage_idx", F.when(F.col("stage") >= 0, F.col("stage"))), "state")
    m = staged(matched(s.select("conv_id", "steps", "tactics"), library), "matched")
    hits = s.select("conv_id", F.inline(F.arrays_zip("signals", F.col("tops").alias("confidence")))).withColumnRenamed("signals", "signal")
    dna = m.select("conv_id", F.when(F.size("steps") >= 2, F.col("match_score")).otherwise(0.0).alias("dna_score"))
    score = folds.evidence_scores(hits, s.select("conv_id", "stage_idx"), dna)
    out = s.drop("steps", "tactics").join(m, "conv_id").join(score, "conv_id", "left")
    return out.select("conv_id", dims.stage_name(F.col("stage_idx")).alias("stage"), "progress", dims.step_code(F.col("steps")).alias("code"), "steps", "tactics", F.col("pattern_name").alias("pattern"), percent(F.col("match_score")).alias("match_pct"), "novel", "next", "confidence", F.coalesce("score", F.lit(0.0)).alias("evidence_score"), F.col("pii").alias("pii_detected"))


def replay(turns: DataFrame, library: session.Library, parts: int = 2, size: int = 4, folder: str | None = None, **how) -> DataFrame:
    """Events of a table of turns sent through the feed in parts of ``size`` turns, the last part with all that follow."""
    spark = turns.sparkSession
    table, base = staged(turns, "turns"), folder or new_folder(spark)
    for i in range(parts):
        low, high = i * size, (i + 1) * size if i < parts - 1 else 1 << 30
        table.filter((F.col("turn_idx") >= low) & (F.col("turn_idx") < high)).write.mode("append").parquet(f"{base}/in")
        out = feed(spark.readStream.schema(table.schema).parquet(f"{base}/in"), library, base, **how)
    return out
