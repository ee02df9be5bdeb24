"""The state machine as a stream: per-conversation state that outlives micro-batches, kept as a table."""

from __future__ import annotations

from contextlib import contextmanager
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..operators import folds
from ..sources.stage import new_folder, staged

OUT = "conv_id string, turn_idx int, stage_idx int, progress double"
KEPT = "conv_id string, turn_idx int, pressure boolean, " + ", ".join(f"{c} double" for c in folds.SUMS) + ", stage int, progress double, out array<struct<turn_idx:int,stage_idx:int,progress:double>>"


def _places2(x: float) -> float:
    """Half-even on the decimal digits, as the batch plan's bround."""
    return float(Decimal(repr(float(x))).quantize(Decimal("0.01"), ROUND_HALF_EVEN))


def advance(state: tuple, hits: list[tuple[str, float]], gate: bool = True) -> tuple[tuple, tuple[int, float] | None]:
    """One turn: the new state (own sums, ask sums, pressured, stage, progress) and the emitted (stage, progress), if any."""
    own, asks, pressured, stage, progress = list(state[0]), list(state[1]), *state[2:]
    for signal, conf in hits:
        _, at, weight, *_ = dims.SIGNALS[signal]
        pressured = pressured or signal in dims.PRESSURE
        if at:
            (asks if signal in dims.ASKS else own)[dims.STAGES.index(at)] += max(weight, dims.MIN_WEIGHT) * conf
    factor = 1.0 if pressured or not gate else dims.UNPRESSURED
    scores = [a + b * factor for a, b in zip(own, asks)]
    reached = max((i for i, s in enumerate(scores) if s >= dims.THRESHOLD), default=None)
    out = None
    if reached is not None:
        p = max(_places2(min(1.0, (reached + min(1.0, scores[reached] / dims.SATURATION)) / 6)), progress)
        if reached > stage or p - progress >= dims.PROGRESS_STEP:
            stage, progress, out = reached, p, (reached, p)
    return (own, asks, pressured, stage, progress), out


def write_stages(folder: str):
    """A writer of micro-batches of hits (conv_id, turn_idx, signal, confidence): stage events to ``out``, what conversations hold to ``kept``.

    Both are tables below ``folder`` with a part for each micro-batch. A micro-batch goes on from what the last one kept,
    by the batch plan's own operators, so all of it runs in the JVM; it writes the state of all conversations anew, and the
    state before the last one goes. One that was written is left as it is, one that broke off starts from the same state:
    each event is there once. Turns of a conversation are put in order inside a micro-batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}")
        fs = path("out").getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path(f"out/{batch_id}/_SUCCESS")):
            return
        before = spark.read.schema(KEPT).parquet(f"{folder}/kept/{batch_id - 1}") if batch_id else spark.createDataFrame([], KEPT)
        before = before.withColumn("conv_id", F.col("conv_id").cast(batch.schema["conv_id"].dataType))
        folds.carried(folds.turn_evidence(batch, before=before)).withColumn("conv_id", F.col("conv_id").cast("string")).write.mode("overwrite").parquet(f"{folder}/kept/{batch_id}")
        spark.read.schema(KEPT).parquet(f"{folder}/kept/{batch_id}").select("conv_id", F.inline("out")).write.mode("overwrite").parquet(f"{folder}/out/{batch_id}")
        fs.delete(path(f"kept/{batch_id - 2}"), True)

    return write


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Extension: event-time sessions with a watermark: key, start, end, n."""
    w = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@contextmanager
def _rocksdb(spark: SparkSession):
    """The state store that these streams need, for queries that start inside; the session's own setting is back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def replay_stages(hits: DataFrame, parts: int = 3, turns: int = 3) -> DataFrame:
    """Stage events of a batch of hits sent through the stream in parts of ``turns`` turns, the last part with all that follow.

    Each part is written as it is partitioned and read by a run of the stream that goes on from the last one's state, so
    a conversation's turns come in order and no part passes through one task.
    """
    spark = hits.sparkSession
    table, base = staged(hits, "hits"), new_folder(spark)
    for i in range(parts):
        low, high = i * turns, (i + 1) * turns if i < parts - 1 else 1 << 30
        table.filter((F.col("turn_idx") >= low) & (F.col("turn_idx") < high)).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(table.schema).parquet(f"{base}/in")
        stream.writeStream.foreachBatch(write_stages(base)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{base}/out/*")
