"""What the text classifiers share: the labelled sample, and scoring of whole tables with a broadcast model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_bucket, ship


#: Texts of more bytes than the first aren't in a fit's sample, and all its texts together have at most about the second.
FIT_TEXT_BYTES, FIT_BYTES = 1 << 20, 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, of: int, rows: int, key: str = "doc_id", text: str = "text", text_bytes: int = FIT_TEXT_BYTES, total_bytes: int = FIT_BYTES) -> list[tuple[str | None, int]]:
    """(text, 0 or 1) of at most ``rows`` labelled documents outside the held-out fold, in the order of a hash of the id.

    The bound is drawn from the small label table, so only its documents' texts reach the driver: one for each id (the
    smallest by a hash, if rows repeat an id), none of more than ``text_bytes`` bytes, and as many as fit
    ``total_bytes``, so what the driver holds doesn't depend on the table. Sizes decide first, on numbers alone; texts
    are read for the rows that they chose. Null ids and labels don't count; of several
    labels of one id the smallest counts.
    """
    ids = labels.select(F.col(key).alias("__id"), F.col(label).cast("int").alias("__y")).filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1))
    ids = ids.filter(crc_bucket(F.col("__id"), of) != fold).groupBy("__id").agg(F.min("__y").alias("__y"))
    ids = ids.orderBy(F.xxhash64("__id", F.lit(11)), "__id").limit(rows)
    texts = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    texts = texts.withColumns({"__size": F.coalesce(F.octet_length("__text"), F.lit(0)), "__hash": F.xxhash64("__text")})
    sizes = texts.drop("__text").join(F.broadcast(ids), "__id").filter(F.col("__size") <= text_bytes)
    sizes = sizes.groupBy("__id", "__y").agg(F.min(F.struct("__hash", "__size")).alias("m")).select("__id", "__y", "m.*")
    by = [F.xxhash64("__id", F.lit(11)), F.col("__id")]
    chosen = sizes.withColumn("__bytes", F.sum("__size").over(W.orderBy(*by))).filter(F.col("__bytes") <= total_bytes).drop("__bytes", "__size")
    found = texts.drop("__size").join(F.broadcast(chosen), ["__id", "__hash"]).groupBy("__id", "__y").agg(F.min("__text").alias("__text"))
    return [(r["__text"], r["__y"]) for r in found.orderBy("__id").select("__text", "__y").collect()]


def _scored(docs: DataFrame, make: Callable[[], Callable[[str | None], float]], fold: int, of: int, threshold: float, key: str, text: str, keep: list[str]) -> DataFrame:
    """doc_id, held_out, score and predicted, then the kept columns: text as ``text``, the others as c0, c1 and so on.

    ``make`` runs once in each task and gives the scorer of one text. Each row is scored by itself: no shuffle.
    """
    ship(docs.sparkSession)
    held = F.coalesce(crc_bucket(F.col(f"`{key}`"), of) == fold, F.lit(False))
    others = [c for c in keep if c != text]
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), held.alias("held_out"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    names = ["doc_id", "held_out", "score", "predicted", *(["text"] if keep else []), *[f"c{i}" for i in range(len(others))]]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            s = np.fromiter((score(t.as_py()) for t in b.column(2)), dtype=np.float64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *b.columns[3 - bool(keep) :]], names)

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields} | {"score": "double", "predicted": "int"}
    return rows.mapInArrow(scored, ", ".join(f"`{n}` {types[n]}" for n in names))


def judged(docs: DataFrame, make: Callable, fold: int, of: int, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs."""
    return _scored(docs, make, fold, of, threshold, key, text, [])


def passed(docs: DataFrame, make: Callable, fold: int, of: int, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, in their own columns, whose score reaches the threshold."""
    others = [c for c in docs.columns if c != text]
    out = _scored(docs, make, fold, of, threshold, key, text, docs.columns).filter("predicted = 1")
    return out.select(*[F.col("text" if c == text else f"c{others.index(c)}").alias(c) for c in docs.columns])
