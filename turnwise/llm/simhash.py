"""SimHash near-duplicate detection with pigeonring candidate filtering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import LOWER_MAP, ship, staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE, SEED, RADIUS, SEGMENTS, BITS = 3, 42, 3, 8, 64
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: bit set if set in over half of the XXH64 hashes of all word shingles, repeats included. No words: 0."""
    words = WORD.findall((text or "").translate(LOWER_MAP))
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [" ".join(words)]
    else:
        grams = map(" ".join, zip(*[words[i:] for i in range(shingle)]))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64)
    starts = np.arange(0, len(h), 255)  # sums of up to 255 bits fit the byte lanes of a word
    counts = np.empty((8, 8), dtype=np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts)
        counts[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts.ravel() > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def ring_masks(segments: int, bits: int = BITS) -> list[list[int]]:
    """masks[i][l-1]: the bits of the l consecutive segments from segment i, round the ring, as signed longs."""
    edges = [bits * i // segments for i in range(segments + 1)]
    one = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(segments)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return [[signed(reduce(int.__or__, (one[(i + t) % segments] for t in range(n)))) for n in range(1, segments + 1)] for i in range(segments)]


def _budget_ends(segments: int, radius: int) -> dict[int, int]:
    """The longest chain for each budget floor(radius * length / segments); shorter chains of that budget are implied."""
    return {radius * n // segments: n for n in range(1, segments + 1)}


def ring_keys(fp: Column, segments: int = SEGMENTS, radius: int = RADIUS) -> Column:
    """Join keys such that fingerprints within the radius share one.

    By the pigeonring principle some start has all its chains within their proportional budgets. The longest chain of
    budget 0 must then agree in full, and of the segments that the longest chain of budget 1 adds, all but one. So a key
    is a start, one added segment left out, and a hash of the other bits.
    """
    ends, masks, keys = _budget_ends(segments, radius), ring_masks(segments), []
    zero, one = ends.get(0, 0), ends.get(1, ends.get(0, 0))
    for i in range(segments):
        added = range(zero, one) or [None]
        for out in added:
            keep = (masks[i][one - 1] if one else 0) if out is None else masks[i][one - 1] ^ masks[(i + out) % segments][0]
            keys.append(F.xxhash64(F.lit(len(keys)), fp.bitwiseAND(F.lit(keep))))
    return F.array(*keys)


def ring_start(x: Column, segments: int = SEGMENTS, radius: int = RADIUS) -> Column:
    """Of the bits that differ, x: does any start keep each chain within its budget? Chains come before the full distance, so most candidates end early."""
    ends, masks = _budget_ends(segments, radius), ring_masks(segments)
    start = lambda i: reduce(lambda a, b: a & b, [F.bit_count(x.bitwiseAND(F.lit(masks[i][n - 1]))) <= budget for budget, n in sorted(ends.items())])
    return reduce(lambda a, b: a | b, [start(i) for i in range(segments)])


def near_pairs(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct values in fps.fp that differ in ``radius`` bits or fewer, once each."""
    keyed = staged(fps.select("fp", F.explode(F.array_distinct(ring_keys(F.col("fp"), segments, radius))).alias("key")), "keys")
    a, b = keyed.select(F.col("fp").alias("a"), "key"), keyed.select(F.col("fp").alias("b"), "key")
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.element_at(F.filter(F.arrays_zip(ring_keys(F.col("a"), segments, radius).alias("p"), ring_keys(F.col("b"), segments, radius).alias("q")), lambda z: z["p"] == z["q"]), 1)["p"]
    found = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & ring_start(x, segments, radius) & (F.bit_count(x) <= radius), "inner")
    return found.filter(a["key"] == first).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row of docs.

    Equal fingerprints are one class from the start, represented by their smallest id, so copies never pair with each
    other; classes link at ``radius`` or fewer differing bits, and a component's id is the smallest id reachable.
    Null and empty texts and texts of white space have fingerprint zero, linked like any other. Null ids get a
    fingerprint and their class's component but stand for no class; a class of null ids only has a null component. Rows
    with equal ids but other texts connect their classes. Other columns don't matter; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    fps = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")
    fps = staged(fps, "fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    pairs = near_pairs(classes.filter("first IS NOT NULL"), radius, segments)
    left, right = classes.select(F.col("fp").alias("a"), F.col("first").alias("u")), classes.select(F.col("fp").alias("b"), F.col("first").alias("v"))
    linked = pairs.join(left, "a").join(right, "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    shared = fps.groupBy("doc_id").agg(F.min("fp").alias("p"), F.max("fp").alias("q")).filter("doc_id IS NOT NULL AND p <> q")
    same_id = fps.join(shared.select("doc_id"), "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = components(linked.unionByName(same_id))
    classes = classes.join(found, classes["first"] == found["node"], "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    out = fps.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """The rows of docs, in all their columns, without near duplicates: of each component the document with the smallest id.

    Rows that repeat that id are one document and leave one row, the smallest by a hash of all columns, then of those
    equal in it any, for they are alike. Rows without an id can't be named as a duplicate; they stay. An empty table
    gives an empty table; other columns are kept as they are.
    """
    found = near_duplicates(docs, key, text, radius, segments)
    firsts = found.filter("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    kept = docs.join(firsts, key, "left_semi").select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    every = [F.col(n) for n in names.values()]
    order = F.struct(F.xxhash64(*every), F.xxhash64(F.lit("row"), *every))
    one = kept.groupBy(names[key]).agg(*[F.min_by(n, order).alias(n) for n in names.values() if n != names[key]])
    return one.select(*[F.col(n).alias(c) for c, n in names.items()]).unionByName(docs.filter(F.col(f"`{key}`").isNull()))
