"""Interaction audit of filters: Walsh-Hadamard sums of failure masks, and every order of the filters from their inverse."""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, staged

#: The filters of the contract, in the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 200, 50, 3, "#$%&*|"
#: Of which documents the sums are taken: all, those of good quality, the toxic ones.
LABELS = ("all", "good", "toxic")


def failures(text: Column) -> Column:
    """Bits of the filters that look at the text alone: too few words, too few distinct ones, too many capitals, odd signs."""
    words = F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    few = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))
    counted = F.transform(F.array(few), lambda w: F.when(w["n"] < MIN_WORDS, 1).otherwise(0) + F.when(100 * w["distinct"] < MIN_DISTINCT * w["n"], 2).otherwise(0))
    return F.get(counted, F.lit(0)) + F.when(100 * capitals > MAX_CAPITALS * F.length(text), 4).otherwise(0) + F.when(F.length(F.translate(text, SIGNS, "")) < F.length(text), 8).otherwise(0)


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, good, toxic, mask, n): how many documents of each part and labels fail which filters; bit 16 is a text that a smaller id holds too.

    Texts are read once and leave their task as two 64-bit hashes. Of equal texts only the rows of the smallest id don't
    fail as copies, so copies are all rows less those first ones: counts and minima that are combined before a shuffle,
    however many copies a text has.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), whole.alias("text"))
    rows = rows.select("id", "part", failures(F.col("text")).alias("mask"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("audit"), "text").alias("h2"))
    marks = labels.select(F.col(f"`{key}`").alias("id"), F.col("quality").alias("quality"), F.col("toxic").alias("toxic")).filter("id IS NOT NULL")
    marks = marks.groupBy("id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    keys = ["part", "good", "toxic", "mask"]
    rows = rows.join(marks, "id", "left").select("id", "h1", "h2", "part", one("quality").alias("good"), one("toxic").alias("toxic"), "mask")
    rows = staged(rows.groupBy("id", "h1", "h2", *keys).agg(F.count("*").alias("n")), "masks")
    first = rows.filter("id IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("id"))
    first = rows.join(first, ["id", "h1", "h2"], "left_semi").groupBy(*keys).agg(F.sum("n").alias("first"))
    every = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("free"))
    both = every.join(first, keys, "left").withColumn("single", F.coalesce("first", F.lit(0)) + F.col("free"))
    either = F.explode(F.array(F.struct(F.col("mask"), F.col("single").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("single")).alias("n"))))
    return both.select("part", "good", "toxic", either.alias("x")).select("part", "good", "toxic", F.col("x.mask").cast("int").alias("mask"), "x.n")


def _sign(a: Column, b: Column) -> Column:
    """-1 to the number of bits that two masks share."""
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(rows: DataFrame, bits: int = len(FILTERS)) -> DataFrame:
    """(part, all, good, toxic): for each part and label the sums of signs over documents, one for each set of filters.

    The sign of a document for a set is -1 to the number of filters of the set that it fails. Sums of parts of a table
    add up, so the aggregation is a row of 2**bits sums a label.
    """
    weights = {"all": "n", "good": "CASE WHEN good THEN n ELSE 0 END", "toxic": "CASE WHEN toxic THEN n ELSE 0 END"}
    every = range(1 << bits)
    sums = rows.groupBy("part").agg(*[F.expr(f"sum((1 - 2 * (bit_count(mask & {s}) % 2)) * {w}) AS {label}_{s}") for label, w in weights.items() for s in every])
    return sums.selectExpr("part", *[f"array({', '.join(f'{label}_{s}' for s in every)}) AS {label}" for label in LABELS])


def cells(sums: Column, bits: int = len(FILTERS)) -> Column:
    """The inverse: documents by failure mask, exactly. The transform is its own inverse but for the factor 2**bits."""
    masks = F.sequence(F.lit(0), F.lit((1 << bits) - 1))
    total = lambda m: F.aggregate(F.transform(sums, lambda w, s: w * _sign(m, s)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(masks, lambda m: F.shiftright(total(m), bits))


def _count(cell: Column, want) -> Column:
    """Documents in the cells whose mask fulfils the condition."""
    return F.aggregate(F.transform(cell, lambda n, m: F.when(want(m), n).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: five filters in all 120 orders.

    One row per part, order and step, zeros included. A document is removed by the first filter of an order that it
    fails; ``redundant`` fails the step's filter but went before, ``unique_fails`` fails no other filter. ``shapley`` is
    what the filter removes over all orders: of a document that fails k filters each removes it in 120/k orders.

    A null part is the empty string, a null text the empty one. Rows that repeat an id are documents each, and no copies
    of each other; a row without an id is no copy of any, nor any of it. Of several label rows of an id the smallest
    counts; null labels don't. Other columns don't matter. An empty table has no parts, so no rows. What is left after
    the parity sums is 96 numbers a part.
    """
    part_cells = parity_sums(masks(docs, labels, key, text, part)).select("part", *[cells(F.col(c)).alias(c) for c in LABELS])
    number = {f: i for i, f in enumerate(FILTERS)}
    steps = [(o, k + 1, 1 << number[f], sum(1 << number[x] for x in o[:k])) for o in map("".join, permutations(FILTERS)) for k, f in enumerate(o)]
    orders = [dict(zip(("order", "step", "bit", "before"), x)) for x in steps]
    orders = F.explode(F.from_json(F.lit(json.dumps(orders)), "array<struct<order:string,step:int,bit:int,before:int>>"))
    rows = part_cells.withColumn("o", orders).select("part", *LABELS, F.col("o.order").alias("filter_order"), F.col("o.step").alias("step"), F.col("o.bit").alias("bit"), F.col("o.before").alias("before"))
    bit, before = F.col("bit"), F.col("before")
    fails, gone = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    removed = lambda c: _count(F.col(c), lambda m: fails(m) & ~gone(m))
    share = F.transform("all", lambda n, m: F.when(fails(m), n * (120 / F.greatest(F.bit_count(m), F.lit(1))).cast("long")).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        _count(F.col("all"), lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        removed("all").alias("removed"),
        _count(F.col("all"), lambda m: fails(m) & gone(m)).alias("redundant"),
        _count(F.col("all"), lambda m: m == bit).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )
