"""Exact top-k inner-product search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import in_blocks, met, numbered, queries_of, unpack, usable
from .common import release, staged

K, EVERY, SCALE = 10, 100, 1024
BINS = 256
QUERY_ROWS, BLOCK_ROWS = 256, 4096
#: Scores are longs; in histograms they are told by their place among all longs, an unsigned number.
MOST = 2**63
_FLIP = np.uint64(MOST)
LIMB = 16


def quantised(v, scale: int = SCALE):
    """Components to floor(scale * x)."""
    return F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double"))


def _limbs(v: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as sums of limbs times powers of 2**LIMB; each limb has its number's sign and is a small double."""
    whole = np.clip(v, -(2.0**63) + 1024, 2.0**63 - 1024).astype(np.int64)
    sign, rest, out = np.sign(whole).astype(np.float64), np.abs(whole), []
    while rest.any():
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest = rest >> LIMB
    return out or [np.zeros_like(sign)]


def _scores(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Integer inner products, and which of them no long can hold, which are then the outermost long (None: none).

    Doubles are exact while a pair's sums stay below 2**53. Beyond that the limbs of both sides are multiplied, whose
    sums are small, and carried into each other.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        most, each = np.abs(q).sum(axis=1).max(initial=0) * np.abs(c).max(initial=0), np.abs(c).max(initial=0) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ c.T).astype(np.int64), None
    bits = 52 - int(np.ceil(np.log2(each))) if each < 2.0**52 else 0
    if most < 2.0**62 and bits > 0 and most < 2.0 ** (52 + bits):  # the queries in two parts are enough
        high = np.floor(q * 2.0**-bits)
        return ((high @ c.T).astype(np.int64) << bits) + ((q - high * 2.0**bits) @ c.T).astype(np.int64), None
    left, right = _limbs(q), _limbs(c)
    sums = [np.zeros((len(q), len(c)), dtype=np.int64) for _ in range(max(4, len(left) + len(right)))]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            sums[i + j] += (x @ y.T).astype(np.int64)
    for low, high in zip(sums, sums[1:]):
        high += low >> LIMB
        low &= (1 << LIMB) - 1
    top, over = sums[-1], np.zeros(sums[-1].shape, dtype=bool)
    negative = top < 0
    for low in sums[-2:2:-1]:
        over |= np.abs(top) >= 1 << 46
        top = np.where(over, 0, (top << LIMB) + low)
    over |= (top < -(1 << 15)) | (top >= 1 << 15)
    s = (np.where(over, 0, top) << (3 * LIMB)) + (sums[2] << (2 * LIMB)) + (sums[1] << LIMB) + sums[0]
    return np.where(over, np.where(negative, -MOST, MOST - 1), s), over


def _place(s: np.ndarray) -> np.ndarray:
    """A long's place among all longs."""
    return s.astype(np.int64).view(np.uint64) ^ _FLIP


def _side(candidates: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [unpack(r) for r in candidates]


def _histograms(width: int):
    """Counts of a block of queries and a cell's candidates: for each query and bin of its current range, how many scores fall in."""

    def make(candidates: list[dict]):
        side = _side(candidates)

        def meet(r: dict) -> Iterator[pa.RecordBatch]:
            ids, q = unpack(r)
            low = np.frombuffer(r["low"], dtype=np.uint64)[:, None]
            total = np.zeros(len(ids) * BINS, dtype=np.int64)
            for c_ids, c in side:
                at = _place(_scores(q, c)[0])
                bins = (at - low) // np.uint64(width)
                keep = (at >= low) & (bins < BINS) & (ids[:, None] != c_ids[None, :])
                total += np.bincount(np.arange(len(ids))[:, None].repeat(len(c_ids), 1)[keep] * BINS + bins[keep].astype(np.int64), minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["dim"], dtype=np.int32)), pa.array(np.full(len(at), r["block"], dtype=np.int64)), pa.array((at // BINS).astype(np.int32)), pa.array((at % BINS).astype(np.int32)), pa.array(total[at])], ["dim", "block", "q", "bin", "n"])

        return meet

    return make


def _narrow(k: int, width: int):
    """The bin that holds each query's k-th score becomes its range; ``above`` counts the scores beyond the range."""

    def run(state: pa.Table, hist: pa.Table) -> pa.Table:
        r = state.to_pylist()[0]
        low, above = np.frombuffer(r["low"], dtype=np.uint64), np.frombuffer(r["above"], dtype=np.int64)
        counts = np.zeros((len(low), BINS + 1), dtype=np.int64)
        if hist.num_rows:
            counts[hist.column("q").to_numpy(), hist.column("bin").to_numpy()] = hist.column("n").to_numpy()
        from_top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        reached = above[:, None] + from_top[:, :BINS] >= k
        found = np.where(reached.any(axis=1), BINS - 1 - np.argmax(reached[:, ::-1], axis=1), 0)
        beyond = from_top[np.arange(len(low)), found + 1]
        r |= {"above": (above + beyond).tobytes(), "low": (low + found.astype(np.uint64) * np.uint64(width)).tobytes()}
        return pa.Table.from_pylist([r], schema=state.schema)

    return run


def _best(k: int):
    """Scores above a query's k-th value, and of those equal to it the k smallest ids of the block: a superset of the answer."""

    def make(candidates: list[dict]):
        side = _side(candidates)

        def meet(r: dict) -> Iterator[pa.RecordBatch]:
            ids, q = unpack(r)
            least = np.frombuffer(r["low"], dtype=np.uint64)[:, None]
            for c_ids, c in side:
                s, over = _scores(q, c)
                at, other = _place(s), ids[:, None] != c_ids[None, :]  # a block's ids ascend
                tied = (at == least) & other
                i, j = np.nonzero(((at > least) & other) | (tied & (np.cumsum(tied, axis=1) <= k)))
                if over is not None and over[i, j].any():
                    raise ValueError("a score among a query's best is no long")
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(c_ids[j]), pa.array(s[i, j])], ["query_id", "vec_id", "score"])

        return meet

    return make


def _start(reach: int):
    """The first range of every query: all whole numbers from -reach on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x) // 8 for x in b.column(2).to_pylist()]
            low = pa.array([np.full(m, MOST - reach, dtype=np.uint64).tobytes() for m in n], pa.binary())
            above = pa.array([np.zeros(m, dtype=np.int64).tobytes() for m in n], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, low, above], ["dim", "block", "ids", "data", "low", "above"])

    return run


STATE = "dim int, block long, ids binary, data binary, low binary, above binary"


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates all other rows. Blocks of queries meet blocks of
    candidates; each round scores all pairs anew, counts the scores of each query in BINS bins of its range, sums the
    counts over all blocks and goes on with the bin that holds the k-th score, until a bin is one value. A last pass
    keeps what is above the k-th value and the smallest ids of what equals it. Between rounds only the ranges are kept;
    a task holds one cell's blocks of candidates and one block of queries.

    Vectors that are null or empty, or hold null or non-finite components, and null ids take no part. Vectors meet only
    those of their dimension. All if there are fewer than k. Rows that repeat an id aren't candidates of their own id;
    elsewhere each counts. Other columns don't matter; an empty table gives no rows. Scores are exact over all longs; a
    result that would hold a larger one, either sign, raises an error, and those in no result do no harm.
    """
    rows = numbered(usable(vectors, key, vector).select("vec_id", quantised(F.col("v"), scale).alias("v")), "quantised")
    candidates = in_blocks(rows, block_rows, "candidates")
    queries = in_blocks(queries_of(rows, every), query_rows, "queries")
    size = lambda how: F.coalesce(F.max(how), F.lit(0.0))
    spread = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    most = rows.agg(size(F.when(F.col("vec_id") % every == 0, spread)).alias("query"), size(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    reach = min(MOST, int(min(float(MOST), most["query"] * most["largest"])) + 1)
    width = 1
    while width * BINS < 2 * reach:
        width *= BINS
    state = staged(queries.mapInArrow(_start(reach), STATE), "ranges")
    while width:
        counts = met(state.drop("above"), candidates, _histograms(width), "dim int, block long, q int, bin int, n long").groupBy("dim", "block", "q", "bin").agg(F.sum("n").alias("n"))
        before, state = state, staged(state.groupBy("dim", "block").cogroup(counts.groupBy("dim", "block")).applyInArrow(_narrow(k, width), STATE), "ranges")
        release(before)
        width //= BINS
    found = met(state.select("dim", "block", "ids", "data", "low"), candidates, _best(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
