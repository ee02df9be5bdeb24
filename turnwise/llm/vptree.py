"""Approximate nearest neighbours by cosine: vantage-point trees per shard, with relaxed triangle-inequality pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import in_blocks, met, numbered, queries_of, unpack, usable
from .common import staged

K, EVERY, FACTOR = 5, 50, 2.6
QUERY_ROWS, SHARD_ROWS, LEAF, VANTAGE = 256, 4096, 256, 16
#: Distances are kept in single precision; a bound has to be beyond the reach by more than their rounding.
_EPS = 1e-5


def cosines(q: np.ndarray, qn: np.ndarray, c: np.ndarray, cn: np.ndarray) -> np.ndarray:
    """Cosines in double precision, from sums whose order depends on neither side's other rows: equal vectors have equal scores."""
    return np.einsum("qd,cd->qc", q, c, optimize=False) / (qn[:, None] * cn[None, :])


def angles(cos: np.ndarray) -> np.ndarray:
    """The metric of the trees: angles obey the triangle inequality, and bound nearness more tightly than chords do."""
    return np.arccos(np.clip(cos, -1.0, 1.0))


def build(v: np.ndarray, leaf: int = LEAF, vantage: int = VANTAGE) -> tuple[np.ndarray, list[list], np.ndarray]:
    """A tree over unit vectors: an order of the rows, nodes (from, to, inside, outside, level), and each row's distances.

    A node's ``vantage`` vantage points stand first in its range: rows far from each other. The rows after them are
    halved by rank of their distance to the one of widest spread, so copies of a vector don't unbalance the tree.
    far[i, level * vantage + k] is row i's distance to the k-th vantage point of its ancestor on that level (nan: it has
    none). inside 0: a leaf.
    """
    levels = max(0, int(np.ceil(np.log2(max(1, len(v)) / max(1, leaf)))))
    order, nodes, todo = np.arange(len(v)), [], [(0, len(v), None, 0, 0)]
    far = np.full((len(v), levels * vantage), np.nan, dtype=np.float32)
    while todo:
        a, b, parent, side, level = todo.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][2 + side] = me
        if level == levels or b - a <= max(leaf, 2 * vantage + 1):
            nodes.append([a, b, 0, 0, level])
            continue
        own, rows = order[a:b].copy(), far[a:b].copy()
        first = int(np.argmin(v[own] @ v[own].mean(axis=0)))
        picked, nearest = [first], angles(v[own] @ v[own[first]])
        d = [nearest]
        while len(picked) < vantage:
            nearest[picked] = -1.0
            nxt = int(np.argmax(nearest))
            picked.append(nxt)
            d.append(angles(v[own] @ v[own[nxt]]))
            nearest = np.minimum(nearest, d[-1])
        d = np.stack(d, axis=1)
        rows[:, level * vantage : (level + 1) * vantage] = d
        rest = np.setdiff1d(np.arange(b - a), picked)
        widest = int(np.argmax(d[rest].std(axis=0)))
        rest = rest[np.argsort(d[rest, widest], kind="stable")]
        now = np.concatenate([picked, rest])
        order[a:b], far[a:b] = own[now], rows[now]
        far[a : a + vantage, level * vantage :] = np.nan
        nodes.append([a, b, 0, 0, level])
        half = a + vantage + (len(rest) + 1) // 2
        todo += [(a + vantage, half, me, 0, level + 1), (half, b, me, 1, level + 1)]
    return order, nodes, far


class Shard:
    """A shard's rows in the order of its tree, and for each node the least and largest distances of its rows to the vantage points above it."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, nodes: list, far: np.ndarray, vantage: int):
        self.ids, self.c, self.nodes, self.far, self.vantage = ids, c, nodes, far, vantage
        self.cn = np.linalg.norm(c, axis=1)
        self.bounds = [(far[a:b, : level * vantage].min(axis=0), far[a:b, : level * vantage].max(axis=0)) for a, b, _, _, level in nodes]


class Search:
    """The k best of each query of a block, kept from shard to shard, so that a bound found in one prunes the next.

    All queries go down a tree together, into the half first that is nearer to most; each node sees those that it can
    still better. ``scored`` counts the pairs whose cosine was computed.
    """

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int, factor: float):
        self.q_ids, self.q, self.k, self.factor, self.scored = q_ids, q, k, factor, 0
        self.qn = np.linalg.norm(q, axis=1)
        self.best = np.full((len(q), k), -np.inf)
        self.who = np.full((len(q), k), np.iinfo(np.int64).max)

    def reach(self, at: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far."""
        worst = self.best[at, -1]
        return np.where(worst == -np.inf, np.inf, angles(np.maximum(worst, -1.0)))

    def offer(self, at: np.ndarray, cos: np.ndarray, ids: np.ndarray) -> None:
        """Rows with these ids and cosines (-inf: not scored) to the queries at. Only what reaches a query's k-th best is sorted."""
        score = np.where(self.q_ids[at][:, None] == ids[None, :], -np.inf, cos)
        least = self.best[at, -1]
        empty = least == -np.inf
        if empty.any() and score.shape[1] > self.k:
            least[empty] = np.partition(score[empty], -self.k, axis=1)[:, -self.k]
        i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        if not len(i):
            return
        rows, first, n = np.unique(i, return_index=True, return_counts=True)
        place = np.arange(len(i)) - np.repeat(first, n)
        at, row = at[rows], np.repeat(np.arange(len(rows)), n)
        new, who = np.full((len(rows), n.max()), -np.inf), np.full((len(rows), n.max()), np.iinfo(np.int64).max)
        new[row, place], who[row, place] = score[i, j], ids[j]
        score, who = np.concatenate([self.best[at], new], axis=1), np.concatenate([self.who[at], who], axis=1)
        first = np.lexsort((who, -score), axis=1)[:, : self.k]
        self.best[at], self.who[at] = np.take_along_axis(score, first, 1), np.take_along_axis(who, first, 1)

    def shard(self, s: Shard) -> None:
        self.s = s
        self.near = np.zeros((len(self.q), s.far.shape[1]), dtype=np.float32)  # a query's distances to the vantage points on the way down
        self.visit(0, np.arange(len(self.q)))

    def visit(self, node: int, at: np.ndarray) -> None:
        """Down from a node with those queries that its rows can still better by the triangle inequality."""
        s = self.s
        a, b, inside, outside, level = s.nodes[node]
        v = s.vantage
        if not inside:
            self.leaf(at, a, b, level * v)
            return
        cos = cosines(self.q[at], self.qn[at], s.c[a : a + v], s.cn[a : a + v])
        self.scored += cos.size
        self.offer(at, cos, s.ids[a : a + v])
        self.near[at, level * v : (level + 1) * v] = angles(cos)
        for child, bound in sorted(((c, self.bound(at, c, (level + 1) * v)) for c in (inside, outside)), key=lambda x: (x[1].sum(), x[0])):
            go = self.factor * bound <= self.reach(at) + _EPS
            if go.any():
                self.visit(child, at[go])

    def bound(self, at: np.ndarray, node: int, n: int) -> np.ndarray:
        """The least distance that the triangle inequality leaves between each query and the node's rows."""
        low, high = self.s.bounds[node]
        d = self.near[at, :n]
        return np.maximum(0, np.maximum(low - d, d - high)).max(axis=1)

    def leaf(self, at: np.ndarray, a: int, b: int, n: int) -> None:
        """The rows of a leaf that each query's triangle inequalities with all vantage points on the way leave."""
        s = self.s
        limit = ((self.reach(at) + _EPS) / self.factor).astype(np.float32)[:, None]
        alive = np.ones((len(at), b - a), dtype=bool)
        near, far = self.near[at, :n], np.ascontiguousarray(s.far[a:b, :n].T)
        for p in range(n):
            gap = near[:, p, None] - far[p]
            np.abs(gap, out=gap)
            alive &= gap <= limit
        i, j = np.nonzero(alive)
        if not len(i):
            return
        self.scored += len(i)
        cos = np.full(alive.shape, -np.inf)
        if 2 * len(i) > alive.size:
            cos = np.where(alive, cosines(self.q[at], self.qn[at], s.c[a:b], s.cn[a:b]), -np.inf)
        else:
            cos[i, j] = np.einsum("nd,nd->n", self.q[at[i]], s.c[a + j], optimize=False) / (self.qn[at[i]] * s.cn[a + j])
        self.offer(at, cos, s.ids[a:b])


SHARD = "dim int, block long, ids binary, data binary, tree binary, far binary"
_SHARD = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("tree", pa.binary()), ("far", pa.binary())])


def _index(leaf: int, vantage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, c = unpack(r)
                order, nodes, far = build(c / np.linalg.norm(c, axis=1, keepdims=True), leaf, vantage)
                r |= {"ids": ids[order].tobytes(), "data": np.ascontiguousarray(c[order]).tobytes(), "tree": np.array(nodes, dtype=np.int32).tobytes(), "far": far.tobytes()}
                yield from pa.Table.from_pylist([r], schema=_SHARD).to_batches()

    return run


def _shard(r: dict, vantage: int) -> Shard:
    ids, c = unpack(r)
    return Shard(ids, c, np.frombuffer(r["tree"], dtype=np.int32).reshape(-1, 5).tolist(), np.frombuffer(r["far"], dtype=np.float32).reshape(len(ids), -1), vantage)


def _search(k: int, factor: float, vantage: int):
    def make(candidates: list[dict]):
        shards = [_shard(r, vantage) for r in candidates]

        def meet(r: dict) -> Iterator[pa.RecordBatch]:
            s = Search(*unpack(r), k, factor)
            for one in shards:
                s.shard(one)
            i, j = np.nonzero(s.best > -np.inf)
            scored = np.zeros(len(i), dtype=np.int64)
            scored[:1] = s.scored
            yield pa.RecordBatch.from_arrays([pa.array(s.q_ids[i]), pa.array(s.who[i, j]), pa.array(s.best[i, j]), pa.array(scored)], ["query_id", "vec_id", "score", "scored"])

        return meet

    return make


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, leaf: int = LEAF, vantage: int = VANTAGE) -> tuple[DataFrame, DataFrame]:
    """(usable vectors, shards with their trees), both staged. Every usable row is in one shard's tree."""
    rows = numbered(usable(vectors, key, vector).filter(F.exists("v", lambda x: x != 0)), "vectors")
    return rows, staged(in_blocks(rows, shard_rows, "shards").mapInArrow(_index(leaf, vantage), SHARD), "trees")


def candidates_found(rows: DataFrame, trees: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR, query_rows: int = QUERY_ROWS, vantage: int = VANTAGE) -> DataFrame:
    """query_id, vec_id, score, scored: the k best of each query and group of shards; ``scored`` sums to the pairs whose cosine was computed."""
    queries = in_blocks(queries_of(rows, every), query_rows, "queries")
    return met(queries, trees, _search(k, factor, vantage), "query_id long, vec_id long, score double, scored long")


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, factor: float = FACTOR, query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS, leaf: int = LEAF, vantage: int = VANTAGE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine): the k nearest found of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates all other rows. A node, and in a leaf a row, is
    passed over if ``factor`` times the least distance that the triangle inequality with the vantage points on the way
    leaves it exceeds the distance of the k-th best so far: factor 1 is exact, a larger one looks at less. A block of
    queries takes its k best from one shard to the next. Each group of shards gives its k best, of which the best k stay.

    Vectors that are null, empty or zero, or hold null or non-finite components, and null ids take no part. Vectors meet
    only those of their dimension. All found if there are fewer than k. Rows that repeat an id aren't candidates of their
    own id; elsewhere each counts. Other columns don't matter; an empty table gives no rows.
    """
    rows, trees = index(vectors, key, vector, shard_rows, leaf, vantage)
    found = candidates_found(rows, trees, k, every, factor, query_rows, vantage)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
