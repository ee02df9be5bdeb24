"""Known patterns: pairwise similarity, average-linkage clusters, medoids, names, matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims
from ..sources.stage import staged
from .components import components
from ..functions.sequences import WEIGHTS, bounded_similarity, fingerprint_similarity, most_similar, next_after_subsequence, order_similarity, partial_similarity, step_cell


def distinct_fingerprints(fps: DataFrame) -> DataFrame:
    """code, steps, tactics, n, first conv_id of each distinct fingerprint. Everything pairwise works on these, not on conversations."""
    f = fps.withColumn("code", F.concat_ws("|", dims.step_code(F.col("steps")), F.array_join("tactics", ",")))
    return f.groupBy("code").agg(F.first("steps").alias("steps"), F.first("tactics").alias("tactics"), F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))


def pair_similarity(fps: DataFrame, key: str = "code") -> DataFrame:
    """a, b (a < b), similarity of every pair of the given, distinct fingerprints."""
    a = fps.select(F.col(key).alias("a"), F.col("steps").alias("a_steps"), F.col("tactics").alias("a_tactics"))
    b = fps.select(F.col(key).alias("b"), F.col("steps").alias("b_steps"), F.col("tactics").alias("b_tactics"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.select("a", "b", fingerprint_similarity(F.col("a_steps"), F.col("a_tactics"), F.col("b_steps"), F.col("b_tactics")).alias("similarity"))


def average_pair_similarity(incidents: DataFrame, key: str = "id") -> DataFrame:
    """One row: mean order similarity over all pairs, weighted by how often each step list occurs; 0 for fewer than two."""
    lists = incidents.groupBy(F.array_join("steps", ">").alias("code")).agg(F.first("steps").alias("steps"), F.count("*").alias("n"))
    a, b = lists.select(F.col("code").alias("a"), F.col("steps").alias("x"), F.col("n").alias("n_a")), lists.select(F.col("code").alias("b"), F.col("steps").alias("y"), F.col("n").alias("n_b"))
    pairs = a.join(b, F.col("a") <= F.col("b"))
    count = F.when(F.col("a") == F.col("b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b"))
    sums = pairs.select(count.cast("double").alias("w"), order_similarity(F.col("x"), F.col("y")).alias("s")).agg(F.sum(F.col("w") * F.col("s")).alias("s"), F.sum("w").alias("w"))
    return sums.select(F.coalesce(F.when(F.col("w") > 0, F.col("s") / F.col("w")), F.lit(0.0)).alias("average"))


def linkage(sim: np.ndarray, weight: np.ndarray, threshold: float) -> list[list[int]]:
    """Average-linkage clusters of items that stand for ``weight`` equal ones each.

    The pair of largest mean similarity is merged, the first in order on ties, and keeps the first one's place, until the
    largest is under the threshold.
    """
    groups, w = [[i] for i in range(len(sim))], weight.astype(float)
    total = sim * w[:, None] * w[None, :]
    while len(groups) > 1:
        mean = np.where(np.triu(np.ones_like(total, dtype=bool), 1), np.round(total / (w[:, None] * w[None, :]), 12), -1.0)
        a, b = divmod(int(np.argmax(mean)), len(groups))
        if mean[a, b] < threshold:
            break
        total[a] += total[b]
        total[:, a] += total[:, b]
        total, w[a] = np.delete(np.delete(total, b, 0), b, 1), w[a] + w[b]
        w = np.delete(w, b)
        groups[a] += groups.pop(b)
    return groups


#: Bytes of rows of similarities that a merging task keeps; others are computed anew when they are needed.
ROW_BYTES = 128 << 20


class Linkage:
    """Average linkage of many items in bounded memory, with the result of ``linkage``.

    Similarities are computed a row at a time, one item against all, when they are asked for; a cluster's row is the sum
    of its items' rows, and rows are kept while they fit ``ROW_BYTES``. Every cluster remembers the best of those after
    it, which is looked for again only where a merge may have changed it.
    """

    def __init__(self, steps: list[list[str]], tactics: list[list[str]], weight: np.ndarray, row_bytes: int = ROW_BYTES):
        n = len(steps)
        code: dict[str, int] = {}
        self.lists = [[code.setdefault(s, len(code) + 1) for s in x] for x in steps]
        self.length = np.array([len(x) for x in self.lists], dtype=np.int64)
        self.table = np.zeros((int(self.length.max(initial=0)), n), dtype=np.int32)
        for i, x in enumerate(self.lists):
            self.table[: len(x), i] = x
        self.sets = [self._flags([set(t) for t in tactics]), self._flags([set(zip(x, x[1:])) for x in self.lists])]
        self.w, self.room = weight.astype(float), max(4, row_bytes // (8 * max(1, n)))
        self.rows: dict[int, np.ndarray] = {}

    @staticmethod
    def _flags(sets: list[set]) -> np.ndarray:
        """Items by members, as zeros and ones."""
        number = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
        out = np.zeros((len(sets), max(1, len(number))), dtype=np.float32)
        for i, s in enumerate(sets):
            out[i, [number[x] for x in s]] = 1.0
        return out

    def similarities(self, i: int) -> np.ndarray:
        """Of item i to all."""
        a, n = self.lists[i], self.table.shape[1]
        last = np.zeros((len(a) + 1, n), dtype=np.int32)
        for column in self.table:
            before = last.copy()
            for k, x in enumerate(a):
                last[k + 1] = np.where(column == x, before[k] + 1, np.maximum(before[k + 1], last[k]))
            last[:, column == 0] = before[:, column == 0]
        total = WEIGHTS[0] * 2 * last[-1] / np.maximum(1, len(a) + self.length)
        for share, flags in zip(WEIGHTS[1:], self.sets):
            common, size = flags @ flags[i], flags.sum(axis=1)
            union = size + size[i] - common
            total = total + share * np.where(union == 0, 1.0, common / np.maximum(union, 1.0)).astype(np.float64)
        return np.where((self.length == 0) | (len(a) == 0), 0.0, total)

    def row(self, members: list[int]) -> np.ndarray:
        """The weighted sum of a cluster's rows."""
        key = members[0]
        if key not in self.rows:
            self._keep(key, sum(self.w[i] * self.similarities(i) for i in members))
        return self.rows[key]

    def _keep(self, key: int, row: np.ndarray) -> None:
        while len(self.rows) >= self.room:
            self.rows.pop(next(iter(self.rows)))
        self.rows[key] = row

    def clusters(self, threshold: float) -> list[list[int]]:
        n = len(self.lists)
        groups, of, w = [[i] for i in range(n)], np.arange(n), self.w.copy()
        alive = np.ones(n, dtype=bool)
        best, mean = np.full(n, -1), np.full(n, -1.0)

        def means(a: int) -> np.ndarray:
            return np.round(np.bincount(of, weights=self.row(groups[a]) * self.w, minlength=n) / (w[a] * w), 12)

        def look(a: int) -> None:
            later = np.where(alive, means(a), -1.0)
            later[: a + 1] = -1.0
            best[a] = int(np.argmax(later))
            mean[a] = later[best[a]]

        for a in range(n):
            look(a)
        while n > 1:
            a = int(np.argmax(np.where(alive, mean, -1.0)))
            if mean[a] < threshold:
                break
            b = int(best[a])
            row = self.row(groups[a]) + self.row(groups[b])
            self.rows.pop(groups[a][0], None), self.rows.pop(groups[b][0], None)
            groups[a], groups[b] = groups[a] + groups[b], []
            self._keep(groups[a][0], row)
            w[a] += w[b]
            of[of == b] = a
            alive[b], mean[b], w[b] = False, -1.0, 1.0
            look(a)
            now = means(a)
            for c in np.flatnonzero(alive[:a]).tolist():
                if best[c] in (a, b):
                    look(c)
                elif now[c] > mean[c] or (now[c] == mean[c] and a < best[c]):
                    best[c], mean[c] = a, now[c]
            for c in np.flatnonzero(alive & (best == b)).tolist():
                if c > a:
                    look(c)
        return [groups[a] for a in range(n) if alive[a]]


def similar_pairs(kinds: DataFrame, threshold: float, by: str | None = None) -> DataFrame:
    """node pairs (a, b), a before b by first conversation and node, whose similarity reaches the threshold, apart for each value of ``by``.

    Fingerprints stand in cells by their set of steps, of which there are at most 1,024; a fingerprint meets only those
    of the cells whose bound reaches the threshold, and the order of steps is compared only where the sets leave room.
    """
    group = [by] if by else []
    cells, names = F.sequence(F.lit(0), F.lit((2 << len(dims.STEPS)) - 1)), len(dims.STEPS)
    f = kinds.select(*group, "node", "first_conv", "steps", "tactics", step_cell(F.col("steps"), dims.STEPS).alias("cell"))
    near = f.select(*group, "cell").distinct().withColumn("near", F.explode(F.filter(cells, lambda m: most_similar(F.col("cell"), m, names) >= threshold - 1e-9)))
    near = near.join(f.select(*group, F.col("cell").alias("near")).distinct(), [*group, "near"])
    left = f.select(*group, "cell", F.col("node").alias("a"), F.col("first_conv").alias("f_a"), F.col("steps").alias("x"), F.col("tactics").alias("p")).join(near, [*group, "cell"])
    right = f.select(*group, F.col("cell").alias("near"), F.col("node").alias("b"), F.col("first_conv").alias("f_b"), F.col("steps").alias("y"), F.col("tactics").alias("q"))
    later = (F.col("f_a") < F.col("f_b")) | ((F.col("f_a") == F.col("f_b")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, [*group, "near"]).filter(later)
    s = bounded_similarity(F.col("x"), F.col("p"), F.col("y"), F.col("q"), F.lit(threshold))
    return pairs.select("a", "b", s.alias("s")).filter(F.col("s") >= threshold)


def clusters(fps: DataFrame, threshold: float = dims.CLUSTER_AT, by: str | None = None) -> DataFrame:
    """code -> cluster, over distinct fingerprints with multiplicity n, apart for each value of ``by``. A cluster is named by the first conversation of its first member.

    Two clusters that merge hold a pair above the threshold, so merging never leaves a component of such pairs: the
    components are found in Spark from pairs that a bound lets through, and each is merged on its own, on one row per
    distinct fingerprint, by a task that computes the similarities it needs a row at a time.
    """
    group = [by] if by else []
    kinds = staged(fps.select(*group, "code", "steps", "tactics", "n", "first_conv", F.xxhash64(*group, "code").alias("node")), "kinds")
    found = components(similar_pairs(kinds, threshold, by).select("a", "b"))
    items = kinds.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = items.groupBy(*group, "component").agg(F.array_sort(F.collect_list(F.struct("first_conv", "node", "n", "code", "steps", "tactics"))).alias("m"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, m in zip(pdf.itertuples(), pdf["m"]):
                linked = Linkage([list(x["steps"]) for x in m], [list(x["tactics"]) for x in m], np.array([x["n"] for x in m]))
                out = [(*([getattr(at, by)] if by else []), m[i]["code"], m[g[0]]["first_conv"], r) for g in linked.clusters(threshold) for r, i in enumerate(g)]
                yield pd.DataFrame(out, columns=[*group, "code", "cluster", "rank"])

    types = {f.name: f.dataType.simpleString() for f in kinds.schema}
    return members.mapInPandas(merge, ", ".join([*[f"`{g}` {types[g]}" for g in group], f"code string, cluster {types['first_conv']}, rank int"]))


def medoids(fps: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, code of the member with the largest summed similarity to all members, itself included; the first on ties."""
    m = members.join(fps.select("code", "steps", "tactics", "n", "first_conv"), "code")
    o = m.select("cluster", F.col("steps").alias("y"), F.col("tactics").alias("q"), F.col("n").alias("m"))
    s = m.join(o, "cluster").groupBy("cluster", "code", "first_conv").agg(F.sum(fingerprint_similarity(F.col("steps"), F.col("tactics"), F.col("y"), F.col("q")) * F.col("m")).alias("s"))
    best = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc(F.round("s", 9)), "first_conv"))
    return s.withColumn("r", best).filter("r = 1").select("cluster", "code")


def family_histogram(members: DataFrame) -> DataFrame:
    """From (cluster, family) rows: cluster, family, n, share, is_major (a share of 0.3 or more)."""
    n = members.groupBy("cluster", "family").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("cluster"))
    return n.withColumn("share", share).withColumn("is_major", F.col("share") >= 0.3)


def named_patterns(hist: DataFrame, proto: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """pattern_ord, id, name, size, steps, tactics. hist: family_histogram with first_seen; proto: cluster, steps, tactics.

    A name joins the labels of the major families, most frequent first; patterns stand by descending size, and names that
    repeat are numbered.
    """
    label = F.coalesce(dims.lookup(labels, F.col("family")), "family") if labels else F.col("family")
    named = hist.groupBy("cluster").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.when(F.col("is_major"), F.struct((-F.col("n")).alias("k"), "first_seen", label.alias("label"))))).alias("m"))
    named = named.select("cluster", "size", F.array_join(F.transform("m", lambda x: x["label"]), " / ").alias("name")).join(proto, "cluster")
    pos = F.row_number().over(W.orderBy(F.desc("size"), "cluster"))
    named = named.withColumn("pattern_ord", pos)
    v = F.row_number().over(W.partitionBy("name").orderBy("pattern_ord"))
    named = named.withColumn("v", v)
    return named.select("pattern_ord", F.concat(F.lit("P"), "pattern_ord").alias("id"), F.when(F.col("v") > 1, F.concat("name", F.lit(" (variant "), "v", F.lit(")"))).otherwise(F.col("name")).alias("name"), F.col("size").cast("long").alias("size"), "steps", "tactics")


def best_match(live: DataFrame, patterns: DataFrame, key: list[str], partial: bool = True) -> DataFrame:
    """live with pattern_id, pattern_name, members, score, novel of its best pattern; the first wins ties and no positive score means none.

    Matching runs on distinct (steps, tactics), each with the patterns that it shares a step or tactic with.
    """
    sim = partial_similarity if partial else fingerprint_similarity
    kinds = staged(live.select("steps", "tactics").distinct(), "kinds")
    p = patterns.select("pattern_ord", F.col("id").alias("pattern_id"), F.col("name").alias("pattern_name"), F.col("size").alias("members"), F.col("steps").alias("p_steps"), F.col("tactics").alias("p_tactics"))
    holds = lambda s, t: F.explode(F.array_union(F.transform(s, lambda x: F.concat(F.lit("s:"), x)), F.transform(t, lambda x: F.concat(F.lit("t:"), x))))
    asked, held = kinds.withColumn("__holds", holds(F.col("steps"), F.col("tactics"))), p.select("pattern_ord", holds(F.col("p_steps"), F.col("p_tactics")).alias("__holds"))
    pairs = asked.join(held, "__holds").select("steps", "tactics", "pattern_ord").distinct()  # those without a common step or tactic score nothing
    scored = pairs.join(p, "pattern_ord").withColumn("score", sim(F.col("steps"), F.col("tactics"), F.col("p_steps"), F.col("p_tactics"))).filter("score > 0")
    best = scored.groupBy("steps", "tactics").agg(F.max_by(F.struct("pattern_id", "pattern_name", "members", "score", "p_steps"), F.struct("score", -F.col("pattern_ord"))).alias("b"))
    # The key comes from a generator: of a column that is an expression of another, Catalyst infers filters on the other side that name columns of this one.
    keyed = live.select("*", F.explode(F.array(F.struct("steps", "tactics"))).alias("__key"))
    out = keyed.join(best.select(F.struct("steps", "tactics").alias("__key"), "b"), "__key", "left")
    return out.select(*[c for c in live.columns], F.col("b.pattern_id"), F.col("b.pattern_name"), F.col("b.members"), F.coalesce("b.score", F.lit(0.0)).alias("match_score"), (F.coalesce("b.score", F.lit(0.0)) < dims.NOVEL_BELOW).alias("novel"), F.col("b.p_steps").alias("prototype"))


def nearest(live: DataFrame, incidents: DataFrame, k: int = 3) -> DataFrame:
    """live code, rank, incident code, similarity: the k most similar distinct incidents, ties by the incident's code.

    Incidents stand in cells by their set of steps. A first look at the cells that share nearly all steps with a live one
    gives a similarity that k incidents reach; a second one goes through the cells whose bound reaches that.
    """
    names, close = len(dims.STEPS), 0.9
    cells = F.sequence(F.lit(0), F.lit((2 << names) - 1))
    i = incidents.select(F.col("code").alias("incident"), F.col("steps").alias("y"), F.col("tactics").alias("q"), step_cell(F.col("steps"), dims.STEPS).alias("near"))
    i = staged(i, "incidents")
    asked = staged(live.select("code", "steps", "tactics", step_cell(F.col("steps"), dims.STEPS).alias("cell")), "live")
    there = i.select("near").distinct()
    bounds = asked.select("cell").distinct().select("cell", F.explode(cells).alias("near")).withColumn("most", most_similar(F.col("cell"), F.col("near"), names)).join(there, "near")
    bounds = staged(bounds, "bounds")  # at most the square of the number of cells
    rank = F.row_number().over(W.partitionBy("code").orderBy(F.desc(F.round("similarity", 9)), "incident"))

    def met(pairs: DataFrame, least: Column) -> DataFrame:
        s = bounded_similarity(F.col("steps"), F.col("tactics"), F.col("y"), F.col("q"), least)
        s = pairs.join(i, "near").select("code", "incident", s.alias("similarity")).filter("similarity IS NOT NULL")
        return s.withColumn("rank", rank).filter(F.col("rank") <= k)

    first = met(asked.join(bounds.filter(F.col("most") >= close), "cell"), F.lit(0.0))
    reached = first.groupBy("code").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("least"))
    second = asked.join(reached, "code", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).join(bounds, "cell").filter(F.col("most") >= F.col("least") - 1e-9)
    return met(second, F.col("least")).select("code", "rank", "incident", "similarity")


def vote_next(partial: DataFrame, known: DataFrame) -> DataFrame:
    """For each partial (code, steps): next step with the most votes among known sequences (steps, n, ord) that hold it as a subsequence, votes, total."""
    key = F.coalesce(F.element_at("part", -1), F.lit(""))  # a sequence that holds a part holds its last step; the empty part is in all
    asked = partial.select("code", F.col("steps").alias("part")).withColumn("key", F.when(F.size("part") == 0, F.lit("")).otherwise(key))
    held = known.select("steps", "n", "ord", F.explode(F.array_append(F.array_distinct("steps"), F.lit(""))).alias("key"))
    j = asked.join(held, "key").withColumn("next", next_after_subsequence(F.col("part"), F.col("steps"))).filter("next IS NOT NULL")
    v = j.groupBy("code", "next").agg(F.sum("n").alias("votes"), F.min("ord").alias("first_seen"))
    total = F.sum("votes").over(W.partitionBy("code"))
    r = F.row_number().over(W.partitionBy("code").orderBy(F.desc("votes"), "first_seen"))
    return v.withColumns({"total": total, "r": r}).filter("r = 1").select("code", "next", "votes", "total")


def ui_incidents(incidents: DataFrame, per_pattern: int = 3) -> DataFrame:
    """Incidents (id, label, surface, pattern_ord, pattern_name, ord, steps) as the display takes them: display steps only, the first few of each pattern."""
    r = F.row_number().over(W.partitionBy("pattern_ord").orderBy("ord"))
    steps = F.filter("steps", lambda s: s.isin(*dims.UI_STEPS))
    return incidents.withColumn("r", r).filter(F.col("r") <= per_pattern).select("id", "label", "surface", steps.alias("steps"), "pattern_name")


def current_move(events: DataFrame) -> DataFrame:
    """conv_id, move: the label of each conversation's latest signal event (conv_id, at, seq, type, label)."""
    return events.filter("type = 'signal'").groupBy("conv_id").agg(F.max_by("label", F.struct("at", "seq")).alias("move"))
