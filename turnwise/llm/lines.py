"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, release, staged

MIN_KEY_CHARS = 10
BATCHES = 4
FANOUT = 2
_LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """An index of line hashes with their first holder, in sorted runs on levels.

    ``add`` takes a batch of (h1, h2, holder), one row per hash: a merge anti-join against every run drops the hashes
    that the index has, and the others become a new run of level 0, sorted by hash in each file. When a level has
    ``fanout`` runs they are merged into one sorted run of the next, so a hash is rewritten once a level and the number
    of runs stays logarithmic in the number of batches. The runs are tables in the shared folder; nothing is held in
    memory. A hash stands in one run only: batches must come in the order in which holders take precedence.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, max(2, fanout)
        self.levels: list[list[DataFrame]] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def _run(df: DataFrame, name: str) -> DataFrame:
        return staged(df.sortWithinPartitions("h1", "h2"), name)

    def add(self, batch: DataFrame) -> None:
        fresh = batch
        for run in self.runs:
            fresh = fresh.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, self._run(fresh.select("h1", "h2", "holder"), "run-0"))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            both = merged[0]
            for r in merged[1:]:
                both = both.unionByName(r)
            self._put(level + 1, self._run(both.repartition("h1", "h2"), f"run-{level + 1}"))
            release(*merged)

    def table(self) -> DataFrame:
        out, *rest = self.runs or [self.spark.createDataFrame([], "h1 long, h2 long, holder long")]
        for r in rest:
            out = out.unionByName(r)
        return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_KEY_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with ``text`` rewritten and two more columns, n_lines and n_dropped (long; before dropping).

    A line whose key has at least ``min_chars`` code points and is found in two or more documents stays only in the
    smallest id that holds it (there as often as it occurs). The documents pass in ``batches`` of ascending ids, so the
    index's first holder of a hash is the smallest id: a line falls if the index gives another holder. Keys are compared
    by two 64-bit hashes.

    Null or empty texts are one empty line. Rows with the same id are one document: equal lines in them stay. A null id
    comes after all others. Other columns are kept. An empty table gives an empty table. A line that a third of all
    documents hold is grouped to one row before a shuffle; in the join back it is one large key on the side that
    Spark's adaptive skew join splits. What reaches that join is hashes and positions; texts are shuffled once, by id.
    """
    spark = docs.sparkSession
    rank = F.coalesce(F.col(key).cast("long"), F.lit(_LAST))
    keys = F.transform(split_lines(F.col(text)), line_key)
    hashed = F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("line"), k).alias("h2"))))
    lines = docs.select(rank.alias("rank"), F.xxhash64(text).alias("row"), F.posexplode(hashed).alias("pos", "h")).filter("h IS NOT NULL")
    lines = staged(lines.select("rank", "row", "pos", "h.h1", "h.h2"), "lines")
    bounds = _bounds(lines, batches)
    index = LineRuns(spark, fanout)
    for low, high in zip([None, *bounds], [*bounds, None]):
        batch = lines
        if low is not None:
            batch = batch.filter(F.col("rank") > low)
        if high is not None:
            batch = batch.filter(F.col("rank") <= high)
        index.add(batch.groupBy("h1", "h2").agg(F.min("rank").alias("holder")))
    dropped = lines.join(index.table(), ["h1", "h2"]).filter("holder <> rank").select("rank", "row", "pos")
    dropped = dropped.distinct().groupBy("rank", "row").agg(F.array_sort(F.collect_list("pos")).alias("__dropped"))
    names = {c: f"__doc_{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], rank.alias("rank"), F.xxhash64(text).alias("row"))
    joined = held.join(dropped, ["rank", "row"], "left").withColumn("__lines", split_lines(F.col(names[text])))
    kept = F.when(F.col("__dropped").isNull(), F.coalesce(F.col(names[text]), F.lit(""))).otherwise(F.array_join(_without(F.col("__lines"), F.col("__dropped")), "\n"))
    out = [kept.alias(c) if c == text else F.col(n).alias(c) for c, n in names.items() if c not in ("n_lines", "n_dropped")]
    return joined.select(*out, F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def _bounds(lines: DataFrame, batches: int) -> list[int]:
    """Upper ids of all batches but the last, from approximate quantiles. Any bounds give the same result."""
    shares = [i / batches for i in range(1, batches)]
    if not shares:
        return []
    found = lines.agg(F.percentile_approx("rank", F.array(*[F.lit(s) for s in shares]), F.lit(1000)).alias("q")).first()["q"]
    return sorted(set(found or []))


def _without(lines: Column, dropped: Column) -> Column:
    """lines without those at the ascending positions ``dropped``: the slices between them, so the cost is linear however many fall."""
    start = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    end = F.concat(dropped, F.array(F.size(lines)))
    return F.flatten(F.zip_with(start, end, lambda a, b: F.slice(lines, a + 1, b - a)))
