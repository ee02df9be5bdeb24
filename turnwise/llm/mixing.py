"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import running
from .common import staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42
#: Bits of the seeded hash that deal the rows of one source into buckets; the hash orders the rows, so their number changes no result.
BUCKET_BITS = 10
_CHUNK = 4096


def word_count(text: Column) -> Column:
    """Maximal runs of other characters than \\x20 and \\x09-\\x0D; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From rows (source, source_size), one per source, to (source, source_size, target).

    The weights go round the sources in code-point order, the null source last. The sources together share the total
    size by weight. A source's cap is ``max_epochs`` times its size. Sorted by cap/weight, the clamped sources are a
    prefix: the water level after clamping the first j is what is left of the total over the weight that is left, and
    the final level is the first that no remaining source's cap/weight undercuts. That is the fixed point of clamping
    and resharing again and again. Sums over all sources are running sums in ranges, so there may be any number of them.
    Zero-sized sources get 0; an empty table gives no rows.
    """
    s = staged(sizes.select("source", "source_size"), "sources")
    s = running(s, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("w"))
    s = running(s, [F.col("ratio"), F.col("source").asc_nulls_last()], {"cap_before": F.col("cap"), "w_before": F.col("w")})
    s = s.crossJoin(F.broadcast(s.agg(F.sum("source_size").alias("everything"), F.sum("w").alias("every_w"))))  # one row
    s = s.withColumn("level", (F.col("everything") - F.col("cap_before")) / (F.col("every_w") - F.col("w_before")))
    first = F.struct("ratio", (-F.col("level")).alias("minus"))  # of sources that tie in their ratio the first has the highest level
    final = s.agg(F.min(F.when(F.col("ratio") >= F.col("level"), first)).alias("first"))
    s = s.crossJoin(F.broadcast(final.select((-F.col("first.minus")).alias("final"))))  # one row
    return s.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w"))).alias("target"))


def _hashes(docs: DataFrame, columns: list[str], seed: int) -> tuple[Column, Column]:
    """Two seeded 64-bit hashes of the given columns: rows equal in both are one class."""
    cols = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(seed), *cols), F.xxhash64(F.lit(seed), F.lit("class"), *cols)


def _plan(rows: DataFrame, weights, max_epochs: int) -> DataFrame:
    """From rows (doc_id, source, size, h, h2) to a row per class of equal ones: n, source_size, target, whole, extra, rest.

    Each of a class's n rows is taken ``whole`` times; the first ``extra`` of them once more, and ``rest`` words of the
    next one. Rows of a class are alike, so which of them comes first makes no difference. Classes, not rows, are what
    windows see, so an id, a missing id or a document that repeats without end is one row there.
    """
    classes = rows.groupBy("source", "doc_id", "size", "h", "h2").agg(F.count("*").alias("n"))
    classes = staged(classes.withColumns({"bucket": F.shiftright("h", 64 - BUCKET_BITS), "words": F.col("size") * F.col("n")}), "sizes")
    per_bucket = classes.groupBy("source", "bucket").agg(F.sum("words").alias("bucket_size"))
    by_source = W.partitionBy("source")
    per_bucket = per_bucket.withColumn("source_size", F.sum("bucket_size").over(by_source)).withColumn("before", F.sum("bucket_size").over(by_source.orderBy("bucket")) - F.col("bucket_size"))
    per_bucket = staged(per_bucket, "buckets")
    per_source = targets(per_bucket.groupBy("source").agg(F.max("source_size").alias("source_size")), weights, max_epochs)
    per_bucket = per_bucket.alias("b").join(per_source.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "b.bucket", "b.before", "s.source_size", "s.target")
    whole = F.least(F.lit(max_epochs), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))).cast("long")
    per_bucket = per_bucket.withColumn("whole", whole).withColumn("left", F.greatest(F.lit(0), F.floor(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")))
    inside = W.partitionBy("source", "bucket").orderBy("h", "h2", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    running_words = classes.withColumn("ahead", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    out = running_words.alias("r").join(per_bucket.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    part = F.when(F.col("p.whole") >= max_epochs, F.lit(0)).otherwise(F.least(F.col("r.words"), F.greatest(F.lit(0), F.col("p.left") - F.col("p.before") - F.col("r.ahead"))))
    out = out.select("r.doc_id", "r.source", "r.size", "r.h", "r.h2", "r.n", "p.source_size", "p.target", "p.whole", part.cast("long").alias("part"))
    return out.withColumns({"extra": F.when(F.col("size") > 0, F.floor(F.col("part") / F.col("size"))).otherwise(F.lit(0)).cast("long"), "rest": F.when(F.col("size") > 0, F.col("part") % F.col("size")).otherwise(F.lit(0)).cast("long")})


def _repeated(rows: DataFrame, n: Column, at: str) -> DataFrame:
    """rows ``n`` times with numbers from 0 in column ``at``, made in two steps so that no long list of numbers is ever held."""
    chunk = rows.withColumn("__n", n).filter("__n > 0").withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / _CHUNK).cast("long"))))
    last = F.least(F.lit(_CHUNK), F.col("__n") - F.col("__chunk") * _CHUNK) - 1
    return chunk.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).withColumn(at, F.col("__chunk") * _CHUNK + F.col("__i")).drop("__n", "__chunk", "__i")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken.

    Each document of a source is taken floor(target/size) times whole. The rest of the target is one fractional
    repetition: in the order of a seeded hash of id and text, documents are taken once more until the rest is used up,
    the last one in part. So the taken words of a source are its target rounded down, and no document exceeds
    ``max_epochs`` times its size. The order needs running sums over a source, which may hold most of the rows: they
    are made of sums per hash bucket, whose few rows a source's window sees, and running sums inside a bucket.

    Null texts and texts without words have size 0 and nothing taken. A null source is a source of its own. Null ids are
    told apart by their texts; rows that repeat in full count as often as they occur, each with a share of its own.
    Other columns don't matter. An empty table gives no rows. Reruns agree, whatever the partitioning.
    """
    h, h2 = _hashes(docs, [key, text], seed)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), h.alias("h"), h2.alias("h2"))
    out = _repeated(_plan(rows, weights, max_epochs), F.col("n"), "i")
    more = F.when(F.col("i") < F.col("extra"), F.col("size")).when(F.col("i") == F.col("extra"), F.col("rest")).otherwise(F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"))


def materialise(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus itself, in the columns of docs: a row for each whole repetition, and for the fractional one a row with the document's first words.

    ``n_chars`` follows a shortened text. A document of which nothing is taken goes; one without any words has nothing to
    give and goes too. Rows that are equal in all columns are first counted together, wherever they are, and then given
    out as often as planned; rows that differ in any column each have a share of their own, whatever their ids. Null ids,
    sources and texts, and empty tables, are as in ``mix``.
    """
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    h, h2 = _hashes(docs, docs.columns, seed)
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], h.alias("h"), h2.alias("h2"))
    doc_id, source, text = names["doc_id"], names["source"], names["text"]
    plan = _plan(rows.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), "h", "h2"), weights, max_epochs)
    plan = plan.select("h", "h2", "size", (F.col("whole") * F.col("n") + F.col("extra")).alias("full"), "rest").filter("size > 0 AND full + rest > 0")
    one = rows.groupBy("h", "h2").agg(*[F.first(n).alias(n) for n in names.values()])
    copies = _repeated(one.join(plan, ["h", "h2"]), F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0), "i")
    cut = F.col("i") == F.col("full")
    head = F.array_join(F.slice(F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), 1, F.greatest(F.col("rest"), F.lit(1)).cast("int")), "")
    shorter = F.when(cut, F.rtrim(head)).otherwise(F.col(text))
    new = {"text": shorter} | ({"n_chars": F.when(cut, F.length(shorter)).otherwise(F.col(names["n_chars"]))} if "n_chars" in names else {})
    return copies.select(*[new.get(c, F.col(n)).cast(docs.schema[c].dataType).alias(c) for c, n in names.items()])
