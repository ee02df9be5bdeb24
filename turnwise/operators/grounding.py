"""Passages against a corpus: whole, and by windows of tokens that hold most of a passage's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stage import if_small, is_small, staged

MIN_OVERLAP = 0.8
TOKEN = r"(?U)\w+|\[\w+\]"


def held(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, doc_id of passages (item_id, q) that documents (doc_id, t) hold, both normalised.

    A passage's longest inner word stands whole in every text that holds the passage: only texts with that word are
    searched. Passages of one or two words have no inner word; they alone are looked for in all texts.
    """
    passages = staged(passages, "passages")
    inner = F.slice(F.split("q", " "), F.lit(2), F.greatest(F.size(F.split("q", " ")) - 2, F.lit(0)))
    keyed = passages.withColumn("key", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    long = keyed.filter("key IS NOT NULL")
    keys = long.select("key").distinct()
    if is_small(keys):  # one row with all keys goes to the texts
        near = documents.crossJoin(F.broadcast(keys.agg(F.collect_list("key").alias("keys")))).withColumn("key", F.explode(F.array_intersect(F.split("t", " "), F.col("keys"))))
    else:
        words = documents.select("doc_id", F.explode(F.array_distinct(F.split("t", " "))).alias("key"))
        near = documents.join(words.join(keys, "key"), "doc_id")
    found = near.join(if_small(long), "key").filter(F.contains("t", F.col("q"))).select("item_id", "doc_id")
    short = keyed.filter("key IS NULL")
    return found.unionByName(documents.join(if_small(short), F.contains("t", F.col("q"))).select("item_id", "doc_id"))


def window_overlaps(passages: DataFrame, documents: DataFrame, least: float = MIN_OVERLAP) -> DataFrame:
    """item_id, doc_id, score of passages (item_id, q) that documents (doc_id, t) bear out at ``least`` or more, both normalised.

    The score is 1 where a text holds the passage; else the best share of the passage's distinct tokens in a window of
    its length plus two. A window of that share holds one of the passage's rarest tokens, one more than may be missing:
    only positions of those are looked at, and only the windows over them. Rarity is counted in the documents. Passages
    and documents without tokens, and null ones, have only exact matches.
    """
    tokens = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(TOKEN), 0)
    exact = held(passages, documents).distinct().withColumn("score", F.lit(1.0))
    p = passages.select("item_id", tokens("q").alias("e")).filter(F.size("e") > 0)
    p = staged(p.select("item_id", F.size("e").alias("n"), F.array_distinct("e").alias("e")).withColumn("m", F.size("e")), "passages")
    d = staged(documents.select("doc_id", tokens("t").alias("tk")), "tokens")
    words = p.select("item_id", "m", F.explode("e").alias("token"))
    places = d.select("doc_id", F.posexplode("tk").alias("pos", "token")).join(if_small(words.select("token").distinct()), "token")
    places = staged(places, "places")
    seen = words.join(places.groupBy("token").agg(F.count("*").alias("df")), "token", "left").fillna(0, ["df"])
    rarest = F.row_number().over(W.partitionBy("item_id").orderBy("df", "token"))
    prefix = seen.withColumn("r", rarest).filter(F.col("r") <= F.col("m") - F.ceil(F.col("m") * least - 1e-9) + 1).select("item_id", "token")
    near = places.join(if_small(prefix), "token").groupBy("item_id", "doc_id").agg(F.collect_set("pos").alias("at"))
    near = near.join(if_small(p), "item_id").join(d, "doc_id")
    last = F.greatest(F.lit(0), F.size("tk") - F.col("n"))
    starts = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(F.least(last, F.greatest(F.lit(0), x - F.col("n") - 1)), F.least(last, x)))))
    share = lambda s: F.size(F.array_intersect("e", F.slice("tk", s + 1, F.col("n") + 2))) / F.col("m")
    close = near.select("item_id", "doc_id", F.array_max(F.transform(starts, share)).alias("score")).filter(F.col("score") >= least - 1e-9)
    return exact.unionByName(close).groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
