"""URL filtering by association rules that FP-growth mines from labelled URLs; rules match through an inverted index."""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import if_small
from .common import ascii_lower, release, staged

#: (host, path) rules as the contract of the URL filter fixes them.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: Sets of tokens whose rules the model itself holds at most: where more reach the support, all rules are a table, which URLs meet in a join.
MAX_SETS = 100_000
#: How a label stands among a row's items; no token begins like this.
_LABEL = "="


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end. Null or no ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null where none fits. A rule fits its host and all subdomains if the path starts with the rule's path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, path segments and query keys, each with its role. Digits become ``0``, so ids don't count as words of their own."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\d+", "0")
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    tail = F.regexp_extract(url, r"[?#](.*)$", 1)
    keys = F.transform(F.split(tail, r"[&;#?]"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^([^=]*)", 1)))
    parts = F.transform(F.split(plain(path), "[/.]"), lambda x: F.concat(F.lit("p:"), x))
    labels = F.transform(F.split(plain(host), r"\."), lambda x: F.concat(F.lit("h:"), x))
    every = F.concat(F.array(F.concat(F.lit("s:"), F.lower(scheme))), labels, parts, keys)
    return F.array_distinct(F.filter(F.coalesce(every, F.array().cast("array<string>")), lambda x: F.length(x) > 2))


@dataclass(frozen=True)
class RuleModel:
    """Rules (tokens, verdict, confidence, support), best first, the verdict where none matches, how often each token was seen, and for each token of the rules those that stand for it: itself and all that occurred in exactly the same rows.

    Where there are too many rules to hold, ``table`` has them all (left, label, confidence, freq), ``rules`` only those of
    the largest support, and ``verdict`` knows only these; ``verdicts`` takes the table.
    """

    rules: tuple
    default: str
    seen: dict = field(default_factory=dict)
    alike: dict = field(default_factory=dict)
    table: DataFrame | None = None

    def index(self) -> dict[str, list[int]]:
        """Inverted index: each rule stands under the rarest of its tokens, so a URL without that token never looks at it."""
        out: dict[str, list[int]] = {}
        for i, (items, *_) in enumerate(self.rules):
            out.setdefault(min(items, key=lambda t: (self.seen.get(t, 0), t)), []).append(i)
        return out

    def verdict(self, toks: Column) -> Column:
        """The verdict of the best rule all of whose tokens a URL has: postings of the URL's tokens, each checked against its tokens, however many there are. Linear in tokens and postings."""
        if not self.rules:
            return F.lit(self.default)
        number = {t: i for i, t in enumerate(sorted({t for items, *_ in self.rules for t in items}))}
        ids = known(toks, {a: i for t, i in number.items() for a in self.alike.get(t, (t,))})
        index = self.index()
        postings = _constant([[{"i": i, "need": [number[t] for t in self.rules[i][0]]} for i in index.get(t, ())] for t in number], "array<array<struct<i:int,need:array<int>>>>")
        verdicts = _constant([v for _, v, *_ in self.rules], "array<string>")

        def best(has: Column) -> Column:
            near = F.flatten(F.transform(has, lambda t: F.get(postings, t)))
            return F.array_min(F.transform(F.filter(near, lambda x: F.size(F.array_except(x["need"], has)) == 0), lambda x: x["i"]))

        first = F.get(F.transform(F.array(ids), best), F.lit(0))  # a lambda, so that the ids are found once
        return F.coalesce(F.get(verdicts, first), F.lit(self.default))

    def verdicts(self, urls: DataFrame, toks: Column) -> DataFrame:
        """urls with ``mined``, the verdict of the best rule that matches, of all rules.

        Without a table that is ``verdict``. With one, tokens are numbered, the rarest first; each distinct set of them
        meets the rules whose rarest token it has, and of those that it holds the best stays.
        """
        if self.table is None:
            return urls.withColumn("mined", self.verdict(toks))
        number = {t: i for i, t in enumerate(sorted(self.seen, key=lambda t: (self.seen[t], t)))}
        rules = self.table.withColumn("need", known(F.col("left"), number))
        order = F.struct((-F.col("confidence")).alias("c"), (-F.col("freq")).alias("f"), F.size("left").alias("n"), F.array_join("left", " ").alias("t"), "label")
        rules = rules.select(F.get("need", F.lit(0)).alias("at"), "need", order.alias("rank"))
        urls = urls.withColumn("__has", known(toks, {a: i for t, i in number.items() for a in self.alike.get(t, (t,))}))
        sets = urls.select("__has").distinct().select("__has", F.explode("__has").alias("at"))
        fits = sets.join(rules, "at").filter(F.size(F.array_except("need", "__has")) == 0)
        best = staged(fits.groupBy("__has").agg(F.min("rank").alias("rank")).select("__has", F.col("rank.label").alias("mined")), "best")
        return urls.join(if_small(best), "__has", "left").drop("__has").withColumn("mined", F.coalesce("mined", F.lit(self.default)))


def undominated(rules: list[tuple], seen: dict[str, int]) -> list[tuple]:
    """Rules, best first, without those that hold all tokens of a better one: wherever they match, that one does."""
    kept: list[tuple] = []
    under: dict[str, list[frozenset]] = {}  # better rules by their rarest token
    for r in rules:
        items = frozenset(r[0])
        if not any(b <= items for t in items for b in under.get(t, ())):
            kept.append(r)
            under.setdefault(min(items, key=lambda t: (seen.get(t, 0), t)), []).append(items)
    return kept


def _constant(value, kind: str) -> Column:
    """A nested constant, which the optimizer folds; column by column a large one would take long to build."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def known(toks: Column, ids: dict[str, int]) -> Column:
    """Distinct ids of those tokens that have one, ascending. A token looks into one hash bucket, however many tokens have ids."""
    buckets: list[list[dict]] = [[] for _ in range(max(1, len(ids)))]
    for t, i in sorted(ids.items()):
        buckets[zlib.crc32(t.encode()) % len(buckets)].append({"t": t, "i": i})
    table = _constant(buckets, "array<array<struct<t:string,i:int>>>")
    found = F.transform(toks, lambda t: F.transform(F.filter(F.get(table, (F.crc32(t.cast("binary")) % len(buckets)).cast("int")), lambda x: x["t"] == t), lambda x: x["i"]))
    return F.array_sort(F.array_distinct(F.flatten(found)))


def frequent_sets(rows: DataFrame, n: int, least: int) -> DataFrame:
    """(items, freq) of all sets of items, of any length, that occur in ``least`` of the n rows, by Spark's FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    return FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n)).fit(rows).freqItemsets


def rules_of(found: DataFrame, min_confidence: float) -> DataFrame:
    """left, label, confidence, freq of the rules from tokens to a label that frequent sets of tokens and label give."""
    of = lambda x: F.startswith(x, F.lit(_LABEL))
    parts = found.select(F.array_sort(F.filter("items", lambda x: ~of(x))).alias("left"), F.get(F.filter("items", of), F.lit(0)).alias("label"), "freq")
    sets = parts.groupBy("left").agg(F.max(F.when(F.col("label").isNull(), F.col("freq"))).alias("n"), F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "freq"))).alias("by"))
    each = sets.filter(F.size("left") > 0).select("left", "n", F.inline("by")).filter(F.col("freq") >= min_confidence * F.col("n"))
    return each.select("left", F.substring("label", len(_LABEL) + 1, 1 << 20).alias("label"), (F.col("freq") / F.col("n")).alias("confidence"), "freq")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_sets: int = MAX_SETS) -> RuleModel:
    """Mines (tokens, label) rows into a RuleModel by Spark's FP-growth over tokens and label.

    All labelled rows count. Mined are all tokens that reach the support; of tokens that occur in exactly the same rows
    one stands for all in the rules, and a URL that has any of them matches. So the sets stay few even where thousands of
    URLs share many tokens. Rules below the support or confidence go; the rest is ordered by confidence, support, then
    tokens, and loses what a better rule makes idle. Where more than ``max_sets`` sets reach the support, all rules are
    the model's table, read when it is asked, and ``rules`` are those of the support that fewer reach. No labelled rows: no rules,
    default ``allow``. Rows with null tokens or label don't count.
    """
    rows = labelled.filter("tokens IS NOT NULL AND label IS NOT NULL").select(F.array_distinct("tokens").alias("tokens"), "label")
    rows = staged(rows, "labelled")
    by_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(by_label.values())
    if not n:
        return RuleModel((), "allow")
    default = min(by_label, key=lambda v: (-by_label[v], v))
    least = max(1, math.ceil(min_support * n))
    kinds = rows.groupBy("tokens", "label").agg(F.count("*").alias("n"))
    seen = kinds.select(F.explode("tokens").alias("t"), "n", F.xxhash64(F.array_sort("tokens"), "label").cast("decimal(38,0)").alias("h"))
    seen = seen.groupBy("t").agg(F.sum("n").alias("n"), F.sum("h").alias("sig")).filter(F.col("n") >= least)
    same = {(ts := sorted(r["ts"]))[0]: (ts, r["n"]) for r in seen.groupBy("n", "sig").agg(F.collect_list("t").alias("ts")).collect()}
    frequency, alike = {t: k for t, (_, k) in same.items()}, {t: tuple(ts) for t, (ts, _) in same.items()}
    vocabulary = sorted(frequency)
    names = _constant(vocabulary, "array<string>")
    items = F.transform(known(F.col("tokens"), {t: i for i, t in enumerate(vocabulary)}), lambda i: F.get(names, i))
    baskets = rows.select(F.array_append(items, F.concat(F.lit(_LABEL), "label")).alias("items"))
    found, table = frequent_sets(baskets, n, least), None
    while found.limit(max_sets + 1).count() > max_sets:
        table = rules_of(found, min_confidence) if table is None else table
        least *= 2
        found = frequent_sets(baskets, n, least)
    rules = [(tuple(r["left"]), r["label"], r["confidence"], r["freq"]) for r in rules_of(found, min_confidence).collect()]
    rules.sort(key=lambda r: (-r[2], -r[3], len(r[0]), " ".join(r[0]), r[1]))
    if table is None:
        release(rows)  # else the table is yet to be read from them
    kept = undominated([(left, v, confidence, c / n) for left, v, confidence, c in rules], frequency)
    return RuleModel(tuple(kept), default, frequency, alike, table)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict per row. The given rules label the URLs they fit; rules mined from those labels judge the others.

    Null urls and urls without ``://`` have empty host and path and the verdict of the mined rules' default. Repeated
    rows are judged alike; other columns don't matter. An empty table gives no rows. While the model holds all rules, every
    step is a column expression: judging needs no shuffle, whatever host or token is common.
    """
    u = F.col(url)
    host, path = host_and_path(u)
    parsed = pages.select(F.col(key).alias("page_id"), u.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("label"))
    toks = tokens(F.col("url"), F.col("host"), F.col("path"))
    model = mine(parsed.filter("label IS NOT NULL").select(toks.alias("tokens"), "label"), **options)
    given, others = parsed.filter("label IS NOT NULL").withColumn("mined", F.lit(None).cast("string")), parsed.filter("label IS NULL")
    every = model.verdicts(parsed, toks) if model.table is None else given.unionByName(model.verdicts(others, toks))
    return every.select("page_id", "host", "path", "rule", F.coalesce("label", "mined").alias("verdict"))
