"""Phrase collocations: count tries of shards, merged by ranges of their paths, and the score of each phrase's weakest cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, staged

MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
UNKNOWN = "und"
#: Bytes of text that are split at once, words of a shard, and paths of a range that a merging task is meant to hold.
WINDOW, SHARD_WORDS, RANGE_PATHS = 1 << 21, 800_000, 500_000
#: Documents from which the ranges' borders are drawn; paths of them that reach the driver at most, and of how many one does; characters
#: of their words. Any borders give the same result.
BORDER_DOCS, BORDER_PATHS, BORDER_EVERY, BORDER_CHARS = 2000, 20_000, 100, 64
#: Bits of the map of frequent pairs, for each pair, and at least and most in all. A pair that shares a bit is counted for nothing, and goes later.
PAIR_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
#: Parts in which a language's phrases are ranked before their best are ranked together.
DEALS = 32
_BUCKET = 32768  # bits of one of Spark's bitmaps

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


def _windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of a batch's bytes into windows that end with a text or a piece; a longer piece is a window of its own."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = at + WINDOW
        while stop < end:
            cuts = np.flatnonzero(_KIND[data[stop - WINDOW : stop]] == 2)
            i = int(np.searchsorted(offsets, stop, side="right")) - 1
            cut = max(int(offsets[i]), stop - WINDOW + int(cuts[-1]) + 1 if len(cuts) else 0)
            if cut > at:
                stop = cut
                break
            stop += WINDOW
        yield at, min(stop, end)
        at = min(stop, end)


def _words(raw: np.ndarray, begins: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The lower-cased words of bytes in which texts begin at the given places: dictionary-encoded, where each begins, and a number that tells pieces apart."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[begins] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    places = np.flatnonzero(edge)
    starts = places[:-1][inside[places[:-1]]]
    ends = places[1:][inside[places[:-1]]]
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] + np.searchsorted(begins, starts, side="right")
    bounds = np.append(np.stack([starts, ends], axis=1).ravel(), len(raw)).astype(np.int32)
    both = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw.tobytes()))
    return pc.dictionary_encode(both.take(pa.array(np.arange(0, len(both), 2)))), starts, piece


def _counted(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of small numbers, ascending, and how often each occurs (or the sum of its counts)."""
    bits = max(1, max(int(c.max(initial=0)) for c in columns).bit_length())
    per = max(1, 63 // bits)
    keys = []
    for i in range(0, len(columns), per):
        key = np.zeros(len(columns[0]), dtype=np.int64)
        for c in columns[i : i + per]:
            key = (key << bits) | c
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(order))) if counts is None else np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    return [c[order[at]] for c in columns], n


class Shard:
    """Words of a bounded stretch of texts, and the count trie over them: for each position the path of at most ``depth`` words of its piece."""

    def __init__(self, depth: int, pairs: np.ndarray | None):
        self.depth, self.pairs = depth, pairs
        self.words: list[pa.DictionaryArray] = []
        self.pieces, self.langs, self.n, self.piece = [], [], 0, 0

    def add(self, words: pa.DictionaryArray, piece: np.ndarray, lang: np.ndarray) -> None:
        self.words.append(words)
        self.pieces.append(piece.astype(np.int64) + self.piece)
        self.langs.append(lang)
        self.n += len(piece)
        self.piece += int(piece[-1]) + 1

    def paths(self, langs: list[str]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
        """(words, columns, counts): the trie as its distinct paths in order. Columns are the language's place among the sorted ones, then places of words plus one; 0 is beyond the end."""
        one = pa.chunked_array(self.words).unify_dictionaries()
        seen = one.chunk(0).dictionary
        order = pc.sort_indices(seen)
        rank = np.empty(len(seen), dtype=np.int64)
        rank[order.to_numpy()] = np.arange(1, len(seen) + 1)
        words = seen.take(order).to_pylist()
        code, piece = rank[np.concatenate([c.indices.to_numpy() for c in one.chunks])], np.concatenate(self.pieces)
        by_lang = {x: i for i, x in enumerate(sorted(langs))}
        lang = np.array([by_lang[x] for x in langs], dtype=np.int64)[np.concatenate(self.langs)]
        goes_on = np.zeros(len(code), dtype=bool)
        goes_on[:-1] = piece[1:] == piece[:-1]
        if self.pairs is not None:
            mark = np.array([_mark(w) for w in words], dtype=np.int64)[code - 1]
            slot = _slot(np.array([_mark(x) for x in sorted(langs)], dtype=np.int64)[lang][:-1], mark[:-1], mark[1:], 8 * len(self.pairs))
            goes_on[:-1] &= (self.pairs[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        columns, valid = [lang, code], np.ones(len(code), dtype=bool)
        for d in range(1, self.depth):
            step = np.zeros(len(code), dtype=bool)
            step[: len(code) - d + 1] = goes_on[d - 1 :]
            valid = valid & step
            column = np.zeros(len(code), dtype=np.int64)
            column[: len(code) - d] = code[d:]
            columns.append(np.where(valid, column, 0))
        return words, *_counted(columns)


def _mark(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def _slot(lang, first, second, bits: int):
    """The bit of a pair of words; in numpy and in Spark the same whole numbers."""
    return (lang * 31 + first * 1_000_003 + second) % bits


def _cut(words: list[str], columns: list[np.ndarray], lang: int, border: list[str]) -> int:
    """How many paths stand before a border's."""
    from bisect import bisect_left

    low, high = np.searchsorted(columns[0], [lang, lang + 1])
    for column, w in zip(columns[1:], border):
        i = bisect_left(words, w)
        part = column[low:high]
        if i == len(words) or words[i] != w:
            return int(low + np.searchsorted(part, i + 1))
        low, high = low + np.searchsorted(part, i + 1), low + np.searchsorted(part, i + 1, side="right")
    return int(low)


def _tries(depth: int, pairs, borders: list[tuple[str, list[str]]] | None, shard_words: int):
    """Texts to blocks of their shards' tries. With borders: (range, lang, words, paths, counts); without: (lang, words) of a share of the paths."""

    def blocks(shard: Shard, langs: list[str]) -> Iterator[tuple]:
        words, columns, counts = shard.paths(langs)
        names = sorted(langs)
        if borders is None:
            for i in range(0, len(counts), BORDER_EVERY):
                yield names[columns[0][i]], [words[c[i] - 1][:BORDER_CHARS] for c in columns[1:] if c[i]]
            return
        text = np.array(words, dtype=object)
        for k in np.unique(columns[0]).tolist():
            ends = np.searchsorted(columns[0], [k, k + 1])
            cuts = [(i + 1, _cut(words, columns, k, b)) for i, (x, b) in enumerate(borders) if x == names[k]]
            first = sum(1 for x, _ in borders if x < names[k])
            for (r, low), (_, high) in zip([(first, int(ends[0])), *cuts], [*cuts, (0, int(ends[1]))]):
                if low < high:
                    part = [c[low:high] for c in columns[1:]]
                    used = np.unique(np.concatenate(part))
                    used = used[used > 0]
                    codes = np.stack([np.searchsorted(used, c) + (c > 0) for c in part]).astype(np.int32)
                    yield r, names[k], "\n".join(text[used - 1]), codes.tobytes(), counts[low:high].astype(np.int64).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, langs = {}, []
        bits = None if pairs is None else np.frombuffer(pairs.value, dtype=np.uint8)
        shard = Shard(depth, bits)
        fields = ["range", "lang", "words", "paths", "counts"] if borders is not None else ["lang", "words"]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary()] if borders is not None else [pa.string(), pa.list_(pa.string())]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, known, langs
            for row in blocks(shard, langs) if shard.n else ():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], fields)
            shard, known, langs = Shard(depth, bits), {}, []

        for b in batches:
            texts = b.column(1).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
            of = b.column(0).to_pylist()
            for at, stop in _windows(data, offsets):
                low, high = np.searchsorted(offsets, [at, stop])
                words, starts, piece = _words(data[at:stop], np.unique(offsets[low:high]) - at)
                if not len(starts):
                    continue
                owner = np.searchsorted(offsets, starts + at, side="right") - 1
                for i in np.unique(owner).tolist():
                    if of[i] not in known:
                        known[of[i]] = len(langs)
                        langs.append(of[i])
                shard.add(words, piece, np.array([known.get(x, 0) for x in of], dtype=np.int64)[owner])
                if shard.n >= shard_words:
                    yield from flush()
        yield from flush()

    return run


class _Merge:
    """Sorted runs of paths of one range and language, merged as they come; at most about twice the distinct paths are held."""

    def __init__(self, depth: int):
        self.depth, self.runs, self.rows, self.held = depth, [], 0, 0

    def add(self, words: str, paths: bytes, counts: bytes) -> None:
        n = np.frombuffer(counts, dtype=np.int64)
        self.runs.append((words.split("\n"), np.frombuffer(paths, dtype=np.int32).reshape(self.depth, -1), n))
        self.rows += len(n)
        if self.rows > max(RANGE_PATHS, 2 * self.held):
            self.merge()

    def merge(self) -> tuple[list[str], list[np.ndarray], np.ndarray]:
        words = sorted(set().union(*(w for w, _, _ in self.runs)))
        place = {w: i + 1 for i, w in enumerate(words)}
        columns = [np.array([0, *(place[x] for x in w)], dtype=np.int64)[codes] for w, codes, _ in self.runs]
        paths, n = _counted([np.concatenate([c[d] for c in columns]) for d in range(self.depth)], np.concatenate([n for _, _, n in self.runs]))
        self.runs, self.rows, self.held = [(words, np.stack(paths), n)], len(n), len(n)
        return words, paths, n


def nodes(words: list[str], paths: list[np.ndarray], counts: np.ndarray, least: int) -> Iterator[tuple]:
    """(words, f, border, lefts) of a trie's nodes that reach ``least``, and of those at its borders, which may go on in the next range.

    A walk over the sorted paths: the runs of equal first d words are the nodes of depth d, and a node's ancestors are the
    runs that it lies in; ``lefts`` are their counts, -1 for one that is at a border. The root is at both.
    """
    n = len(counts)
    change = np.zeros(n, dtype=bool)
    change[:1] = True
    above: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(len(paths) + 1):
        if d:
            change[1:] |= paths[d - 1][1:] != paths[d - 1][:-1]
        at = np.flatnonzero(change)
        f = np.add.reduceat(counts, at)
        border = np.zeros(len(at), dtype=bool)
        border[[0, -1]] = True
        valid = paths[d - 1][at] > 0 if d else np.ones(1, dtype=bool)
        for i in np.flatnonzero(valid & (border | (f >= least))).tolist():
            p = int(at[i])
            yield [words[paths[j][p] - 1] for j in range(d)], int(f[i]), bool(border[i]), [int(x[run[p]]) for x, run in above[1:]]
        above.append((np.where(border, -1, f), np.cumsum(change) - 1))


def _merged(depth: int, least: int):
    """The blocks of a partition, ordered by range and language, to nodes of the merged tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, merge = None, _Merge(depth)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal merge
            found = list(nodes(*merge.merge(), least)) if merge.runs else []
            for i in range(0, len(found), 10_000):
                words, f, border, lefts = zip(*found[i : i + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array([group[1]] * len(f), pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(f, pa.int64()), pa.array(border), pa.array(lefts, pa.list_(pa.int64()))], ["lang", "words", "f", "border", "lefts"])
            merge = _Merge(depth)

        for b in batches:
            for r in b.to_pylist():
                if (r["range"], r["lang"]) != group:
                    yield from flush()
                    group = (r["range"], r["lang"])
                merge.add(r["words"], r["paths"], r["counts"])
        yield from flush()

    return run


def frequent_phrases(texts: DataFrame, depth: int, least: int, pairs=None, shard_words: int = SHARD_WORDS, range_paths: int = RANGE_PATHS) -> DataFrame:
    """(lang, words, f, lefts) of phrases of at most ``depth`` words that occur ``least`` times in a language, and the root of each, without words, whose f is the number of all words.

    Tasks build tries of shards, cut their sorted paths at the ranges' borders and send the blocks to the ranges, whose
    tasks merge them. A phrase that many texts share is one path of a shard. ``pairs``, a broadcast bit map, ends paths
    before pairs of words that aren't in it. Where a node lies in several ranges its parts are added up; ``lefts`` are
    the counts of its first words, -1 where such a one lies in several ranges.
    """
    spark = texts.sparkSession
    n = texts.count()
    share = min(1.0, BORDER_DOCS / max(1, n))
    some = texts.sample(share, 5) if share < 1 else texts
    drawn = some.mapInArrow(_tries(depth, pairs, None, shard_words), "lang string, words array<string>").limit(BORDER_PATHS).collect()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(len(drawn) * BORDER_EVERY / share / range_paths))
    keys = sorted((r["lang"], r["words"]) for r in drawn)
    borders = sorted({(x, tuple(w)) for x, w in (keys[len(keys) * i // wanted] for i in range(1, wanted))}) if keys else []
    ranges = len(borders) + 1
    blocks = texts.mapInArrow(_tries(depth, pairs, [(x, list(w)) for x, w in borders], shard_words), "range int, lang string, words string, paths binary, counts binary")
    dealt = blocks.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "lang")
    found = staged(dealt.mapInArrow(_merged(depth, least), "lang string, words array<string>, f long, border boolean, lefts array<long>"), "nodes")
    parts = found.filter("border").groupBy("lang", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.size("words") == 0))
    parts = parts.withColumn("lefts", F.transform(F.slice("words", 2, depth), lambda _: F.lit(-1).cast("long")))
    return found.filter("NOT border").select("lang", "words", "f", "lefts").unionByName(parts)


def pair_map(phrases: DataFrame):
    """A broadcast bit map of the pairs of words among phrases; other pairs may share their bits. Its size has a fixed bound."""
    spark = phrases.sparkSession
    pairs = phrases.filter(F.size("words") == 2)
    bits = LEAST_BITS
    while bits < min(MOST_BITS, PAIR_BITS * pairs.count()):
        bits *= 2
    mark = lambda c: F.crc32(c.cast("binary"))
    slot = _slot(mark(F.col("lang")), mark(F.get("words", F.lit(0))), mark(F.get("words", F.lit(1))), bits) + 1
    made = pairs.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    out = bytearray(bits // 8)
    for r in made.toLocalIterator():
        out[(r["b"] - 1) * _BUCKET // 8 : r["b"] * _BUCKET // 8] = r["bits"]
    return spark.sparkContext.broadcast(bytes(out))


def scored(phrases: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among all frequent phrases that no longer one replaces.

    A phrase inside a longer one that is as frequent is also inside one that has a word more, and is as frequent: so only
    a phrase's children and those it is the suffix of are looked at. Left parts come with a phrase from its trie, or, where
    that was cut, from the nodes that lie in several ranges; right parts are the nodes that suffix links lead to.
    """
    phrases = staged(phrases, "phrases")
    totals = phrases.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    longer = phrases.filter(F.size("words") > 2).select("lang", "f", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"))
    longer = longer.groupBy("lang", "words").agg(F.max("f").alias("longer"))
    kept = phrases.filter((F.size("words") > 1) & (F.col("f") >= least)).join(longer, ["lang", "words"], "left")
    kept = kept.filter(F.col("longer").isNull() | (F.col("longer") < F.col("f")))
    cuts = kept.select("lang", "words", F.col("f").alias("a"), F.posexplode("lefts").alias("cut", "l")).withColumn("cut", F.col("cut") + 1)
    cuts = cuts.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut", "l", F.expr("slice(words, 1, cut)").alias("left"), F.expr("slice(words, cut + 1, size(words))").alias("words"))
    cuts = cuts.join(phrases.select("lang", "words", F.col("f").alias("r")), ["lang", "words"])
    spread = cuts.filter("l < 0").drop("l").join(phrases.filter(F.array_contains("lefts", -1) | (F.size("words") < 2)).select("lang", F.col("words").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.filter("l >= 0").select("lang", "phrase", "a", "cut", "l", "r").unionByName(spread.select("lang", "phrase", "a", "cut", "l", "r")).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("top", F.lit(1000).cast("decimal(5,0)") * exact("a") * exact("n")).withColumn("bottom", exact("l") * exact("r"))
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    return weakest.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, top: int = TOP, max_words: int = MAX_WORDS, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases of 2 to ``max_words`` words that occur ``least`` times.

    A first pass with tries of depth two finds the frequent pairs of words; in the second, of full depth, a path ends
    before a pair that isn't frequent, for no phrase over it can be. What is left for the scores are frequent phrases.
    ``sizes`` are shard_words and range_paths, which change no result.

    A null language is ``und``, a null text the empty one; texts without words and tables without rows give none. Equal
    rows each count, other columns don't matter. Texts are cut between pieces; only a piece is held as a whole.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    pairs = pair_map(frequent_phrases(rows, 2, least, **sizes))
    best = scored(frequent_phrases(rows, max_words, least, pairs, **sizes), least)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    dealt = best.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALS)))
    first = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    return last.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
