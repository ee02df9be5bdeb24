"""Cost-balanced packing of tokenised documents into sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CAPACITY, END = 4096, 2
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, for the layers that see tokens and those that see pairs.
LINEAR, QUADRATIC = 1.0, 1 / 2048
#: Documents that are packed together; a task holds at most their last, short pieces: SHARD_DOCS * CAPACITY ids of two bytes.
SHARD_DOCS = 2000
#: Bytes of text that are taken apart at a time, which needs some ten times as many: a batch is worked off in slices, a longer text in parts.
SLICE = 4 << 20
#: Bytes of words, and of their ids, that a worker remembers, of plain ones and of odd ones; beyond that it forgets all but the last slice's, or these too.
REMEMBERED = 4 << 20
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: A word of letters that no tokenizer normalises other than by case, and signs after it that no letter joins.
PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[.,;:!?%$&*#|()\"]*)$"
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions first[i], first[i] + 1, ... of n[i] each, one run after the other; in four bytes if they fit."""
    end = np.cumsum(n, dtype=np.int64)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if max(total, int(first.max(initial=0)) + total) < 1 << 31 else np.int64
    end -= n
    out = np.repeat(np.subtract(first, end, dtype=np.int64).astype(kind), n)
    out += np.arange(total, dtype=kind)
    return out


class _Recent:
    """Two generations of a dict: what is used moves to the young one; when that is full, it becomes the old one and the old one goes."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys) -> list:
        """Those of the distinct keys that aren't known; the others are in ``young`` from now on."""
        new = []
        young, old = self.young, self.old
        for k in keys:
            if k in young:
                continue
            if (v := old.get(k)) is None:
                new.append(k)
            else:
                young[k] = v
        return new

    def age(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class _Known:
    """Ids of the words met last, in three Arrow and numpy arrays: the words, their ids one after the other, how many each has."""

    def __init__(self, tokenise: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.tokenise = tokenise
        self.forget()

    def forget(self) -> None:
        self.words, self.ids, self.n = pa.array([], pa.string()), np.empty(0, dtype="<u2"), np.empty(0, dtype=np.int32)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has."""
        new = words.filter(pc.is_null(pc.index_in(words, self.words)))
        ids, n = self.tokenise(new)
        self.words, self.ids, self.n = pa.concat_arrays([self.words, new]), np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
        at = pc.index_in(words, self.words).to_numpy()
        first, n = (np.cumsum(self.n, dtype=np.int64) - self.n)[at], self.n[at]
        ids = self.ids[_spread(first, n)]
        if self.words.nbytes + self.ids.nbytes > REMEMBERED:
            self.forget()
            if words.nbytes + ids.nbytes <= REMEMBERED:
                self.words, self.ids, self.n = words, ids, n
        return ids, n


class WordTokens:
    """Ids of texts by a tokenizer whose tokens never span white space and whose words end in a token of their own.

    Arrow splits a slice of a batch into words, numbers the distinct ones and takes them apart into plain letters and
    signs after them; distinct plain parts are tokenised in one text, which is what the tokenizer is fast at, and only
    odd words one by one; both are remembered. numpy puts words and texts together from their parts' ids.
    What is held follows from SLICE, not from the batch, the table or a text, but for a text's own ids and a word above SLICE.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("the vocabulary has ids of more than 16 bits")
        self.ends = np.zeros(1 << 16, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.parts, self.odd = _Known(self._of_parts), _Known(self._of_odd)

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2")

    def _of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, each of which is one word to the tokenizer, one after the other, and how many each has."""
        found, n = [np.empty(0, dtype="<u2")], [np.empty(0, dtype=np.int32)]
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096].to_pylist()
            ids = self._one(" ".join(some))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                found.append(ids)
                n.append(np.diff(stops, prepend=0).astype(np.int32))
            else:
                each = [self._one(w) for w in some]
                found += each
                n.append(np.fromiter(map(len, each), dtype=np.int32, count=len(each)))
        return np.concatenate(found), np.concatenate(n)

    def _of_odd(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        each = [self._one(w.as_py()) for w in words]
        return np.concatenate([np.empty(0, dtype="<u2"), *each]), np.fromiter(map(len, each), dtype=np.int32, count=len(each))

    def _of_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, one after the other, and where each text's begin, and their end; null texts have none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
        of = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = pc.dictionary_encode(lists.flatten())
        del lists
        words, at = coded.dictionary, coded.indices.to_numpy()
        apart = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(apart).to_numpy(zero_copy_only=False)
        stem = pc.dictionary_encode(pc.utf8_lower(pc.struct_field(apart, "stem").filter(plain)))
        signs = pc.dictionary_encode(pc.struct_field(apart, "signs").filter(plain))
        del apart
        tables = [self.parts.of(stem.dictionary), self._of_odd(signs.dictionary), self.odd.of(words.filter(~plain))]
        ids, n = np.concatenate([t[0] for t in tables]), np.concatenate([*(t[1] for t in tables), np.zeros(1, dtype=np.int32)])
        first = np.cumsum(n) - n
        item = np.full((len(words), 2), len(n) - 1)  # a word's parts; the last of all is empty
        item[plain, 0] = stem.indices.to_numpy()
        item[plain, 1] = signs.indices.to_numpy().astype(np.int64) + len(tables[0][1])
        item[~plain, 0] = np.arange(len(tables[2][1])) + len(tables[0][1]) + len(tables[1][1])
        flat = item.ravel()
        ids, n = ids[_spread(first[flat], n[flat])], n[item].sum(axis=1, dtype=np.int32)
        first = np.cumsum(n, dtype=np.int64) - n
        length = n[at]
        starts = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[of]
        return ids[_spread(first[at], length)], starts

    def _of_long(self, text: pa.Scalar) -> bytes:
        """Ids of a text of more than SLICE bytes, in parts of about that size that end before white space or with the text."""
        raw, at, found = memoryview(text.as_buffer()), 0, []
        while at < len(raw):
            to = at + SLICE
            while to < len(raw) and (m := SPACE.search(raw[to : to + SLICE])) is None:
                to += SLICE
            to = to + m.start() if to < len(raw) else len(raw)
            found.append(self._of_slice(pa.array([bytes(raw[at:to])], pa.binary()).cast(pa.string()))[0].tobytes())
            at = to
        return b"".join(found)

    def of_texts(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids, of two bytes; null texts have none."""
        end, i, before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64), 0, 0
        while i < len(texts):
            to = int(np.searchsorted(end, before + SLICE, side="right"))
            if to > i:
                ids, starts = self._of_slice(texts[i:to])
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    yield ids[a:b].tobytes()
                del ids
            else:
                yield self._of_long(texts[i])
                to = i + 1
            pa.default_memory_pool().release_unused()
            i, before = to, int(end[to - 1])

    def __call__(self, text: str | None) -> bytes:
        return next(self.of_texts(pa.array([text], pa.string())))


_tokens: dict[str, WordTokens] = {}


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes())


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, and for what is left over at most three whose lengths are powers of two, which need no padding when full."""
    full, rest = divmod(total, capacity)
    out = [capacity] * full
    for left in (2, 1, 0):
        if rest <= 0:
            break
        size = 1 << (rest.bit_length() - 1) if left else 1 << (rest - 1).bit_length()
        out.append(size)
        rest -= size
    return out


def assign(lengths: list[int], caps: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these descending lengths.

    Each document goes to the sequence of lowest cost that has room for it. If none has, it is cut: the roomiest sequence
    is filled up and the rest of the document is assigned as one of that length.
    """
    caps_a = np.array(caps, dtype=np.int64)
    used, cost = np.zeros(len(caps), dtype=np.int64), np.zeros(len(caps))
    out = []
    for i, n in enumerate(lengths):
        start = 0
        while n:
            room = caps_a - used
            fits = room >= n
            k = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            take = min(n, int(room[k]))
            out.append((i, start, take, k, int(used[k])))
            used[k] += take
            cost[k] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return out


class _Shard:
    """The last, short pieces of documents that are packed together: (doc_id, start, length, ids_crc32, doc_tokens, ids)."""

    def __init__(self, capacity: int):
        self.capacity, self.rows = capacity, []

    def packed(self, sequence: int) -> tuple[list[tuple], int]:
        """Rows of all pieces in sequences from the given number on, and the next number. The shard is empty again."""
        rows = sorted(self.rows, key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1], r[3]))
        self.rows, out, caps = [], [], capacities(sum(r[2] for r in rows), self.capacity)
        for i, start, n, k, offset in assign([r[2] for r in rows], caps):
            key, first, length, crc, tokens, ids = rows[i]
            out.append((key, first + start, n, crc if n == length else crc32_of(ids[2 * start : 2 * (start + n)]), tokens, sequence + k, offset))
        return out, sequence + len(caps)


def _pack(name: str, end: int, capacity: int, shard_docs: int):
    """Tokenises documents and cuts them every ``capacity`` ids: full pieces are sequences, the last ones go to the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import SparkFiles, TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = SparkFiles.get(name)
        tokens = _tokens.setdefault(path, None) or _tokens.__setitem__(path, WordTokens(path)) or _tokens[path]
        last, shard, sequence = end.to_bytes(2, "little"), _Shard(capacity), TaskContext.get().partitionId() << 32
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in PACKED.split(", ")])
        for b in batches:
            rows: list[tuple] = []
            for key, ids in zip(b.column(0).to_pylist(), tokens.of_texts(b.column(1))):
                ids += last
                n = len(ids) // 2
                for at in range(0, n, capacity):
                    piece = ids[2 * at : 2 * (at + capacity)]
                    crc = crc32_of(piece)
                    if len(piece) == 2 * capacity:
                        rows.append((key, at, capacity, crc, n, sequence, 0))
                        sequence += 1
                    else:
                        shard.rows.append((key, at, len(piece) // 2, crc, n, piece))
                if len(shard.rows) >= shard_docs:
                    more, sequence = shard.packed(sequence)
                    rows += more
            if rows:
                yield batch(rows)
        if shard.rows:
            yield batch(shard.packed(sequence)[0])

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids, and ``end`` after them, are cut every ``capacity`` ids; full pieces are sequences of their own.
    The last pieces of ``shard_docs`` documents at a time, in the order in which a task reads them, are packed together:
    in descending length each goes to the sequence of lowest estimated cost, linear plus quadratic, that has room. There
    are only as many sequences as the ids need, so the padding of a shard is under an eighth of one sequence. A task's
    number and a count make a sequence's id.

    Each document is packed where it is read: nothing is shuffled, so no id, null or repeated, gathers rows, and a task
    holds one shard. A task that is run again must read the same rows in the same order, so docs should be a written
    table, as the pipeline's stages are. ``tokenizer`` is a file whose tokens don't span white space and whose ids fit 16
    bits; it is sent to the executors. Null and empty texts are the end id alone. Null ids are packed like others; rows
    that repeat an id are packed each by itself and share their ids' starts. Other columns don't matter; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    spark.sparkContext.addFile(tokenizer)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_pack(tokenizer.rsplit("/", 1)[-1], end, capacity, shard_docs), PACKED)
