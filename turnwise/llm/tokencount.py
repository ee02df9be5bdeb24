"""Token counts by a tokenizer that is compiled to a finite-state transducer; state maps of chunks compose in a prefix scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .packing import _Recent, _spread

LIMIT = 4096
#: Characters of a chunk at most, bytes of text that are worked on at once, states that a worker keeps between them, and
#: chunks whose counts it remembers. None of them changes a result.
CHUNK, WINDOW, STATES, REMEMBERED = 64, 1 << 21, 150_000, 200_000
SPACE = "▁"
COUNTED = "doc_id {}, n_bytes long, n_tokens long, over_limit boolean"
FRESH = 0


class Merges:
    """A vocabulary of scored pieces, in which the best adjacent pair that is a piece is merged, the first one of equals, until none is.

    A sequence of pieces is the result of that if and only if each two neighbours are the result for their own text: a
    merge across one of its borders would happen in those two alone as well.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.split: dict[str, tuple[str, str] | None] = {}
        self.right: dict[str, list[str]] = {}
        self.left: dict[str, list[str]] = {}
        self.plain: dict[str, bool] = {}
        seen: dict[float, int] = {}
        for p, s in scores.items():
            if len(p) > 1:
                seen[s] = seen.get(s, 0) + 1
        self.shared = {s for s, n in seen.items() if n > 1}

    def encode(self, text: str) -> list[str]:
        """The pieces of a text, by the rule itself; for short texts."""
        return self._encode(text)[0]

    def _encode(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        parts, last = list(text), None
        while len(parts) > 1:
            found = [(self.scores[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.scores]
            if not found:
                break
            i = -max(found)[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def proper(self, piece: str) -> bool:
        """Whether the piece is the result for its own text; the others never occur."""
        if piece not in self.split:
            parts, last = self._encode(piece)
            self.split[piece] = last if len(parts) == 1 else None
            self.plain[piece] = len(piece) == 1
            if len(parts) == 1 and len(piece) > 1:
                self.plain[piece] = self.scores[piece] not in self.shared and all(self.proper(p) and self.plain[p] and (len(p) == 1 or self.scores[p] > self.scores[piece]) for p in last)
        return len(piece) == 1 or self.split[piece] is not None

    def _edge(self, piece: str, side: int, known: dict[str, list[str]]) -> list[str]:
        """What stands at the piece's left (0) or right (1) end while it is built, from a character to the piece."""
        found = known.get(piece)
        if found is None:
            found = known[piece] = [piece] if len(piece) == 1 else [*self._edge(self.split[piece][side], side, known), piece]
        return found

    def neighbours(self, a: str, b: str) -> bool:
        """Whether the pieces for the text a + b are a and b.

        Where each piece scores lower than its parts and no other piece scores alike, both are built in the order of the
        scores, and a merge across happens if it scores better than what takes either side further (a tie goes to the left).
        """
        if not (self.plain[a] and self.plain[b]):
            return self.encode(a + b) == [a, b]
        ends, begins = self._edge(a, 1, self.right), self._edge(b, 0, self.left)
        i = j = 0
        scores, lowest = self.scores, -np.inf
        while True:
            up_a = scores[ends[i + 1]] if i + 1 < len(ends) else lowest
            up_b = scores[begins[j + 1]] if j + 1 < len(begins) else lowest
            across = scores.get(ends[i] + begins[j])
            if across is not None and across > up_a and across >= up_b:
                return False
            if up_a == lowest and up_b == lowest:
                return True
            if up_a >= up_b:
                i += 1
            else:
                j += 1


class Transducer:
    """A deterministic transducer that reads characters and says by how much each changes the number of pieces.

    Of a text read so far, each split into finished pieces and the beginning of another is a state of an unambiguous
    automaton: (beginning, last finished piece), and how many pieces are finished. The deterministic state is the set of
    those that a text has, with numbers relative to the text's own; its transitions are built when they are first taken,
    and kept. Two characters that no piece has side by side are a border: nothing merges across it, so a text begins
    afresh there. Characters without a piece are as many pieces as bytes, with a border at both sides.
    """

    def __init__(self, pieces: dict[str, float]):
        self.merges = Merges(pieces)
        alphabet = sorted({c for p in pieces for c in p})
        if any(c not in pieces for c in alphabet):
            raise ValueError("a character of a piece is no piece")
        self.symbol = {c: i + 1 for i, c in enumerate(alphabet)}
        self.symbol[" "] = self.symbol[SPACE]
        self.class_of = np.zeros(0x110000, dtype=np.uint16)
        for c, i in self.symbol.items():
            self.class_of[ord(c)] = i
        self.joined = np.zeros((len(alphabet) + 1, len(alphabet) + 1), dtype=bool)
        self.child: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in pieces:
            if not self.merges.proper(p):
                continue
            node = 0
            for c in p:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.piece)
                    self.child.append({})
                    self.piece.append(None)
                node = self.child[node][c]
            self.piece[node] = p
            for x, y in zip(p, p[1:]):
                self.joined[self.symbol[x], self.symbol[y]] = True
        self.known: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Only the first state stays; the others are built again when they are met."""
        self.states: list[tuple] = [((0, None, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: FRESH}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        if len(self.known) > 10 * STATES:
            self.known = {}

    def state(self, live: tuple) -> int:
        if (n := self.number.get(live)) is None:
            n = self.number[live] = len(self.states)
            self.states.append(live)
            self.steps.append({})
        return n

    def _step(self, state: int, c: str) -> tuple[int, int]:
        """The state after a character, and by how much the number of pieces changes."""
        char, live, last, change, children = SPACE if c == " " else c, [], None, 0, self.child
        for node, before, n in self.states[state]:
            if char not in children[node]:
                continue
            child = children[node][char]
            if children[child]:
                live.append((child, before, n))
            if last is None and (piece := self.piece[child]) is not None:
                fits = before is None
                if not fits and (fits := self.known.get((before, piece))) is None:
                    fits = self.known[before, piece] = self.merges.neighbours(before, piece)
                if fits:
                    last, change = piece, n + 1
        after = (*((node, before, n - change) for node, before, n in live), (0, last, 0)) if live else ((0, last, 0),)
        self.steps[state][c] = step = (self.state(after), change)
        return step

    def run(self, state: int, text: str) -> tuple[int, int]:
        """State and pieces after a text without borders that is read from the given state."""
        if len(text) == 1 and text not in self.symbol:
            return FRESH, len(text.encode())
        n, steps = 0, self.steps
        for c in text:
            step = steps[state].get(c)
            state, change = step if step is not None else self._step(state, c)
            n += change
        return state, n


def scan(to: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All prefixes of chunk maps composed: to[i, k] is where entry k of chunk i leads, n[i, k] what that emits.

    ``first[i]`` is the first chunk of the run that i belongs to. In each round a chunk's map takes in the one before it
    that covers as many chunks, so rounds are logarithmic in the length of the longest run.
    """
    at, step = np.arange(len(first)), 1
    while True:
        with_one = np.flatnonzero(at - step >= first)
        if not len(with_one):
            return to, n
        before = with_one - step
        entry = to[before]
        to_next, n_next = to.copy(), n.copy()
        to_next[with_one] = np.take_along_axis(to[with_one], entry, axis=1)
        n_next[with_one] = n[before] + np.take_along_axis(n[with_one], entry, axis=1)
        to, n, step = to_next, n_next, 2 * step


class TokenCounts:
    """Numbers of tokens of texts by a sentencepiece model of merged pieces with bytes for what has no piece, and no normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        if any(model.is_unused(i) for i in size) or not any(model.is_byte(i) for i in size):
            raise ValueError("the model has unused pieces, or none for bytes")
        probe = "  ﬁＡé \t\n <s>  x "
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("the model normalises texts")
        self.machine = Transducer({model.id_to_piece(i): model.get_score(i) for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
        self.recent = _Recent(REMEMBERED)

    def _fresh(self, chunks: list[str]) -> list[int]:
        """Pieces of distinct chunks that begin at a border."""
        self.recent.age()
        young, run = self.recent.young, self.machine.run
        for c in self.recent.missing(chunks):
            young[c] = run(FRESH, c)[1]
        return list(map(young.__getitem__, chunks))

    def _long(self, chunks: list[str], first: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """Pieces that each chunk adds, for runs of chunks without a border between them, and the last state.

        A chunk's map is held for the entries that can occur: the exit of the chunk before it read afresh, and what the
        entries found so far lead to, until nothing is added. Equal chunks share their maps.
        """
        run, maps = self.machine.run, {}

        def go(state: int, chunk: str) -> tuple[int, int]:
            if (found := maps.get((state, chunk))) is None:
                found = maps[state, chunk] = run(state, chunk)
            return found

        entries: list[dict[int, int]] = []
        for i in range(len(chunks)):
            entries.append({(entry if i == 0 else FRESH) if first[i] == i else go(FRESH, chunks[i - 1])[0]: 0})
        todo = [(i, s) for i, e in enumerate(entries) for s in e]
        while todo:
            added = []
            for i, s in todo:
                if i + 1 < len(chunks) and first[i + 1] != i + 1:
                    after = go(s, chunks[i])[0]
                    if after not in entries[i + 1]:
                        entries[i + 1][after] = len(entries[i + 1])
                        added.append((i + 1, after))
            todo = added
        width = max(map(len, entries))
        to, n = np.zeros((len(chunks), width), dtype=np.int64), np.zeros((len(chunks), width), dtype=np.int64)
        for i, e in enumerate(entries):
            for s, k in e.items():
                after, n[i, k] = go(s, chunks[i])
                to[i, k] = entries[i + 1][after] if i + 1 < len(chunks) and first[i + 1] != i + 1 else 0
        total = scan(to, n, first)[1][:, 0]
        alone = total.copy()
        inside = np.flatnonzero(first != np.arange(len(chunks)))
        alone[inside] -= total[inside - 1]
        state = entry if first[-1] == 0 else FRESH
        for c in chunks[first[-1] :]:
            state = go(state, c)[0]
        return alone, state

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a batch; null and empty texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        some = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        out = np.zeros(len(texts), dtype=np.int64)
        if not len(some):
            return out
        led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.take(pa.array(some)), pa.scalar("", pa.large_string()))
        offsets = np.frombuffer(led.buffers()[1], dtype=np.int64)[led.offset : led.offset + len(led) + 1]
        data = np.frombuffer(led.buffers()[2], dtype=np.uint8)
        at, state, before, machine = int(offsets[0]), FRESH, 0, self.machine
        while at < offsets[-1]:
            stop = min(at + WINDOW, int(offsets[-1]))
            while stop < offsets[-1] and data[stop] & 0xC0 == 0x80:
                stop += 1
            raw = data[at:stop]
            codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
            places = np.flatnonzero((raw & 0xC0) != 0x80)
            symbols = machine.class_of[codes]
            border = np.empty(len(codes), dtype=bool)
            border[0] = not machine.joined[before, symbols[0]]
            border[1:] = ~machine.joined[symbols[:-1], symbols[1:]]
            begins = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)]
            border[np.searchsorted(places, begins - at)] = True
            goes_on = not border[0]
            border[0] = True
            starts = np.flatnonzero(border)
            length = np.diff(np.append(starts, len(codes)))
            parts = -(-length // CHUNK)
            first = np.repeat(np.cumsum(parts) - parts, parts)
            cuts = places[starts[np.repeat(np.arange(len(starts)), parts)] + CHUNK * (np.arange(len(first)) - first)]
            bounds = np.append(cuts, len(raw)).astype(np.int32)
            chunks = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw.tobytes()))
            special = np.repeat(parts > 1, parts)
            special[: parts[0]] |= goes_on
            special[-int(parts[-1]) :] = True  # its state is the next window's
            n = np.zeros(len(cuts), dtype=np.int64)
            coded = pc.dictionary_encode(chunks.filter(pa.array(~special)))
            n[~special] = np.array(self._fresh(coded.dictionary.to_pylist()), dtype=np.int64)[coded.indices.to_numpy()] if len(coded) else 0
            hard = np.flatnonzero(special)
            n[hard], after = self._long(chunks.take(pa.array(hard)).to_pylist(), np.searchsorted(hard, first[hard]), state if goes_on else FRESH)
            owner = np.searchsorted(offsets, cuts + at, side="right") - 1
            out[some] += np.bincount(owner, weights=n, minlength=len(some)).astype(np.int64)
            at, before = stop, int(symbols[-1])
            live = machine.states[after]
            if len(machine.states) > STATES:
                machine.forget()
            state = machine.state(live)
        return out


_counters: dict[str, TokenCounts] = {}


def _count(name: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        path = SparkFiles.get(name)
        if path not in _counters:
            _counters[path] = TokenCounts(path)
        for b in batches:
            n = _counters[path].of_texts(b.column(1))
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) per row of docs, for whole texts.

    ``tokenizer`` is a sentencepiece model of merged pieces with byte fallback that doesn't normalise; it is sent to the
    executors, each of which compiles it. A text is cut at borders that nothing merges across, and further every CHUNK
    characters; distinct chunks run through the transducer once, and the state maps of chunks without a border between
    them compose in a prefix scan. Long texts pass in windows of bytes, the state going from one to the next, so memory
    doesn't follow a text's length beyond the text itself.

    Null and empty texts have no bytes and no tokens. Each row is counted by itself, with no shuffle: ids that are null
    or repeat are kept as they are, other columns don't matter, an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    spark.sparkContext.addFile(tokenizer)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_count(tokenizer.rsplit("/", 1)[-1], limit), COUNTED.format(rows.schema["doc_id"].dataType.simpleString()))
