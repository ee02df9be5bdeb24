"""Toxicity classifier whose score must not move when a sentence names another group."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .ngrams import REMEMBERED, Ftrl, sigmoid
from .scoring import judged, labelled_sample

#: Terms that name groups of people, by language. Each list is swapped within itself.
IDENTITY_TERMS = {
    "en": ("women", "men", "girls", "boys", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino", "immigrants", "refugees", "foreigners", "disabled", "deaf", "blind", "elderly", "young"),
    "fr": ("femmes", "hommes", "filles", "garçons", "chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "gays", "lesbiennes", "noirs", "blancs", "asiatiques", "immigrés", "réfugiés", "étrangers", "handicapés", "sourds", "aveugles", "jeunes"),
    "de": ("frauen", "männer", "mädchen", "jungen", "christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "schwule", "lesben", "schwarze", "weiße", "asiaten", "einwanderer", "flüchtlinge", "ausländer", "behinderte", "gehörlose", "blinde", "senioren"),
    "es": ("mujeres", "hombres", "niñas", "niños", "cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "homosexuales", "lesbianas", "negros", "blancos", "asiáticos", "inmigrantes", "refugiados", "extranjeros", "discapacitados", "sordos", "ciegos", "jóvenes"),
}
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
BITS = 18
#: Labelled rows of the fit, passes over them, weight of the penalty of a pair of sentences that differ in the group they name.
FIT_ROWS, EPOCHS, PENALTY = 8000, 8, 1.0
MIN_DOCS, MIN_ERRORS = 4, 3.0
FOLD, FOLDS, THRESHOLD = 0, 5, 0.5
PREFIXES = range(4, 9)


def word_slots(word: str, bits: int = BITS) -> list[int]:
    """Slots of a word and of its beginnings, so that inflected and compounded forms share weight."""
    size = 1 << bits
    return [zlib.crc32(word.encode(), 1) % size, *(zlib.crc32(word[:n].encode(), 2) % size for n in PREFIXES if len(word) >= n)]


class _Slots(dict):
    """word -> its slots, for one number of bits, in bounded memory."""

    def __init__(self, bits: int):
        self.bits = bits

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = word_slots(word, self.bits)
        return found


def sparse(words: set[str], slots: _Slots) -> np.ndarray:
    """Distinct slots over the distinct words of a text, each of the value one: what counts is that a word is there."""
    return np.array(sorted(set().union(*map(slots.__getitem__, words))), dtype=np.int64)


_GROUP = {w: ts for ts in IDENTITY_TERMS.values() for w in ts}
_TERMS = tuple(_GROUP)


def associated(rows: list[tuple[np.ndarray, int]], bits: int = BITS) -> np.ndarray:
    """Slots that at least MIN_DOCS texts have and whose texts' share of label 1 is MIN_ERRORS standard errors off the sample's. The others are noise in a long text.

    Slots of identity terms always count: the log loss may give them weight, and it is the penalty that takes it away.
    """
    with_slot, with_both = np.zeros(1 << bits), np.zeros(1 << bits)
    for i, y in rows:
        with_slot[i] += 1
        with_both[i] += y
    share = sum(y for _, y in rows) / max(1, len(rows))
    off = np.abs(with_both - share * with_slot) / np.sqrt(with_slot * share * (1 - share) + 1e-9)
    ok = (with_slot >= MIN_DOCS) & (off >= MIN_ERRORS)
    ok[[s for w in _TERMS for s in word_slots(w, bits)]] = True
    return ok


def swaps(text: str | None, seed: int) -> list[tuple[frozenset, frozenset, float, bool]]:
    """For each sentence of a labelled text a pair: the words in which it and its counterfactual differ, the pair's weight, and whether its term is put in.

    A sentence that names a group is paired with itself under another name of the same list. One that names none is
    paired with itself with a term put in, against another term or none, so that a corpus without such terms teaches the
    same invariance; the pairs of all such sentences of a text weigh as much as one of the first kind. Only the words in
    which the two sentences differ matter to the difference of their scores.
    """
    named, bare = [], []
    plain = _GROUP.keys().isdisjoint(WORD.findall((text or "").lower()))
    for k, s in enumerate(SENTENCE.findall(text or "")):
        pick = zlib.crc32(f"{seed}/{k}".encode())
        words = set() if plain else set(WORD.findall(s.lower()))
        mine = sorted(w for w in words if w in _GROUP)
        for w in mine:
            others = [t for t in _GROUP[w] if t not in words]
            named.append((frozenset({w}), frozenset({others[pick % len(others)]} if others else ()), 1.0, False))
        if not mine:
            terms = IDENTITY_TERMS[sorted(IDENTITY_TERMS)[pick // 7 % len(IDENTITY_TERMS)]]
            a, b = terms[pick // 11 % len(terms)], terms[pick // 17 % len(terms)]
            bare.append((frozenset({a}), frozenset({b} if a != b and pick % 2 else ())))
    return named + [(a, b, 1.0 / len(bare), True) for a, b in bare]


class _Pairs:
    """Pairs as arrays: for each slot in which a pair differs, which pair, with what sign."""

    def __init__(self, pairs: list[tuple[frozenset, frozenset, float, bool]], bits: int):
        slot, pair, sign, self.weight = [], [], [], np.array([p[2] for p in pairs])
        for k, (a, b, *_) in enumerate(pairs):
            of = lambda words: {s for w in words for s in word_slots(w, bits)}
            left, right = of(a), of(b)
            for side, one in ((left - right, 1.0), (right - left, -1.0)):
                slot += side
                pair += [k] * len(side)
                sign += [one] * len(side)
        self.slots, self.at = np.unique(np.array(slot, dtype=np.int64), return_inverse=True)
        self.pair, self.sign = np.array(pair, dtype=np.int64), np.array(sign)

    def push(self, learner: Ftrl, penalty: float) -> None:
        """One step down the gradient of penalty * weight * (difference of log-odds)^2, summed over the pairs."""
        w = learner.weight(self.slots)
        if w.any():
            off = np.bincount(self.pair, weights=w[self.at] * self.sign, minlength=len(self.weight))
            learner.push(self.slots, np.bincount(self.at, weights=2 * penalty * (off * self.weight)[self.pair] * self.sign), w)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self):
        """Scores one text; which words have weight, and their slots, are remembered, in bounded memory."""
        w, bits = self.weights, len(self.weights).bit_length() - 1
        weighs = (w != 0).tolist()
        hot: dict[str, list[int]] = {}
        cold: set[str] = set()

        def score(text: str | None) -> float:
            words = set(WORD.findall((text or "").lower())) - cold
            new = [x for x in words if x not in hot]
            if new and len(hot) + len(cold) >= REMEMBERED:
                hot.clear()
                cold.clear()
                new = words
            for x in new:
                slots = [i for i in word_slots(x, bits) if weighs[i]]
                if slots:
                    hot[x] = slots
                else:
                    cold.add(x)
            words = words - cold
            if not words:
                return sigmoid(self.bias)
            slots = sorted(set().union(*map(hot.__getitem__, words)))
            return sigmoid(float(w[slots].astype(np.float64).sum()) + self.bias)

        return score


def train(sample: list[tuple[str | None, int]], bits: int = BITS, epochs: int = EPOCHS, penalty: float = PENALTY) -> Model:
    """FTRL on the log loss plus ``penalty`` times the squared difference of the log-odds of each sentence and its counterfactual.

    The gradient of a pair falls on the slots in which its two sentences differ, which are those of the identity terms
    alone, so group names lose their weight and other words keep theirs. Every sentence of the sample is in a pair; a
    text's own swaps follow its step, and the pairs with terms put in, which don't depend on their sentence, are summed
    over all texts and follow each pass.
    """
    learner = Ftrl(1 << bits, alpha=0.3, l1=1.0, l2=0.02)
    n, bad = len(sample), sum(y for _, y in sample)
    if not 0 < bad < n:
        return Model(np.zeros(1 << bits, dtype=np.float32), 4.0 if bad else -4.0 if n else 0.0)
    memo = _Slots(bits)
    texts = [sparse(set(WORD.findall((t or "").lower())), memo) for t, _ in sample]
    ok = associated([(i, y) for i, (_, y) in zip(texts, sample)], bits)
    rows, put_in = [], Counter()
    for k, (i, (t, y)) in enumerate(zip(texts, sample)):
        pairs = swaps(t, k) if penalty else []
        own = [p for p in pairs if not p[3]]
        rows.append((i[ok[i]], y, _Pairs(own, bits) if own else None))
        for a, b, w, bare in pairs:
            put_in[a, b] += w * bare
    put_in = _Pairs([(a, b, w, True) for (a, b), w in put_in.items() if w], bits)
    balance = {1: min(4.0, (n / (2 * bad)) ** 0.5), 0: min(4.0, (n / (2 * (n - bad))) ** 0.5)}
    for _ in range(epochs):
        for slots, y, pairs in rows:
            learner.learn(slots, np.ones(len(slots)), y, balance[y])
            if pairs:
                pairs.push(learner, penalty)
        put_in.push(learner, penalty)
    m = learner.model()
    return Model(m.weights, m.bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, score (1: labelled toxic is likelier), predicted per document.

    Learns from labels of at most ``fit_rows`` documents whose crc32(id) mod 5 is not 0; only texts are inputs. Whole
    texts are scored, each distinct word once. Null, empty and wordless texts get the model's base score. A null id is
    never held out. Without labels every score is 0.5; an empty table gives no rows; repeated rows score alike. Other
    columns don't matter.
    """
    fitted = train(labelled_sample(docs, labels, "toxic", FOLD, FOLDS, fit_rows, key, text), penalty=penalty)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    return judged(docs, lambda: model.value.scorer(), FOLD, FOLDS, threshold, key, text)
