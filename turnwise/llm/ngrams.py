"""Hashed word n-gram features and logistic regression trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BITS = 18
#: Words a worker remembers the hashes of; beyond that it forgets all and starts anew, so its memory is bounded.
REMEMBERED = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shape(word: str) -> str:
    """The kind of a token: letters by case, digits, or the symbols themselves, shortened to three."""
    if word.isdigit():
        return "0"
    if not word[0].isalpha():
        return word[:3]
    return "x" if word.islower() else "X" if len(word) == 1 or not word.isupper() else "XX"


class _Words(dict):
    """word -> its hash in the upper and its shape's hash in the lower 32 bits."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = v = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape(word).encode("utf-8", "surrogatepass"), 7)
        return v


_words = _Words()


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed features of a whole text, repeats included: word 1- and 2-grams, and 1- to 3-grams of word shapes.

    A word that repeats the one before it has a shape of its own. A text without tokens has one feature that says so.
    """
    words = TOKEN.findall(text or "")
    if not words:
        return _slot(np.array([1], dtype=np.uint64), bits)
    both = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    w, s = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    s[1:][both[1:] == both[:-1]] ^= np.uint64(0x5BD1E995)
    parts = [w << np.uint64(1), (s << np.uint64(3)) | np.uint64(1 << 40)]
    if len(words) > 1:
        parts += [w[:-1] * np.uint64(31) + w[1:] + np.uint64(1 << 50), s[:-1] * np.uint64(37) + s[1:] + np.uint64(1 << 51)]
    if len(words) > 2:
        parts.append(s[:-2] * np.uint64(1369) + s[1:-1] * np.uint64(37) + s[2:] + np.uint64(1 << 52))
    return _slot(np.concatenate(parts), bits)


def sparse(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature slots and their values: the share of each in the text's features, damped by a square root."""
    f = features(text, bits)
    slots, n = np.unique(f, return_counts=True)
    return slots, np.sqrt(n / len(f)).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logit(self, slots: np.ndarray, values: np.ndarray) -> float:
        return float(self.weights[slots].astype(np.float64) @ values) + self.bias


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-min(max(z, -35.0), 35.0))))


class Ftrl:
    """Per-coordinate FTRL-proximal: weights follow from the sums z and n, so an update touches only an example's own slots."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weight(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def push(self, i: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        """One update with gradient g at the distinct coordinates i, whose weights are w."""
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g

    def learn(self, slots: np.ndarray, values: np.ndarray, y: float, importance: float = 1.0) -> None:
        i = np.append(slots, len(self.z) - 1)
        x = np.append(values, 1.0)
        w = self.weight(i)
        self.push(i, (sigmoid(float(w @ x)) - y) * importance * x, w)

    def model(self) -> Model:
        w = self.weight(np.arange(len(self.z)))
        return Model(w[:-1].astype(np.float32), float(w[-1]))
