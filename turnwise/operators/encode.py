"""Texts to vectors: hashed character n-grams, signed, of unit length. Equal texts have equal vectors on every worker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM, GRAMS = 512, (3, 4, 5)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def vectors(texts: list[str | None], dim: int = DIM, grams: tuple[int, ...] = GRAMS) -> np.ndarray:
    """One row per text. Case and runs of white space don't count; a text without n-grams, and null, is the zero vector."""
    plain = [" " + " ".join((t or "").lower().split()) + " " for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(p) for p in plain])
    row = np.repeat(np.arange(len(plain)), length)
    out = np.zeros(len(plain) * dim)
    with np.errstate(over="ignore"):
        for n in grams:
            if len(codes) < n:
                continue
            h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
            for j in range(n):
                h = (h + codes[j : len(h) + j] + np.uint64(n)) * _STEP
            h = (h ^ (h >> np.uint64(29))) * _MIX
            inside = (row[: len(h)] == row[n - 1 :]) & (length[row[: len(h)]] > 2)
            slot, sign = (h >> np.uint64(40)) % np.uint64(dim), np.where(h >> np.uint64(63), 1.0, -1.0)
            out += np.bincount((row[: len(h)] * dim + slot.astype(np.int64))[inside], weights=sign[inside], minlength=len(out))
    out = out.reshape(-1, dim)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1.0, norm)


def embed(text: Column, dim: int = DIM) -> Column:
    """The vector of a text, batch by batch."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(vectors(s.tolist(), dim)), index=s.index, dtype=object)

    return run(text)
