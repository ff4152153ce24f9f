"""Languages of texts by profiles of letter trigrams, learnt from labelled texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions.keys import folded, usable

#: Counters of hashed trigrams in each language.
COUNTERS = 1 << 16
#: Least texts of a language's profile; a label that fewer have is taken for a slip.
LEAST = 20
#: Natural units by which a text must be likelier in another language, for each trigram and in all.
EACH, IN_ALL = 0.5, 20.0

OTHER = regex.compile(r"[^\p{L}\p{M}]+")
#: Labels that name no language.
NO_LANGUAGE = ("und", "unknown", "xx", "null", "none")


def trigrams(text: str) -> np.ndarray:
    """The counters of a text's letter trigrams, words being parted by one space."""
    t = f" {OTHER.sub(' ', text.lower()).strip()} "
    c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    x = c[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[2:] * np.uint64(0x165667B19E3779F9)
    return ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)


class Profiles:
    """Log probabilities of the trigrams in each language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.logs = np.stack([np.log((counts[name] + 0.1) / (counts[name].sum() + 0.1 * COUNTERS)) for name in self.languages], 1).astype(np.float32) if counts else np.zeros((COUNTERS, 0), np.float32)

    def differ(self, a: str, b: str) -> bool:
        """Whether ``b`` is clearly in another language than ``a``."""
        x, y = trigrams(a), trigrams(b)
        if not len(x) or not len(y) or not self.languages:
            return False
        own = int(self.logs[x].sum(0).argmax())
        score = self.logs[y].sum(0)
        gain = float(score.max() - score[own])
        return gain >= IN_ALL and gain >= EACH * len(y)


def learn(df: DataFrame, text: str, label: str) -> dict[str, np.ndarray]:
    """Trigram counts of each language, over all labelled texts.

    Partial sums leave Python per task; at most COUNTERS rows for each language
    are collected. Null texts and labels, and labels of fewer than LEAST texts, count for nothing.
    """
    rows = df.where(usable(label) & F.col(text).isNotNull()).select(folded(label).alias("l"), F.col(text).alias("t")).where(~F.col("l").isin(*NO_LANGUAGE))
    known = [r["l"] for r in rows.groupBy("l").count().where(F.col("count") >= LEAST).collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            found: dict[str, list[np.ndarray]] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(name, []).append(trigrams(t))
            for name, grams in found.items():
                held[name] = held.get(name, 0) + np.bincount(np.concatenate(grams), minlength=COUNTERS)
        for name, n in held.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(there), pa.string()), pa.array(there), pa.array(n[there])], names=["l", "g", "n"])

    parts = rows.where(F.col("l").isin(known)).mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()
    counts = {name: np.zeros(COUNTERS) for name in known}
    for name, part in parts.groupby("l"):
        counts[name][part["g"].to_numpy()] = part["n"].to_numpy()
    return counts
