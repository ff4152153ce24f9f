"""Text garbled by a wrong decoding: found and, where possible, restored.

A corpus model holds the mutual information of adjacent characters. Each
character of a text gets an improbability from its pair's information and its
own rarity; maximum-scoring segments of it are the runs worth a look. Only
inside those runs are inverse mappings tried: back to bytes by the wrong
encoding, forth by the right one. A mapping is accepted if it makes the text
clearly more probable under the model. The step is repeated for text that was
garbled more than once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.shared import Shared

#: Counters of adjacent pairs. A counter holds the sum of the pairs that are hashed to it, so every pair
#: counts and the broadcast model has at most 12 bytes for each counter, however large the corpus.
COUNTERS = 1 << 24
#: Weight of the characters' own frequencies beside the pairs'.
BACKOFF = 20.0
#: Bits of improbability from which on a character counts for a run.
USUAL_BITS = 6.0
#: Natural units by which a restored text must be more probable, in all and per changed run of characters.
GAIN, GAIN_EACH = 3.0, 0.5
#: A byte sequence that happens to be valid UTF-8 is evidence of its own.
VALID_UTF8 = 2.5

#: Wrong decodings of UTF-8.
OVER_UTF8 = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-2", "iso8859-15", "koi8-r", "cp866", "cp1253", "iso8859-7", "cp1254", "cp852")
#: Groups of one-byte encodings that are taken for each other.
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
CENTRAL = ("cp1250", "iso8859-2", "cp852")
WESTERN = ("cp1252", "latin-1", "cp850", "cp437", "mac_roman", "iso8859-15")
GREEK = ("cp1253", "iso8859-7")
EASTERN = ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")

REPLACEMENT = "�"
BYTE_ENTITY = regex.compile(r"(?:&#(?:1[2-9]\d|2[0-4]\d|25[0-5]|x[89a-fA-F][0-9a-fA-F]);){2,}")
ENTITY = regex.compile(r"&#(x?)([0-9a-fA-F]+);")


def other_pairs() -> list[tuple[str, str]]:
    """(wrong, right) among the one-byte and the eastern encodings."""
    pairs = [(w, r) for group in (CYRILLIC, (*CENTRAL, *WESTERN[:2]), WESTERN, GREEK) for w in group for r in group if w != r]
    pairs += [(w, r) for w in ("cp1252", "latin-1") for r in (*CYRILLIC[:3], *GREEK, *EASTERN)]
    pairs += [(w, r) for w in ("cp437", "cp850", "mac_roman", "cp1251") for r in EASTERN[:2]]
    pairs += [(w, r) for w in EASTERN[:3] for r in EASTERN if w != r]
    return list(dict.fromkeys(pairs))


@lru_cache(maxsize=None)
def byte_table(encoding: str) -> dict[str, int]:
    """Character -> byte of the upper half; undefined bytes pass as control characters, as lenient decoders have it."""
    table: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    for b in range(0x80, 0xA0):
        table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=None)
def _upper_runs(encoding: str) -> regex.Pattern:
    return regex.compile("[" + "".join(regex.escape(c) for c in byte_table(encoding)) + "]+")


UTF8 = regex.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def from_utf8(run: str, wrong: str) -> tuple[str, int]:
    """The run with every valid UTF-8 sequence decoded, and their number."""
    table, n = byte_table(wrong), 0

    def piece(m: regex.Match) -> str:
        nonlocal n
        chars = m.group()
        data = bytes(table[c] for c in chars)
        out, at = [], 0
        for s in UTF8.finditer(data):
            try:
                whole = s.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [chars[at : s.start()], whole]
            at = s.end()
            n += 1
        return "".join([*out, chars[at:]]) if out else chars

    found = _upper_runs(wrong).sub(piece, run)
    # A no-break space at the end of a sequence is often made an ordinary one.
    if wrong in ("cp1252", "latin-1", "cp1254", "iso8859-15") and "Ã " in found:
        found, more = regex.subn(r"Ã (?=$|[\p{L}\p{N}])", "à ", found)
        n += more
    return found, n


def from_other(run: str, wrong: str, right: str) -> str | None:
    """The run taken back to bytes by ``wrong`` and read by ``right``; None if that is impossible."""
    table = byte_table(wrong) if wrong not in EASTERN else None
    try:
        data = run.encode(wrong) if table is None else bytes(ord(c) if c < "\x80" else table[c] for c in run)
        return data.decode(right)
    except (KeyError, UnicodeError):
        return None


def counter(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The counters of pairs of code points."""
    x = first.astype(np.uint64) << np.uint64(21) | second.astype(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """Probabilities of characters and of adjacent pairs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, singles: dict[int, int]):
        self.keys, self.counts = keys, np.append(counts, 0)  # the last one serves pairs without a counter
        self.total = max(1, sum(singles.values()))
        kinds = len(singles) + 1
        dense = np.zeros(0x110000, np.float64)
        dense[list(singles)] = list(singles.values())
        self.single = dense
        self.own = (dense + 0.5) / (self.total + 0.5 * kinds)
        self.windows: dict[tuple[str, str, str], list[tuple[int, str, float]]] = {}
        self.mapped: dict[str, list[tuple[int, str, float]]] = {}
        self._seen: dict[tuple[int, int], float] = {}

    def joint(self, codes: np.ndarray) -> np.ndarray:
        """P(character | the one before) of each character; the first one follows a text's beginning."""
        before = np.concatenate([np.zeros(1, np.uint32), codes[:-1]])
        slots = counter(before, codes)
        at = np.searchsorted(self.keys, slots)
        at[at == len(self.keys)] = 0
        both = self.counts[np.where(self.keys[at] == slots, at, len(self.keys))] if len(self.keys) else np.zeros(len(codes))
        return (both + BACKOFF * self.own[codes]) / (self.single[before] + BACKOFF)

    def improbability(self, text: str) -> np.ndarray:
        """Bits of improbability of each character beside the one before.

        That is -(information + 2 log P(b)) / 2 with information = log P(b | a) - log P(b).
        """
        codes = _codes(text)
        return -(np.log2(self.joint(codes)) + np.log2(self.own[codes])) / 2

    def likelihood(self, text: str) -> float:
        total, a = 0.0, 0
        for c in text:
            b = ord(c)
            known = self._seen.get((a, b))
            if known is None:
                if len(self._seen) > 1_000_000:  # a memory of settled pairs; it is filled again
                    self._seen.clear()
                known = self._seen[a, b] = math.log(self.joint(np.array([a, b], np.uint32))[1])
            total += known
            a = b
        return total


def segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments (begin, end), in linear time.

    Each candidate remembers the last candidate before it that begins at a lower
    running total, so no candidate is passed over twice.
    """
    if not len(scores):
        return []
    # Neighbours of one sign are taken together.
    starts = np.flatnonzero(np.diff(scores > 0, prepend=not scores[0] > 0))
    ends = np.append(starts[1:], len(scores))
    totals = np.cumsum(scores)
    found: list[tuple[int, int, float, float, int]] = []  # begin, end, total before, total after, link
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if scores[s] <= 0:
            continue
        begin, left, right = s, float(totals[s - 1]) if s else 0.0, float(totals[e - 1])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            begin, left, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
        found.append((begin, e, left, right, j))
    return [(s, e) for s, e, *_ in found]


def runs(text: str, model: Model) -> list[tuple[int, int]]:
    """Maximum-scoring segments of improbability; those of plain ASCII are left out."""
    return [(s, e) for s, e in segments(model.improbability(text) - USUAL_BITS) if not text[s:e].isascii()]


def _windows(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs grown to whole stretches of characters beyond ASCII, and joined where they touch."""
    grown: list[list[int]] = []
    for s, e in found:
        while s > 0 and text[s - 1] >= "\x80":
            s -= 1
        while e < len(text) and text[e] >= "\x80":
            e += 1
        if e < len(text) and text[e] == " ":
            e = min(len(text), e + 2)
        if grown and s <= grown[-1][1]:
            grown[-1][1] = max(e, grown[-1][1])
        else:
            grown.append([s, e])
    return [(s, e) for s, e in grown]


@lru_cache(maxsize=1)
def _mappings() -> tuple[tuple[str, str], ...]:
    return (*((w, "utf-8") for w in OVER_UTF8), *other_pairs())


def _mapped(run: str) -> list[tuple[int, str, float]]:
    """What each mapping makes of a run, where that differs: (mapping, new text, evidence of its own)."""
    found = []
    signs = {c for c in run if c >= "\x80"}
    for i, (wrong, right) in enumerate(_mappings()):
        if right == "utf-8":
            if signs.isdisjoint(byte_table(wrong)):
                continue
            new, n = from_utf8(run, wrong)
            bonus = VALID_UTF8 * n
        elif wrong in EASTERN or signs <= byte_table(wrong).keys():
            new, bonus = from_other(run, wrong, right), 0.0
        else:
            continue
        if new is not None and new != run and (REPLACEMENT not in new or right == "utf-8"):
            found.append((i, new, bonus))
    return found


def _options(window: tuple[str, str, str], model: Model) -> list[tuple[int, str, float]]:
    """What each mapping makes of a window, and how much likelier that is: (mapping, new text, gain)."""
    known = model.windows.get(window)
    if known is not None:
        return known
    before, run, after = window
    mapped = model.mapped.get(run)
    if mapped is None:
        mapped = _mapped(run)
        if len(run) <= 16:
            if len(model.mapped) > 100_000:
                model.mapped.clear()
            model.mapped[run] = mapped
    made: dict[str, float] = {}
    found = []
    was = model.likelihood(before + run + after) if mapped else 0.0
    for i, new, bonus in mapped:
        if new not in made:
            made[new] = model.likelihood(before + new + after) - was
        found.append((i, new, made[new] + bonus))
    if len(run) <= 16:
        if len(model.windows) > 100_000:
            model.windows.clear()
        model.windows[window] = found
    return found


def _once(text: str, model: Model) -> str | None:
    """The text after the best inverse mapping, or None if none helps."""
    windows = _windows(text, runs(text, model))
    gains: dict[int, float] = {}
    changes: dict[int, dict[int, str]] = {}
    for k, (s, e) in enumerate(windows):
        for i, new, gain in _options((text[max(0, s - 1) : s], text[s:e], text[e : e + 1]), model):
            gains[i] = gains.get(i, 0.0) + gain
            changes.setdefault(i, {})[k] = new
    best, chosen = 0.0, -1
    for i, gain in gains.items():
        if _mappings()[i][1] != "utf-8":
            gain -= GAIN
        if gain >= max(GAIN, GAIN_EACH * len(changes[i])) and gain > best:
            best, chosen = gain, i
    if chosen < 0:
        return None
    out, at = [], 0
    for k, (s, e) in enumerate(windows):
        out += [text[at:s], changes[chosen].get(k, text[s:e])]
        at = e
    return "".join([*out, text[at:]])


def restore(text: str, model: Model) -> tuple[bool, str | None]:
    """Whether the text is garbled, and the restored text (None where it cannot be restored whole)."""
    garbled, now = False, text
    if (e := BYTE_ENTITY.search(now)) is not None:
        plain = ENTITY.sub(lambda m: chr(int(m.group(2), 16 if m.group(1) else 10)) if 0x80 <= int(m.group(2), 16 if m.group(1) else 10) <= 0xFF else m.group(), now)
        if from_utf8(plain, "latin-1")[1] and e:
            garbled, now = True, plain
    seen = {now}
    while (after := _once(now, model)) is not None and after not in seen:  # until nothing is gained
        garbled, now = True, after
        seen.add(now)
    if REPLACEMENT in now:
        return True, None
    return garbled, now if garbled else None


def learn(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Counters of adjacent pairs (sorted, with their sums) and counts of characters over all texts.

    Partial sums leave Python per task; at most COUNTERS rows and one per code
    point are collected.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, singles = np.zeros(COUNTERS, np.int32), np.zeros(0x110000, np.int64)
        for batch in batches:
            joined = "\0".join(t for t in batch.column(0).to_pylist() if t)
            if joined:
                codes = _codes("\0" + joined)
                slots, n = np.unique(counter(codes[:-1], codes[1:]), return_counts=True)
                pairs[slots] += n.astype(np.int32)
                singles += np.bincount(codes[1:], minlength=len(singles))
        for kind, held in ((0, pairs), (1, singles)):
            there = np.flatnonzero(held)
            for i in range(0, len(there), 100_000):
                part = there[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind)), pa.array(part), pa.array(held[part].astype(np.int64))], names=["kind", "key", "n"])

    parts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).mapInArrow(count, "kind long, key long, n long")
    # A pair that was seen once was seen in the text that it is to judge.
    counted = parts.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("kind = 1 OR n > 1").toPandas()
    pairs, singles = counted[counted["kind"] == 0].sort_values("key"), counted[counted["kind"] == 1]
    return pairs["key"].to_numpy(np.int64), pairs["n"].to_numpy(np.float32), {int(c): int(n) for c, n in zip(singles["key"], singles["n"], strict=True)}


def find(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``garbled`` (boolean, false for null texts) and ``restored`` (null unless restored whole).

    The model is learnt from all rows of ``df``. Rows and other columns are
    kept; ASCII texts without byte entities stay in the JVM.
    """
    shared = Shared(df.sparkSession.sparkContext, learn(df, text))

    @F.pandas_udf("garbled boolean, restored string")
    def look(batch: pd.Series) -> pd.DataFrame:
        model = shared.model("garbled", lambda v: Model(*v))
        rows = [(False, None) if t is None else restore(t, model) for t in batch]
        return pd.DataFrame(rows, columns=["garbled", "restored"])

    suspect = F.col(text).rlike(r"[^\x00-\x7F]|&#[0-9x]")
    seen = df.withColumn("__s", look(F.when(suspect, F.col(text))))
    return seen.withColumn("garbled", F.coalesce("__s.garbled", F.lit(False))).withColumn("restored", F.col("__s.restored")).drop("__s")
