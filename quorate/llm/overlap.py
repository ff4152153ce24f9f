"""Same or near-same texts across two splits, by the bigrams of words they must share.

Two texts of na and nb words, L of them in common order, have d = na + nb - 2 L
other words. Each of these parts the common words at one place at most, so the
texts share at least L + 1 - d bigrams (both ends of a text count as words).
Where L is the share ``SHARED`` of all words, that is more than an eighth of
na + nb: no pair is lost, wherever the differing words lie.

Texts become inverted lists of their rarest bigrams, as many as leave less than
what a pair must share. Lists live in memory only: the texts of each split are
packed into blocks of words, every block of one split meets every block of the
other in a task, and only the pairs that are alike leave it. Texts that meet in
a list often enough are held against each other by signatures of their words,
then by their words, then by the words in common order.

Equal normalised texts form a class that is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.lookalike import Rewriter, frequencies, rewriter_of
from quorate.llm.shared import Shared
from quorate.staging import discard, stage

#: Words of a block (of one text at least), and of the blocks that a task reads on the right.
BLOCK = 1 << 21
RIGHT = 1 << 24
#: Rare bigrams in common before two texts are held against each other.
MEET = 4
#: Pairs that are held against each other at once.
AT_ONCE = 1 << 14
#: Least share of words in common order; between the four fifths of true cases and the two thirds of others.
SHARED = 0.75

LINK = regex.compile(r"(?:https?://|www\.)\S+")
REPOST = regex.compile(r"\b(?:rt|via|mt|repost(?:ed)?(?:\s+from)?|fwd?|x-?post)\b\s*[:\-]?\s*[@/]?u?/?[\w.-]*\s*:|\b(?:rt|via)\s+@[\w.-]+:?|^\s*(?:rt|fwd?|repost)\s*[:\-]\s*|\((?:repost|x-?post)[^)]*\)|\[(?:repost|x-?post)[^\]]*\]")
WORDS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}\p{N}]+")
APOSTROPHE = regex.compile(r"(?<=\p{L})['’ʼ`](?=\p{L})")


def words(text: str, plain: Rewriter) -> list[str]:
    """The words that are compared, without case, punctuation, links and repost marks."""
    t = LINK.sub(" ", plain(text).casefold())
    t = REPOST.sub(" ", t)
    return WORDS.findall(APOSTROPHE.sub("", t))


def shared_in_order(a: list[str], b: list[str]) -> float:
    """Twice the longest common subsequence over both lengths, bit-parallel; 0 for two empty texts."""
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def classes(df: DataFrame, key: str, text: str, flags: list[str], counts: Mapping[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (key, class, flags) and classes (class, words, flags) of equal normalised texts.

    A text without words is its own normalised form. Null texts drop out. A class
    has the flags that any member has.
    """
    counts = frequencies(df, text) if counts is None else counts
    shared = Shared(df.sparkSession.sparkContext, dict(counts))

    @F.pandas_udf(T.StringType())
    def normal(batch: pd.Series) -> pd.Series:
        plain = rewriter_of(shared)
        return batch.map(lambda t: None if t is None else " ".join(words(t, plain)) or "\t" + t.strip())

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), normal(F.col(text)).alias("words"), *flags)
    rows = stage(rows.withColumn("class", F.unhex(F.sha2("words", 256))), "overlap-texts")
    return rows.groupBy("key", "class").agg(*[F.max(f).alias(f) for f in flags]), rows.groupBy("class").agg(F.first("words").alias("words"), *[F.max(f).alias(f) for f in flags])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``size`` of them, one after another."""
    end = np.cumsum(size)
    return np.repeat(begin - end + size, size) + np.arange(end[-1] if len(end) else 0)


def _starts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def _nth(ordered: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    at = np.arange(len(ordered))
    return at - np.maximum.accumulate(np.where(np.append(True, ordered[1:] != ordered[:-1])[: len(at)], at, 0))


def _least_common(total: np.ndarray) -> np.ndarray:
    """Words in common order that texts of ``total`` words together must have."""
    return np.ceil(SHARED * total / 2 - 1e-9).astype(np.int64)


def _least_bigrams(n: np.ndarray) -> np.ndarray:
    """Bigrams that a text of ``n`` words shares at least with any text like it (the shortest of which has n SHARED / (2 - SHARED) words)."""
    return np.maximum(1, np.ceil((1.5 * SHARED - 1) * n * 2 / (2 - SHARED) + 1 - 1e-9)).astype(np.int64)


class _Texts:
    """Texts of a block as numbers of words, -1 for words without a number; the shortest text comes first."""

    def __init__(self, block: dict, number: Mapping[str, int] | None = None):
        vocabulary = block["vocabulary"].split(" ")
        self.number = {w: i for i, w in enumerate(vocabulary)} if number is None else number
        n = np.frombuffer(block["sizes"], np.int32).astype(np.int64)
        order = np.argsort(n, kind="stable")
        tokens = np.frombuffer(block["tokens"], np.int32)[_ranges((np.cumsum(n) - n)[order], n[order])]
        self.n = n[order]
        self.words = tokens.astype(np.int64) if number is None else np.array([number.get(w, -1) for w in vocabulary])[tokens]
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.classes = [block["classes"][32 * i : 32 * i + 32] for i in order.tolist()]
        # Words that stand in a text for the second time are words of their own from here on.
        rows = np.repeat(np.arange(len(n)), self.n)
        known = self.words >= 0
        ordered = np.sort(rows[known] * len(self.number) + self.words[known])
        self.sets = ordered % len(self.number) + _nth(ordered) * len(self.number)
        self.sets_at = _starts(ordered // len(self.number), len(n))
        # Words that the other block lacks count by none of their bits, which only lets more pairs pass.
        bit = (self.sets * 0x9E3779B1 >> 7) % 512
        self.signs = np.zeros((len(n), 8), np.uint64)
        np.bitwise_or.at(self.signs, (ordered // len(self.number), bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        self.unknown = self.n - np.diff(self.sets_at)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and number of each bigram, -1 where a word has no number."""
        size = self.n + 1
        rows = np.repeat(np.arange(len(size)), size)
        v = len(self.number)
        ahead = np.insert(self.words, self.at[:-1], v)
        behind = np.insert(self.words, self.at[1:], v)
        return rows, np.where((ahead < 0) | (behind < 0), -1, ahead * (v + 1) + behind)

    def said(self, i: int) -> list[int]:
        return self.words[self.at[i] : self.at[i + 1]].tolist()


class _Lists:
    """Inverted lists of the rarest bigrams of a block's texts."""

    def __init__(self, block: dict):
        self.texts = _Texts(block)
        rows, keys = self.texts.bigrams()
        self.keys, number = np.unique(keys, return_inverse=True)
        ordered = np.sort(rows * len(self.keys) + number)
        rows, number, nth = ordered // len(self.keys), ordered % len(self.keys), _nth(ordered)
        again = nth > 0
        self.repeats = np.unique(number[again] + nth[again] * len(self.keys))
        number[again] = len(self.keys) + np.searchsorted(self.repeats, number[again] + nth[again] * len(self.keys))
        n_bigrams = len(self.keys) + len(self.repeats)
        self.rank = np.empty(n_bigrams, np.int64)
        self.rank[np.argsort(np.bincount(number, minlength=n_bigrams), kind="stable")] = np.arange(n_bigrams)
        size = self.texts.n + 1
        least = _least_bigrams(self.texts.n)
        #: Texts before this one, the shortest, may share less than MEET bigrams with their like.
        self.short = int(np.searchsorted(least, MEET))
        rows, rank = self.rarest(rows, number, size - least + np.minimum(MEET, least))
        ordered = np.sort(rank * len(size) + rows)
        self.rows = ordered % len(size)
        self.starts = _starts(ordered // len(size), n_bigrams)

    def rarest(self, rows: np.ndarray, number: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and rank of the ``most`` rarest bigrams of each text."""
        ordered = np.sort(rows * len(self.rank) + self.rank[number])
        rows, rank = ordered // len(self.rank), ordered % len(self.rank)
        kept = np.arange(len(rows)) - _starts(rows, len(most))[rows] < most[rows]
        return rows[kept], rank[kept]

    def found(self, texts: _Texts) -> tuple[np.ndarray, np.ndarray]:
        """Text and number of the bigrams that this block has too."""
        rows, keys = texts.bigrams()
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = (self.keys[at] == keys) & (keys >= 0)
        ordered = np.sort(rows[known] * len(self.keys) + at[known])
        rows, number, nth = ordered // len(self.keys), ordered % len(self.keys), _nth(ordered)
        known = nth == 0
        if len(self.repeats):
            again = number + nth * len(self.keys)
            at = np.minimum(np.searchsorted(self.repeats, again), len(self.repeats) - 1)
            known |= self.repeats[at] == again
            number = np.where(nth == 0, number, len(self.keys) + at)
        return rows[known], number[known]

    def alike(self, block: dict) -> Iterator[tuple[bytes, bytes]]:
        """Classes of this block and of ``block`` that are alike."""
        left, right = self.texts, _Texts(block, self.texts.number)
        rows, number = self.found(right)
        least = _least_bigrams(right.n)
        meet = np.minimum(MEET, least)
        # Bigrams that this block lacks are the rarest of all.
        lacking = right.n + 1 - np.bincount(rows, minlength=len(right.n))
        rows, rank = self.rarest(rows, number, right.n + 1 - least + meet - lacking)
        at = _starts(rows, len(right.n))
        begin, end = self.starts[rank].tolist(), self.starts[rank + 1].tolist()
        # Texts of these lengths only can have enough words in common.
        low = np.searchsorted(left.n, np.ceil(right.n * SHARED / (2 - SHARED) - 1e-9))
        high = np.searchsorted(left.n, np.floor(right.n * (2 - SHARED) / SHARED + 1e-9), "right")
        counts = np.zeros(len(left.n), np.min_scalar_type(int(np.diff(at).max(initial=0))))
        one = counts.dtype.type(1)
        pairs: list[tuple[np.ndarray, int]] = []
        waiting = 0
        for j in range(len(right.n)):
            if at[j] == at[j + 1] or low[j] >= high[j]:
                continue
            np.add.at(counts, np.concatenate([self.rows[begin[k] : end[k]] for k in range(at[j], at[j + 1])]), one)
            met = np.flatnonzero(counts[low[j] : high[j]] >= meet[j]) + low[j]
            if low[j] < self.short:
                met = np.union1d(met, np.flatnonzero(counts[low[j] : self.short]) + low[j])
            counts[:] = 0
            if len(met):
                pairs.append((met, j))
                waiting += len(met)
            if waiting >= AT_ONCE:
                yield from self._compare(left, right, pairs)
                pairs, waiting = [], 0
        yield from self._compare(left, right, pairs)

    @staticmethod
    def _compare(left: _Texts, right: _Texts, pairs: list[tuple[np.ndarray, int]]) -> Iterator[tuple[bytes, bytes]]:
        if not pairs:
            return
        a = np.concatenate([met for met, _ in pairs])
        b = np.repeat([j for _, j in pairs], [len(met) for met, _ in pairs])
        least = _least_common(left.n[a] + right.n[b])
        fits = np.minimum(left.n[a], right.n[b] - right.unknown[b]) >= least
        a, b, least = a[fits], b[fits], least[fits]
        apart = np.bitwise_count(left.signs[a] & ~right.signs[b]).sum(axis=1, dtype=np.int64)
        fits = left.n[a] - apart >= least
        a, b, least = a[fits], b[fits], least[fits]
        for i, j, enough in zip(a.tolist(), b.tolist(), least.tolist(), strict=True):
            x, y = (t.sets[t.sets_at[k] : t.sets_at[k + 1]] for t, k in ((left, i), (right, j)))
            if len(np.intersect1d(x, y, assume_unique=True)) >= enough and left.classes[i] != right.classes[j] and shared_in_order(left.said(i), right.said(j)) >= SHARED:
                yield left.classes[i], right.classes[j]


def _blocks(texts: DataFrame) -> DataFrame:
    """Blocks (side, n_words, classes, vocabulary, tokens, sizes) of the texts of both sides, which have any words."""

    def packed(side: str, classes_: list[pa.Array], said: list[pa.Array]) -> pa.RecordBatch:
        lists = pa.chunked_array(said).combine_chunks()
        flat = lists.flatten().dictionary_encode()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
        row = {"side": side, "n_words": len(flat), "classes": b"".join(c for part in classes_ for c in part.to_pylist()), "vocabulary": " ".join(flat.dictionary.to_pylist()), "tokens": flat.indices.to_numpy(zero_copy_only=False).astype(np.int32).tobytes(), "sizes": sizes.tobytes()}
        return pa.RecordBatch.from_pylist([row])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {side: ([], []) for side in ("train", "test")}
        n_words = dict.fromkeys(held, 0)
        for batch in batches:
            said = pc.split_pattern(batch.column("words"), " ")
            for side, (classes_, lists) in held.items():
                chosen = pc.fill_null(batch.column(side), False)
                ids, own = batch.column("class").filter(chosen), said.filter(chosen)
                ends = np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False))
                at = 0
                while at < len(own):
                    before = ends[at - 1] if at else 0
                    upto = max(at + 1, int(np.searchsorted(ends, before + BLOCK - n_words[side], "right")))
                    classes_.append(ids.slice(at, upto - at))
                    lists.append(own.slice(at, upto - at))
                    n_words[side] += int(ends[upto - 1] - before)
                    at = upto
                    if at < len(own) or n_words[side] >= BLOCK:
                        yield packed(side, classes_, lists)
                        classes_.clear(), lists.clear()
                        n_words[side] = 0
        for side, (classes_, lists) in held.items():
            if lists:
                yield packed(side, classes_, lists)

    return texts.where(~F.col("words").startswith("\t")).select("class", "words", "train", "test").mapInArrow(pack, "side string, n_words long, classes binary, vocabulary string, tokens binary, sizes binary")


def near_classes(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes, a != b, a with the flag train and b with the flag test, whose words are alike."""
    blocks = stage(_blocks(texts), "overlap-blocks")
    columns = ("classes", "vocabulary", "tokens", "sizes")
    of = lambda side: blocks.where(F.col("side") == side).select(F.struct(*columns).alias(side))
    n_words = blocks.where("side = 'test'").agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    # A task makes the lists of a block once and reads many blocks of the other side against them.
    both = of("train").hint("shuffle_replicate_nl").join(of("test").coalesce(1 + n_words // RIGHT))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lists = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("train")[i], batch.column("test")[i]
                if (ids := left["classes"].as_py()) != held:
                    held, lists = ids, _Lists(left.as_py())
                pairs = list(lists.alike(right.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    near = stage(both.mapInArrow(meet, "a binary, b binary"), "overlap-near")
    discard(blocks)
    return near


def _linked(df: DataFrame, key: str, text: str, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posts in both splits (key), members (key, class, train, test), and links (a, b) of classes, a of train and b of test."""
    no = F.lit(None).cast("boolean")
    ids = [s.select(F.col(s.columns[0]).alias("key"), *[(F.lit(True) if own else no).alias(f) for f, own in (("train", k == 0), ("test", k == 1))]) for k, s in enumerate((train, test))]
    flags = ids[0].unionByName(ids[1]).where("key IS NOT NULL").groupBy("key").agg(F.max("train").alias("train"), F.max("test").alias("test"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked = stage(rows.join(flags, "key"), "overlap-posts")
    members, texts = classes(marked, "key", "text", ["train", "test"])
    members = stage(members, "overlap-members")
    twice = stage(marked.where("train AND test").select("key").distinct(), "overlap-twice")
    near = near_classes(texts)
    for done in (marked, texts):
        discard(done)
    same = members.groupBy("class").agg(F.max("train").alias("train"), F.max("test").alias("test")).where("train AND test").select(F.col("class").alias("a"), F.col("class").alias("b"))
    return twice, members, stage(near.unionByName(same), "overlap-links")


def cross_split(df: DataFrame, key: str, text: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct pairs (message_id_a, message_id_b), smaller first, one in each split, of the same or near-same text.

    ``train`` and ``test`` have one column, ``key``; null, repeated and unknown
    keys in them count for nothing. A key in both splits is a pair with itself,
    even with a null text; otherwise null texts match nothing. Rows without key
    drop out. Empty tables give no pairs. Copies are expanded into all pairs
    here; :func:`overlaps` is the form without that.
    """
    twice, members, links = _linked(df, key, text, train, test)
    twice = twice.select(F.col("key").alias("message_id_a"), F.col("key").alias("message_id_b"))
    of = lambda side, flag: members.where(flag).select(F.col("class").alias(side), F.col("key").alias(f"k{side}"))
    pairs = links.join(of("a", "train"), "a").join(of("b", "test"), "b").where("ka != kb")
    return pairs.select(F.least("ka", "kb").alias("message_id_a"), F.greatest("ka", "kb").alias("message_id_b")).unionByName(twice).distinct()


def overlaps(df: DataFrame, key: str, text: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """key, split, class and n_links of every post with a counterpart in the other split: one row for each split it is in.

    ``n_links`` counts the posts of the other split with the same or near-same
    text (a post in both splits is its own counterpart). Classes are counted, so
    copies cost nothing. Keys and texts are treated as by :func:`cross_split`.
    """
    twice, members, links = _linked(df, key, text, train, test)
    sizes = members.groupBy("class").agg(F.count_if("train").alias("n_train"), F.count_if("test").alias("n_test"))
    parts = []
    for split, own, other in (("train", "a", "b"), ("test", "b", "a")):
        rest = "test" if split == "train" else "train"
        n = links.join(sizes.select(F.col("class").alias(other), F.col(f"n_{rest}").alias("n")), other).groupBy(F.col(own).alias("class")).agg(F.sum("n").alias("n_links"))
        parts.append(members.where(split).join(n, "class").select("key", F.lit(split).alias("split"), F.lower(F.hex("class")).alias("class"), "n_links"))
        # Posts in both splits without a text have no class.
        bare = twice.join(members, "key", "left_anti")
        parts.append(bare.select("key", F.lit(split).alias("split"), F.lit(None).cast("string").alias("class"), F.lit(1).cast("long").alias("n_links")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.where("n_links > 0")
