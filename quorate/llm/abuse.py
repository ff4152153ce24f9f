"""Scores for abusive, hateful and sexual content.

A word is the mean of hashed vectors of itself and its character n-grams, so
misspellings and disguises share most of a known word's parts; a pair of
neighbouring words has a hashed vector too. A sentence is the mean of its words
and pairs, classified by a linear softmax; embeddings and softmax are trained
jointly in numpy. A text scores as its worst sentence. As labels are of whole
texts and partly wrong, training alternates with choosing the sentences that
carry a label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.lookalike import Rewriter, frequencies, rewriter_of
from quorate.llm.shared import Shared

CLASSES = ("none", "abusive", "hateful", "sexual")
#: Bounds of the labelled sample that the classifier is fitted on, by label; chosen by random key.
MOST_POSITIVE, MOST_NEGATIVE = 3000, 3000
#: A text counts as abusive from this probability of its worst sentence on.
THRESHOLD = 0.5

BUCKETS = 1 << 16
DIM = 6
NGRAMS = (3, 4, 5)
STEPS = 30
ROUNDS = 2
FOLDS = 3
L2 = 1e-6
#: From this score by others' labels on a label stands; from that one on a clean text's sentence is taken as bad.
KEEPS_LABEL, CLEARLY_BAD = 0.3, 0.8

#: Digits and signs written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})

#: At least three single letters, divided by the same kind of sign.
SPACED = re.compile(r"(?<![\w'’])[^\W_](?:([ .\-_*])[^\W_])(?:\1[^\W_])+(?![\w'’])")
LINK = re.compile(r"(?:https?://|www\.)\S+")
BANG = re.compile(r"(?<=[a-z])!(?=[a-z])")
REPEATED = re.compile(r"([a-z])\1{2,}")
STOPS = ".!?…。！？\n"
END = "\0"
TOKEN = re.compile(rf"[{STOPS}]+|{END}|[^\W_][\w*@$|]*(?:['’][^\W_]+)*|[*@$]+\w[\w*@$]*")


def _unspaced(text: str) -> str:
    return SPACED.sub(lambda m: m.group().replace(m.group(1), ""), text)


def _cleaned(text: str | None, plain: Rewriter) -> str:
    if not text:
        return ""
    t = plain(text).lower().replace(END, " ")
    if "http" in t or "www." in t:
        t = LINK.sub(" ", t)
    return BANG.sub("i", t) if "!" in t else t


def canonical(word: str) -> str:
    """The word with letters for the digits and signs among its letters, and no letter more than twice."""
    if not word.isalpha() and any("a" <= c <= "z" for c in word):
        word = word.translate(LEET)
    return REPEATED.sub(r"\1", word)


def sentences(text: str, plain: Rewriter) -> list[list[str]]:
    """Words of each sentence, disguises undone."""
    out: list[list[str]] = [[]]
    for w in TOKEN.findall(_unspaced(_cleaned(text, plain))):
        if w[0] in STOPS:
            out.append([])
        else:
            out[-1].append(canonical(w))
    return [s for s in out if s]


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh32_intdigest(text.encode("utf-8", "replace"), seed)


def subwords(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and their character n-grams, and the word of each, in the words' order."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), [len(m) for m in marked])
    cols = [np.array([_hash(w, 1) % BUCKETS for w in words], np.int64)]
    rows = [np.arange(len(words))]
    for n in NGRAMS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = of[:size] == of[n - 1 :]
        cols.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        rows.append(of[:size][inside])
    col, row = np.concatenate(cols), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return col[order], row[order]


def pair_buckets(keys: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from their hashes."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15) + follows * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(BUCKETS)


class Bags:
    """Sentences as word rows, neighbour buckets and offsets."""

    def __init__(self) -> None:
        self.row_of: dict[str, int] = {}
        self.keys: list[int] = []

    def rows(self, words: Sequence[str]) -> list[int]:
        out = []
        for w in words:
            r = self.row_of.get(w)
            if r is None:
                r = self.row_of[w] = len(self.row_of)
                self.keys.append(_hash(w, 3))
            out.append(r)
        return out


class Averaging:
    """The averaging of groups of columns, and its transpose, as sums over sorted runs."""

    def __init__(self, cols: np.ndarray, rows: np.ndarray, n_cols: int, n_rows: int):
        self.sides = []
        for to, of, size in ((rows, cols, n_rows), (cols, rows, n_cols)):
            order = np.argsort(to, kind="stable")
            there, starts = np.unique(to[order], return_index=True)
            self.sides.append((of[order], there, starts, size))

    def sums(self, values: np.ndarray, back: bool = False) -> np.ndarray:
        of, there, starts, size = self.sides[back]
        out = np.zeros((size, values.shape[1]), values.dtype)
        if len(of):
            out[there] = np.add.reduceat(values[of], starts, axis=0)
        return out


def _flat(groups: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(g) for g in groups])
    return np.fromiter((c for g in groups for c in g), np.int64, int(n.sum())), np.repeat(np.arange(len(groups)), n)


class Classifier:
    """Joint embeddings and softmax. ``logit`` is the table of class scores by bucket."""

    def __init__(self, logit: np.ndarray, bias: np.ndarray):
        self.logit, self.bias = logit.astype(np.float32), bias.astype(np.float32)
        self._row: dict[str, int] = {}
        self._words = np.zeros((1024, logit.shape[1]), np.float32)
        self._keys = np.zeros(1024, np.uint64)
        self._single = np.zeros(1024, bool)

    def _rows(self, tokens: list[str]) -> np.ndarray:
        """Rows of the tokens; row 0 stands for a sentence's end, row 1 for a text's."""
        table = self._row
        if len(table) > 500_000:
            table.clear()
        if not table:
            table[END] = 1
        new = []
        for w in set(tokens).difference(table):
            if w[0] in STOPS:
                table[w] = 0
            else:
                table[w] = max(2, len(table) + 1)
                new.append(w)
        if new:
            size = max(table.values()) + 1
            if size > len(self._words):
                more = max(size, 2 * len(self._words)) - len(self._words)
                self._words = np.concatenate([self._words, np.zeros((more, self._words.shape[1]), np.float32)])
                self._keys = np.concatenate([self._keys, np.zeros(more, np.uint64)])
                self._single = np.concatenate([self._single, np.zeros(more, bool)])
            words = [canonical(w) for w in new]
            at = np.array([table[w] for w in new])
            cols, rows = subwords(words)
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            self._words[at] = np.add.reduceat(self.logit[cols], starts) / np.diff(np.r_[starts, len(cols)])[:, None]
            self._keys[at] = [_hash(w, 3) for w in words]
            self._single[at] = [len(w) == 1 for w in words]
        return np.fromiter(map(table.__getitem__, tokens), np.int64, len(tokens))

    def scores(self, texts: Sequence[str | None], plain: Rewriter) -> np.ndarray:
        """Class probabilities of each text's worst sentence; certain ``none`` for texts without words."""
        clean = [_cleaned(t, plain) for t in texts]
        out, spaced = self._judge(clean)
        if len(spaced):
            # Three single letters or more: they may spell a word.
            out[spaced] = self._judge([_unspaced(clean[i]) for i in spaced])[0]
        return out

    def _judge(self, clean: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and the texts that hold three single letters or more."""
        out = np.zeros((len(clean), len(CLASSES)))
        out[:, 0] = 1.0
        rows = self._rows(TOKEN.findall(END.join(clean)))
        of = np.cumsum(rows == 1)
        is_word = rows > 1
        singles = np.bincount(of[is_word & self._single[rows]], minlength=len(clean)) if len(rows) else np.zeros(len(clean))
        spaced = np.flatnonzero(singles >= 3)
        if not is_word.any():
            return out, spaced
        sentence = np.cumsum(~is_word)[is_word]
        rows, of = rows[is_word], of[is_word]
        starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        x, keys = self._words[rows], self._keys[rows]
        x[1:] += np.where((sentence[1:] == sentence[:-1])[:, None], self.logit[pair_buckets(keys[:-1], keys[1:])], 0)
        n = np.diff(np.r_[starts, len(rows)])[:, None]
        p = _softmax(np.add.reduceat(x, starts) / (2 * n - 1) + self.bias)
        of = of[starts]
        order = np.lexsort((p[:, 0], of))
        lead = order[np.r_[True, of[order][1:] != of[order][:-1]]]
        out[of[lead]] = p[lead]
        return out, spaced


def fit(texts: Sequence[str], labels: Sequence[int], plain: Rewriter, clean_weight: float = 1.0, seed: int = 42) -> Classifier | None:
    """The classifier of labelled texts (indices of CLASSES); None if a side is missing.

    ``clean_weight`` makes up for a sample that has too few clean texts: the
    number of them that each one stands for, against the others.
    """
    if not len(texts) or not any(labels) or all(labels):
        return None
    bags = Bags()
    owner: list[int] = []
    groups: list[list[int]] = []
    for i, t in enumerate(texts):
        for s in sentences(t, plain):
            groups.append(bags.rows(s))
            owner.append(i)
    if not groups:
        return None
    words = list(bags.row_of)
    keys = np.array(bags.keys, np.uint64)
    pc, pr = subwords(words)
    wc, wr = _flat(groups)
    flat = keys[wc]
    inner = wr[1:] == wr[:-1]
    nc, nr = pair_buckets(flat[:-1], flat[1:])[inner].astype(np.int64), wr[1:][inner]
    used, at = np.unique(np.concatenate([pc, nc]), return_inverse=True)
    # Sub-words of words, then words and neighbours of sentences: two averaging steps.
    by_word = Averaging(at[: len(pc)], pr, len(used), len(words))
    part_share = (1.0 / np.bincount(pr, minlength=len(words)).astype(np.float32))[:, None]
    own, doc = np.array(owner), np.array(labels)
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    fold = np.random.default_rng(seed).integers(0, FOLDS, len(texts))[own]
    beside = at[len(pc) :]

    def train(of: np.ndarray, target: np.ndarray, steps: int, boost: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings, softmax and bias from the sentences ``of``."""
        place = np.cumsum(of) - 1
        here, near = of[wr], of[nr]
        w_of = Averaging(wc[here], place[wr[here]], len(words), int(of.sum()))
        n_of = Averaging(beside[near], place[nr[near]], len(used), int(of.sum()))
        share = (1.0 / np.array([2 * len(g) - 1 for g, x in zip(groups, of, strict=True) if x], np.float32))[:, None]
        goal = target[of]
        truth = np.eye(len(CLASSES), dtype=np.float32)[goal]
        clean = clean_weight * (goal == 0).sum()
        weight = np.where(goal > 0, max(1.0, 0.25 * clean / max(1, (goal > 0).sum())) if boost else 1.0, clean_weight).astype(np.float32)[:, None]
        weight /= weight.sum()
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.3, (len(used), DIM)).astype(np.float32)
        soft = rng.normal(0, 0.3, (DIM, len(CLASSES))).astype(np.float32)
        bias = np.zeros(len(CLASSES), np.float32)
        state = [[np.zeros_like(v), np.zeros_like(v)] for v in (emb, soft, bias)]
        for step in range(1, steps + 1):
            h = (w_of.sums(by_word.sums(emb) * part_share) + n_of.sums(emb)) * share
            g = (_softmax(h @ soft + bias) - truth) * weight
            gh = (g @ soft.T) * share
            grads = (by_word.sums(w_of.sums(gh, True) * part_share, True) + n_of.sums(gh, True) + L2 * emb, h.T @ g, g.sum(axis=0))
            for v, grad, (m1, m2) in zip((emb, soft, bias), grads, state, strict=True):
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                v -= 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        return emb, soft, bias

    def predict(of: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        emb, soft, bias = model
        here, near = of[wr], of[nr]
        place = np.cumsum(of) - 1
        size = int(of.sum())
        h = Averaging(wc[here], place[wr[here]], len(words), size).sums(by_word.sums(emb) * part_share)
        h += Averaging(beside[near], place[nr[near]], len(used), size).sums(emb)
        n = np.array([2 * len(g) - 1 for g, x in zip(groups, of, strict=True) if x], np.float32)[:, None]
        return _softmax(h / n @ soft + bias)

    target = doc[own]
    for turn in range(ROUNDS):
        # Each part of the texts is judged by a model that has not seen it, so no wrong label is learnt by heart.
        p = np.zeros((len(groups), len(CLASSES)))
        p[:, 0] = 1
        for k in range(FOLDS):
            out = fold == k
            if out.any() and (target[~out] > 0).any():
                p[out] = predict(out, train(~out, target, STEPS, turn == 0))
        bad = 1 - p[:, 0]
        worst = np.repeat(np.maximum.reduceat(bad, first), np.diff(np.r_[first, len(own)]))
        # A labelled text's worst sentences carry its label, if any does; a text said to be clean may hold one that is clearly not.
        carries = (bad >= 0.5 * worst) & (worst >= KEEPS_LABEL)
        target = np.where((doc[own] > 0) & carries, doc[own], 0)
        target = np.where((doc[own] == 0) & (bad >= CLEARLY_BAD), 1 + p[:, 1:].argmax(axis=1), target)
    if not target.any():
        target = doc[own]
    emb, soft, bias = train(np.ones(len(groups), bool), target, 2 * STEPS, False)
    logit = np.zeros((BUCKETS, len(CLASSES)))
    logit[used] = emb @ soft
    return Classifier(logit, bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def labelled_sample(labels: DataFrame, texts: DataFrame, key: str, text: str, seed: int = 42) -> tuple[list[str], list[int], float]:
    """Texts and classes of at most MOST_POSITIVE + MOST_NEGATIVE labels, collected,
    and how many clean labels each sampled one stands for, against the others.

    ``labels`` has ``key``, ``is_abusive`` and ``category``; rows without either
    judgement or without a text drop out. Of several texts of a key the longest
    counts.
    """
    abusive = F.coalesce(F.col("is_abusive") == 1, F.col("category").isin(*CLASSES[1:]))
    kind = F.when(~abusive, "none").otherwise(F.when(F.col("category").isin(*CLASSES[1:]), F.col("category")).otherwise("abusive"))
    judged = labels.where(F.col(key).isNotNull() & abusive.isNotNull()).select(F.col(key).alias("__key"), kind.alias("__class"), F.xxhash64(F.lit(seed), key, *[c for c in ("rater",) if c in labels.columns]).alias("__k"))
    sample = judged.where("__class != 'none'").orderBy("__k").limit(MOST_POSITIVE).unionByName(judged.where("__class = 'none'").orderBy("__k").limit(MOST_NEGATIVE))
    n = judged.agg(F.count_if(F.col("__class") != "none").alias("bad"), F.count_if(F.col("__class") == "none").alias("clean")).first()
    weight = max(1.0, n["clean"] / MOST_NEGATIVE) / max(1.0, n["bad"] / MOST_POSITIVE)
    # At most 6,000 keys.
    found = texts.where(F.col(text).isNotNull()).join(F.broadcast(sample), texts[key] == F.col("__key")).groupBy("__key", "__class", "__k").agg(F.max_by(text, F.length(text)).alias("t"))
    rows = found.orderBy("__k", "__key", "__class").collect()
    return [r["t"] for r in rows], [CLASSES.index(r["__class"]) for r in rows], weight


def score(df: DataFrame, text: str, model: Classifier | None, counts: Mapping[str, int]) -> DataFrame:
    """``df`` with ``p_abusive``, ``p_hateful``, ``p_sexual`` and ``p_bad`` (their sum) in place of ``text``.

    Null and wordless texts score 0, and so does everything without a model.
    """
    names = [*(f"p_{c}" for c in CLASSES[1:]), "p_bad"]
    rest = [f for f in df.schema.fields if f.name != text]
    sc = df.sparkSession.sparkContext
    shared = None if model is None else Shared(sc, (model.logit, model.bias))
    plainly = Shared(sc, dict(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            p = np.zeros((batch.num_rows, 4))
            p[:, 0] = 1
            if shared is not None:
                p = shared.model("classifier", lambda v: Classifier(*v)).scores(batch.column(last).to_pylist(), rewriter_of(plainly))
            columns = [pa.array(p[:, k].astype(np.float64)) for k in (1, 2, 3)] + [pa.array(1 - p[:, 0])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *columns], names=[*[f.name for f in rest], *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), *(f"{n} double" for n in names)])
    return df.select(*[F.col(f.name) for f in rest], F.col(text).alias("__text")).mapInArrow(run, schema)


def rates(scored: DataFrame, by: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Texts, abusive texts and mean score per group; null groups are kept."""
    return scored.groupBy(*by).agg(F.count("*").alias("n_texts"), F.count_if(F.col("p_bad") >= threshold).alias("n_bad"), F.avg("p_bad").alias("mean_score"))


__all__ = ["CLASSES", "Classifier", "fit", "frequencies", "labelled_sample", "rates", "score", "sentences"]
