"""Byte-level BPE as a deterministic automaton over tokens.

The merges of a vocabulary define a transition system whose arcs are labelled
with tokens. It starts as one state with an arc per byte. The gadget of merge
(left, right) -> whole adds arcs for ``whole`` beside every path left-right and
forbids the path itself; after all gadgets the accepted arc sequences are
exactly the encodings the merges produce. A state is determined by the token on
the arc that enters it, so the table holds one row per token. Rows are filled on
demand: whether an arc ``b`` leaves state ``a`` is settled by running the gadgets
along the seam of ``a`` and ``b`` from the last one back, and remembered.

Reading a word is a walk over its byte positions. At each position exactly one
arc ends a path from the start; candidates come from a trie of reversed tokens.
Cost is linear in the word times the longest token, whatever the word's length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quorate.llm.shared import Shared

#: Fixed value: the public pre-split pattern of the byte_bpe_50k vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _byte_of_char() -> dict[str, int]:
    """Printable stand-ins of the vocabulary file -> bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Encoder and decoder of one vocabulary file (``tokenizers`` JSON format)."""

    def __init__(self, vocabulary: str | bytes, remember: int = 200_000):
        model = json.loads(vocabulary)["model"]
        table = _byte_of_char()
        self.text_of: dict[int, bytes] = {}
        for shown, i in model["vocab"].items():
            if all(c in table for c in shown):
                self.text_of[i] = bytes(table[c] for c in shown)
        # A state's number is its token's place among bytes and merges, so that a later gadget has a higher number.
        ids = [0] * 256
        for shown, i in model["vocab"].items():
            if len(shown) == 1 and shown in table:
                ids[table[shown]] = i
        vocab = model["vocab"]
        place = {i: b for b, i in enumerate(ids)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.gadget: dict[tuple[int, int], int] = {}
        for left, right in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            pair = place[vocab[left]], place[vocab[right]]
            whole = vocab[left + right]
            if whole in place:
                continue
            place[whole] = state = len(ids)
            ids.append(whole)
            self.parts.append(pair)
            self.gadget[pair] = state
        self.ids = ids
        self._reversed: dict[int, dict] = {}
        self._grow()
        self._arcs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._remember = remember
        self._split = regex.compile(SPLIT).findall

    def _grow(self) -> None:
        """Trie over reversed tokens: node -> {byte: node}, the state under key -1."""
        root: dict = {}
        for state, i in enumerate(self.ids):
            node = root
            for b in reversed(self.text_of[i]):
                node = node.setdefault(b, {})
            node[-1] = state
        self._reversed = root

    def arc(self, a: int, b: int) -> bool:
        """Whether arc ``b`` leaves state ``a`` once all gadgets are applied."""
        known = self._arcs.get((a, b))
        if known is None:
            if len(self._arcs) > 4_000_000:
                self._arcs.clear()
            known = self._arcs[a, b] = self._seam(a, b)
        return known

    def _seam(self, a: int, b: int) -> bool:
        """Undo the gadgets at the seam of ``a`` and ``b``, latest first.

        The arc is lost if, at some moment, a gadget would have joined the two
        pieces that touch before either of them was swallowed by its own next
        merge. ``before`` is that next merge; on equal numbers the left one runs
        first, as the merges of a word run from the left.
        """
        before = len(self.ids)
        left, right = a, b
        while True:
            joined = self.gadget.get((left, right))
            if joined is not None and joined < before:
                return False
            if left > right:
                if self.parts[left] is not None:
                    before, left = left, self.parts[left][1]
                    continue
                if self.parts[right] is None:
                    return True
                before, right = right + 1, self.parts[right][0]
            else:
                if self.parts[right] is not None:
                    before, right = right + 1, self.parts[right][0]
                    continue
                if self.parts[left] is None:
                    return True
                before, left = left, self.parts[left][1]

    def word(self, word: str) -> tuple[int, ...]:
        """Token ids of one pre-split word."""
        found = self._words.get(word)
        if found is None:
            found = self._walk(word.encode("utf-8", "surrogatepass"))
            if len(word) <= 64:
                if len(self._words) >= self._remember:
                    self._words.clear()
                self._words[word] = found
        return found

    def _walk(self, text: bytes) -> tuple[int, ...]:
        entered = [0] * len(text)
        sizes = [0] * len(text)
        for end in range(len(text)):
            node, begin = self._reversed, end
            while begin >= 0:
                node = node.get(text[begin])
                if node is None:
                    break
                state = node.get(-1)
                if state is not None and (begin == 0 or self.arc(entered[begin - 1], state)):
                    entered[end], sizes[end] = state, end - begin + 1
                    break
                begin -= 1
        found: list[int] = []
        end = len(text) - 1
        while end >= 0:
            found.append(self.ids[entered[end]])
            end -= sizes[end]
        found.reverse()
        return tuple(found)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; an empty list for an empty or null text."""
        found: list[int] = []
        if text:
            for word in self._split(text):
                found.extend(self.word(word))
        return found

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the arcs' labels."""
        return b"".join(self.text_of[i] for i in ids).decode("utf-8", "replace")


def _automaton(shared: Shared) -> Automaton:
    """One automaton per Python worker and vocabulary."""
    return shared.model("automaton", Automaton)


def _share(df: DataFrame, vocabulary: str):
    """The vocabulary file (under 2 MB whatever the data) as a broadcast."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    # By its content, so that what a worker has settled of the automaton serves later queries too.
    return Shared(df.sparkSession.sparkContext, data, hashlib.sha256(data).hexdigest())


def encode(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row.

    Null and empty texts get an empty list, repeated rows are kept, a null key
    stays null, further columns are ignored. Whole texts are encoded; strings
    that look like special tokens are ordinary text. An empty table gives an
    empty result.
    """
    shared = _share(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(shared)
        for batch in batches:
            rows = [auto.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=ends[1:])
            flat = np.fromiter((i for r in rows for i in r), np.int32, int(ends[-1]))
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    slim = df.select(df[key], df[text].cast("string").alias("__text"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return slim.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, name: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of ``text`` (0 for null) as column ``name``.

    The count replaces the text column; all other columns are kept.
    """
    shared = _share(df, vocabulary)
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(shared)
        for batch in batches:
            last = batch.num_columns - 1
            n = [len(auto.encode(t)) for t in batch.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(n, pa.int64())], names=[*[f.name for f in rest], name])

    slim = df.select(*[df[f.name] for f in rest], df[text].cast("string").alias("__text"))
    return slim.mapInArrow(run, T.StructType([*rest, T.StructField(name, T.LongType())]))
