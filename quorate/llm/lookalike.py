"""Look-alike characters brought to one form.

Code points and short strings that look the same are united into classes
(transitively, by union-find). A class's representative is its most frequent
member in the corpus. Texts are rewritten greedily, longest pattern first, by a
multi-pattern automaton.

Two tables come of this. The *plain* table unites presentation forms (full
width, mathematical, ligatures, circled, Arabic shaping forms), split accents,
invisible characters and special spaces; it holds in any text. The *Latin* table
also unites letters of other alphabets and phonetic letters with the Latin
letters they look like; it holds only in words that are Latin otherwise.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm.shared import Shared

#: Letters of other alphabets and phonetic letters beside the Latin letter they look like.
LIKE_LATIN = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲᴄ", "d": "ԁɗ", "e": "еҽ", "f": "ғ", "g": "ɡց", "h": "һհ", "i": "іıɩιɪ", "j": "јϳ", "k": "кκᴋ", "l": "ӏǀ",
    "m": "мᴍ", "n": "пոɴ", "o": "оοօᴏ", "p": "рρ", "q": "ԛգ", "r": "гᴦʀ", "s": "ѕꜱ", "t": "тτᴛ", "u": "υսʋᴜ", "v": "ѵνᴠ", "w": "ԝωᴡ", "x": "хχ", "y": "уүγʏ", "z": "ᴢ",
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "ᎠᎴ", "E": "ЕΕᎬ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "ΝՆ",
    "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Սᑌ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "УΥҮ", "Z": "ΖᏃ",
}

#: Compatibility characters that are proper typography, not disguise.
TYPOGRAPHIC = set("…‥․‘’‚“”„‹›«»–—―‐‑′″‴™℠№ªº°·¨¯´¸´΄῾‗¼½¾²³¹µ℃℉")

#: Kinds of compatibility mapping that are presentation forms.
FORMS = {"<wide>", "<narrow>", "<font>", "<compat>", "<circle>", "<super>", "<sub>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<small>", "<vertical>"}

INVISIBLE = regex.compile(r"[\p{Cf}\p{Variation_Selector}ᅟᅠㅤﾠ͏--؀-؅۝܏࣢\U000110BD]", regex.V1)

EMOJI = regex.compile(r"\p{Extended_Pictographic}")
JOINING = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Gujarati}\p{Khmer}\p{Myanmar}]")
LEFTWARD = regex.compile(r"[\p{Arabic}\p{Hebrew}\p{Syriac}\p{Thaana}]")
SPACELESS = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
HAN = regex.compile(r"\p{Han}")
WIDE_FORM = regex.compile(r"[\uff01-\uff20\u3000]")
#: Full-width punctuation, digits and the wide space are at home beside these scripts.
WIDE_SCRIPT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}\u3001\u3002\u300c-\u300f\u30fc]")
WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
LATIN = regex.compile(r"\p{Latin}")
FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Canadian_Aboriginal}ɑɡıɩɪʀɴʏᴀ-ᴢꜰꜱƅɗʋǀᴦ]")


def _near(text: str, at: int, step: int, over: regex.Pattern) -> str:
    """The next character before or after ``at`` that ``over`` does not match; empty at the end."""
    at += step
    while 0 <= at < len(text) and over.match(text[at]):
        at += step
    return text[at] if 0 <= at < len(text) else ""


NOT_LETTER = regex.compile(r"[^\p{L}]")
MARK = regex.compile(r"[\p{M}]")
EMOJI_PART = regex.compile(r"[\p{Emoji_Modifier}\ufe0f]")


def has_task(text: str, at: int) -> bool:
    """Whether the invisible character at ``at`` shapes an emoji, a joining script, or writing to the left."""
    c, before, after = text[at], text[at - 1 : at], text[at + 1 : at + 2]
    if c == "\u200d" and EMOJI.match(after) and EMOJI.match(_near(text, at, -1, EMOJI_PART)):
        return True
    if c in "\ufe0e\ufe0f":
        return bool(EMOJI.match(before) or (before and before in "#*0123456789" and after == "\u20e3") or (EMOJI_PART.match(before) and before != c))
    if "\U000e0020" <= c <= "\U000e007f":
        return _near(text, at, -1, TAG) == "\U0001f3f4"
    if c in "\u200c\u200d\u180b\u180c\u180d\u180e\u180f":
        return bool(JOINING.match(_near(text, at, -1, MARK)))
    if c in "\u200e\u200f\u061c":
        return bool(LEFTWARD.match(_near(text, at, -1, NOT_LETTER)) or LEFTWARD.match(_near(text, at, 1, NOT_LETTER)))
    if c == "\u200b":
        return bool(SPACELESS.match(after))
    return bool(HAN.match(before)) and unicodedata.category(c) == "Mn"


TAG = regex.compile(r"[\U000e0020-\U000e007f]")


WIDE_FORMS = {"\u3000", *map(chr, range(0xFF01, 0xFF21))}
EMOJI_TASKS = {"\u200d", "\ufe0f"}
#: Invisible characters, and the blocks of the alphabets that have look-alikes of Latin letters.
SUSPECT = {chr(i) for i in range(0xA0, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cf" or INVISIBLE.match(chr(i))} | {chr(i) for lo, hi in ((0x370, 0x590), (0x13A0, 0x1680)) for i in range(lo, hi)}


class UnionFind:
    """Disjoint classes of strings, with path halving."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def unite(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for x in list(self.up):
            found.setdefault(self.find(x), []).append(x)
        return found


def _is_form(c: str, kind: str, plain: str) -> bool:
    if c in TYPOGRAPHIC or kind not in FORMS or plain.startswith(" ") and plain != " ":
        return False
    if any(unicodedata.category(p)[0] not in "LNPZS" for p in plain) and kind not in ("<initial>", "<medial>", "<final>", "<isolated>"):
        return False
    if kind in ("<super>", "<sub>"):
        return c.isalpha() and plain.isascii()
    if kind == "<compat>":  # ligatures and the like, not roman numerals or units
        return unicodedata.category(c)[0] in "LZ"
    return True


def plain_edges() -> Iterator[tuple[str, str]]:
    """Pairs of look-alikes of one script, from the Unicode character data."""
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        mapping = unicodedata.decomposition(c)
        if not mapping:
            continue
        if mapping[0] == "<":
            kind, _, codes = mapping.partition(" ")
            plain = "".join(chr(int(x, 16)) for x in codes.split())
            if _is_form(c, kind, plain):
                yield c, unicodedata.normalize("NFC", plain)
        else:
            whole = unicodedata.normalize("NFC", c)
            for split in {unicodedata.normalize("NFD", c), "".join(chr(int(x, 16)) for x in mapping.split())}:
                if split != whole:
                    yield split, whole
            if whole != c:
                yield c, whole
    yield " ", " "
    for hook, whole in (("´", "ˊ"),):
        yield hook, whole


def latin_edges() -> Iterator[tuple[str, str]]:
    for letter, others in LIKE_LATIN.items():
        for o in others:
            yield o, letter


def _best(members: Iterable[str], counts: Mapping[str, int]) -> str:
    """The most frequent member; of equals, composed and plain ones before others."""
    return min(members, key=lambda m: (-counts.get(m, 0), len(m), [ord(x) for x in m]))


class Rewriter:
    """The two tables and their automata, for the frequencies of one corpus."""

    def __init__(self, counts: Mapping[str, int] | None = None):
        counts = counts or {}
        plain = UnionFind()
        for a, b in plain_edges():
            plain.unite(a, b)
        self.plain: dict[str, str] = {}
        for members in plain.classes().values():
            # Decomposed or shaped spellings never stand for a class that has a proper one.
            proper = [m for m in members if len(m) == 1 and unicodedata.normalize("NFKC", m) == m] or [m for m in members if unicodedata.normalize("NFKC", m) == m] or members
            best = _best(proper, counts)
            self.plain |= {m: best for m in members if m != best}
        self.plain.pop(" ", None)
        wide = UnionFind()
        for a, b in latin_edges():
            wide.unite(a, b)
        self.latin: dict[str, str] = {}
        for members in wide.classes().values():
            best = _best([m for m in members if m.isascii()], counts)
            self.latin |= {m: best for m in members if m != best}
        # Characters that end a pattern or may need a look at their word; a text without any is in its form already.
        self._suspect = SUSPECT | {m[-1] for m in self.plain if not m.isascii()} | {c for m in self.latin for c in m}
        # Patterns with a character that the corpus lacks cannot occur and only slow the automata's roots.
        if counts:
            self.plain = {m: best for m, best in self.plain.items() if all(c in counts for c in m)}
        self._forms = {m[-1] for m in self.plain}
        self._plain = self._automaton(self.plain)
        self._latin = self._automaton(self.latin)

    @staticmethod
    def _automaton(rules: Mapping[str, str]):
        auto = ahocorasick.Automaton()
        for pattern, best in rules.items():
            auto.add_word(pattern, (len(pattern), best))
        auto.make_automaton()
        return auto

    @staticmethod
    def _greedy(auto, text: str, keep: set[int] | None = None) -> str:
        out, at = [], 0
        for end, (n, best) in auto.iter_long(text):
            begin = end - n + 1
            if keep and begin in keep:
                continue
            out += [text[at:begin], best]
            at = end + 1
        return text if not out else "".join([*out, text[at:]])

    def _words(self, text: str) -> str:
        """Words of Latin letters and their look-alikes in Latin letters alone."""
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
        foreign = [w for w in words if FOREIGN.search(w[2])]
        if not foreign:
            return text
        # Are there words of another alphabet, beyond the look-alikes? Then words of look-alikes alone may be theirs.
        own = any(not LATIN.search(w[2]) and any(c not in self.latin and FOREIGN.match(c) for c in w[2]) for w in foreign)
        latin = sum(1 for w in words if LATIN.search(w[2]) and not FOREIGN.search(w[2]))
        out, at = [], 0
        for begin, end, word in foreign:
            plain = self._greedy(self._latin, word)
            mixed = any(LATIN.match(c) and c not in self.latin for c in word)
            if not FOREIGN.search(plain) and (mixed or (not own and latin)):
                out += [text[at:begin], plain]
                at = end
        return "".join([*out, text[at:]])

    def __call__(self, text: str) -> str:
        """The text in its one form; unchanged if nothing in it needs that."""
        if text.isascii():
            return text
        suspect = self._suspect.intersection(text)
        if not suspect:
            return text
        if suspect <= EMOJI_TASKS:
            return INVISIBLE.sub(lambda m: m.group() if has_task(m.string, m.start()) else "", text)
        seen: set[str] = set()
        while text not in seen:  # until nothing changes
            seen.add(text)
            text = INVISIBLE.sub(lambda m: m.group() if has_task(m.string, m.start()) else "", text)
            home = set() if suspect.isdisjoint(WIDE_FORMS) else {m.start() for m in WIDE_FORM.finditer(text) if WIDE_SCRIPT.match(_near(text, m.start(), -1, WIDE_FORM)) or WIDE_SCRIPT.match(_near(text, m.start(), 1, WIDE_FORM))}
            if not self._forms.isdisjoint(text):
                text = self._greedy(self._plain, text, home)
            if FOREIGN.search(text):
                text = self._words(text)
        return text


@lru_cache(maxsize=1)
def default_rewriter() -> Rewriter:
    """Representatives without a corpus: plain and composed members first."""
    return Rewriter()


def rewriter_of(shared: Shared) -> Rewriter:
    """One rewriter per Python worker and corpus, from broadcast frequencies."""
    return shared.model("rewriter", Rewriter)


def frequencies(df: DataFrame, text: str) -> dict[str, int]:
    """Counts of all code points of the corpus (at most as many as Unicode has)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sys.maxunicode + 1, np.int64)
        for batch in batches:
            joined = "".join(t for t in batch.column(0).to_pylist() if t)
            total += np.bincount(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([chr(i) for i in there if not 0xD800 <= i < 0xE000], pa.string()), pa.array([int(total[i]) for i in there if not 0xD800 <= i < 0xE000], pa.int64())], names=["c", "n"])

    parts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).mapInArrow(count, "c string, n long")
    return {r["c"]: r["n"] for r in parts.groupBy("c").agg(F.sum("n").alias("n")).collect()}


def unify(df: DataFrame, text: str, name: str = "plain_text", counts: Mapping[str, int] | None = None) -> DataFrame:
    """``df`` with the column ``name``: ``text`` in its one form; null stays null.

    ``counts`` are the frequencies that choose the representatives; without them
    they are counted over ``df``. ASCII texts pass unchanged and never leave the
    JVM's columns. All columns and rows are kept; a column called ``name`` is replaced.
    """
    counts = frequencies(df, text) if counts is None else counts
    shared = Shared(df.sparkSession.sparkContext, dict(counts))

    @F.pandas_udf(T.StringType())
    def rewrite(batch):
        one = rewriter_of(shared)
        return batch.map(lambda t: None if t is None else one(t))

    special = F.col(text).rlike(r"[^\x00-\x7F]")
    # The Python step sees null for every text that needs none of it.
    return df.withColumn(name, F.coalesce(rewrite(F.when(special, F.col(text))), F.col(text)))
