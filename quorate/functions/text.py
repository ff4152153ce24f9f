"""Text measures as column expressions.

Java's ``\\w`` is ASCII, so words, sentences and punctuation are spelt with
Unicode properties. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of the measures.
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"[.!?]+"
PUNCTUATION = r"[^\p{L}\p{N}_\s]"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def divided(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def char_count(c: Column | str) -> Column:
    return F.length(_text(c))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_text(c), F.lit(WORD))


def sentence_count(c: Column | str) -> Column:
    parts = F.split(_text(c), SENTENCE_END)
    return F.size(F.filter(parts, lambda s: F.regexp_replace(s, r"\s+", "") != ""))


def average_sentence_length(c: Column | str) -> Column:
    return divided(word_count(c), sentence_count(c))


def punctuation_count(c: Column | str) -> Column:
    return F.regexp_count(_text(c), F.lit(PUNCTUATION))


def punctuation_density(c: Column | str) -> Column:
    return divided(punctuation_count(c), char_count(c))


def syllables(word: Column) -> Column:
    """Groups of vowels, a last e uncounted unless it is the only one; at least 1, for nothing 0."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), n - F.when(w.endswith("e") & (n > 1), 1).otherwise(0)))


def _reading(c: Column | str) -> tuple[Column, Column, Column]:
    words = F.regexp_extract_all(_text(c), F.lit(r"(\p{L}+)"), 1)
    total = F.aggregate(F.transform(words, syllables), F.lit(0), lambda a, n: a + n)
    return F.size(words), F.greatest(F.lit(1), sentence_count(c)), total


def grade(c: Column | str) -> Column:
    """Flesch-Kincaid grade; 0 without words."""
    w, s, y = _reading(c)
    return F.when(w > 0, 0.39 * w / s + 11.8 * y / w - 15.59).otherwise(F.lit(0.0))


def reading_ease(c: Column | str) -> Column:
    """Flesch reading ease; 0 without words."""
    w, s, y = _reading(c)
    return F.when(w > 0, 206.835 - 1.015 * w / s - 84.6 * y / w).otherwise(F.lit(0.0))


#: The measures by name.
MEASURES: dict[str, Callable[[Column | str], Column]] = {
    "char_count": char_count,
    "word_count": word_count,
    "sentence_count": sentence_count,
    "average_sentence_length": average_sentence_length,
    "punctuation_count": punctuation_count,
    "punctuation_density": punctuation_density,
    "grade": grade,
    "reading_ease": reading_ease,
}


def measure(name: str, c: Column | str) -> Column:
    """A measure by name; an unknown name is an error that lists them."""
    if name not in MEASURES:
        raise KeyError(f"unknown measure {name}; there are {', '.join(sorted(MEASURES))}")
    return MEASURES[name](c)


def measure_triple(name: str, original: Column | str, mirror: Column | str) -> list[Column]:
    """The measure of both texts and mirror / original, 0 where that is undefined."""
    a, b = measure(name, original), measure(name, mirror)
    return [a.alias(f"original_{name}"), b.alias(f"mirror_{name}"), F.when(a != 0, b / a).otherwise(F.lit(0.0)).alias(f"ratio_{name}")]


def normalized(c: Column | str) -> Column:
    """Line ends as \\n, lines without trailing space, no outer space: the form that is hashed."""
    lines = F.split(F.regexp_replace(_text(c), "\r\n?", "\n"), "\n")
    return F.btrim(F.array_join(F.transform(lines, lambda s: F.regexp_replace(s, r"[ \t]+$", "")), "\n"), F.lit(" \t\n"))


def text_hash(c: Column | str) -> Column:
    return F.sha2(normalized(c), 256)


def collapsed(c: Column | str, most: int | None = None) -> Column:
    """White space as single spaces; beyond ``most`` characters cut with an ellipsis."""
    t = F.btrim(F.regexp_replace(_text(c), r"\s+", " "))
    return t if most is None else F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def tokens(c: Column | str, stop: list[str] | None = None) -> Column:
    """Lower-case ASCII words of two letters or more, without stop words, each once."""
    words = F.filter(F.split(F.lower(_text(c)), "[^a-z]+"), lambda w: F.length(w) > 1)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(stop)) if stop else words)


def pair_hash(a: Column | str, b: Column | str) -> Column:
    """Hash of both texts' hashes."""
    return F.sha2(F.concat(text_hash(a), F.lit("||"), text_hash(b)), 256)


def embedding_identity(c: Column | str, model: str, dimensions: int, unit: bool) -> Column:
    """Key of a text's embedding: hash of a version line and the JSON of what the embedding depends on, keys sorted."""
    t = F.btrim(_text(c), F.lit(" \t\n\r\x0b\x0c"))
    blob = F.to_json(F.struct(F.lit(dimensions).alias("dimensions"), F.lit(model).alias("model_id"), F.lit(unit).alias("normalize"), t.alias("text")))
    return F.sha2(F.concat(F.lit("v1\n"), blob), 256)


#: Entities that exports leave in texts.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def plain_entities(c: Column | str) -> Column:
    """Entities as characters, white space as single spaces."""
    t = _text(c)
    for entity, sign in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def outer_stripped(c: Column | str) -> Column:
    """Text without ASCII white space around it."""
    return F.regexp_replace(F.regexp_replace(_text(c), r"^\s+", ""), r"\s+$", "")


def terms(c: Column | str, stop: list[str]) -> Column:
    """Lower-case ASCII words, numbers and underscores of two characters or more, in order, without stop words."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit("([a-z0-9_]+)"), 1)
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(stop))


def grams(words: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")), lambda g: F.size(F.split(g, " ")) == n)
