"""Deterministic classifiers and themes of texts, by word lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words of the stand-in classifiers. A trained model takes their place by `classify_with`.
POSITIVE = "praise|support|protect|strengthen|celebrate|endorse|champion|rescue|welcome|promote"
GROUPS = "we|us|our|ours|they|them|their|theirs|those|these"
URGENT = "never|always|every|everyone|nobody|ruin|crush|exploit|destroy|seize"
CLASSIFIERS = {"is_positive": POSITIVE, "is_intergroup": GROUPS, "is_prime": URGENT}

#: The themes of free answers.
THEMES = {
    "incivility": "civility|civil|curse|cuss|cussing|hate|hateful|harm|harsh|insult|mean|offensive|profane|profanity|rude|threat|threatening|toxic|violence|violent",
    "evidence": "accurate|accuracy|evidence|fact|facts|false|lies?|misinformation|misleading|truth|true|untrue",
    "discussion": "conversation|debate|discuss|discussion|productive|respect|respectful|viewpoint|viewpoints",
    "comparison": "both|compared?|comparable|counterpart|mirror|pair|same|similar",
    "agreement": "agree|agreed|disagree|disagreed|belief|believe|opinion|opinions",
}


def mentions(c: Column | str, words: str) -> Column:
    """Whether a text has one of the words; null counts as an empty text."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.lower(t).rlike(rf"\b(?:{words})\b")


def classify(name: str, c: Column | str) -> Column:
    """A classifier by name; an unknown name is an error that lists them."""
    if name not in CLASSIFIERS:
        raise KeyError(f"unknown classifier {name}; there are {', '.join(sorted(CLASSIFIERS))}")
    return mentions(c, CLASSIFIERS[name])


def classify_with(df: DataFrame, text: str, name: str, predict: Callable[[list[str]], list[bool]]) -> DataFrame:
    """Adds ``name``: what ``predict`` says of batches of texts, in Arrow batches; null texts are passed as empty ones."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(predict(b.fillna("").tolist()), dtype="boolean")

    return df.withColumn(name, run(F.col(text)))
