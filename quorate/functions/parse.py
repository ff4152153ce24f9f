"""Decisions, tiers, platforms and dates out of strings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorate.functions.keys import folded, stripped

INVALID = "__invalid__"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decision(c: Column | str) -> Column:
    """keep or remove if that is the first word of a generation, signs around it set aside; else ``__invalid__``."""
    first = F.element_at(F.split(stripped(F.coalesce(_c(c), F.lit(""))), r"\s+"), 1)
    word = F.btrim(F.lower(first), F.lit(".,:;!?\"'`"))
    return F.when(word.isin("keep", "remove"), word).otherwise(INVALID)


def label(c: Column | str) -> Column:
    """1 for remove, 0 for keep; another decision is an error."""
    d = folded(_c(c))
    return F.when(d == "remove", 1).when(d == "keep", 0).otherwise(F.raise_error(F.concat(F.lit("unexpected decision "), F.coalesce(d, F.lit("null")))).cast("int"))


def effective_label(predicted: Column | str, gold: Column | str) -> Column:
    """The predicted label; an invalid one counts as the wrong label."""
    p = _c(predicted)
    return F.when(p == "remove", 1).when(p == "keep", 0).otherwise(1 - _c(gold))


def mapped(c: Column | str, values: Mapping[str, str], what: str = "value") -> Column:
    """The value that a key stands for (without outer space and case); an unknown key is an error that names it, null stays null."""
    k = folded(_c(c))
    out = F.raise_error(F.concat(F.lit(f"unknown {what} "), k)).cast("string")
    for key, value in values.items():
        out = F.when(k == key, value).otherwise(out)
    return F.when(k.isNotNull(), out)


#: Platforms by id prefix, tiers of toxicity, and the other stance.
PLATFORMS = {"reddit": "reddit", "twitter": "twitter", "bluesky": "bluesky"}
TIERS = {"sample_low_toxicity": "low", "sample_middle_toxicity": "middle", "sample_high_toxicity": "high"}
OTHER_STANCE = {"left": "right", "right": "left"}


def platform(key: Column | str) -> Column:
    """The platform that an id's prefix names; an unknown prefix is an error."""
    return mapped(F.substring_index(_c(key), "_", 1), PLATFORMS, "platform")


def tier(criteria: Sequence[Column]) -> Column:
    """1 if all criteria hold, 2 if all but the last, and so on; one more than their number if the first does not."""
    out = F.lit(len(criteria) + 1)
    held = F.lit(True)
    for i, c in enumerate(criteria):
        held = held & c
        out = F.when(held, len(criteria) - i).otherwise(out)
    return out


def all_in(c: Column | str, values: Sequence[str]) -> Column:
    """Whether a comma-separated list has a value and only known ones; null, blank and ``no`` have none."""
    t = folded(F.coalesce(_c(c), F.lit("")))
    return ~t.isin("", "no") & F.forall(F.split(t, ","), lambda x: F.trim(x).isin(list(values)))


def local_time(seconds: Column | str, zone: str = "America/Chicago") -> Column:
    """Unix seconds as local time with its offset (``+hh:mm``), whatever the session's zone."""
    # Wall clocks without zone, so that the session's zone plays no part.
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _c(seconds).cast("decimal(18,6)"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    minutes = F.timestamp_diff("MINUTE", utc, local).cast("int")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), offset)


def run_time(name: Column | str) -> Column:
    """The time in a run's name (``yyyy_MM_dd-HH:mm:ss``), null where it is none."""
    return F.try_to_timestamp(F.regexp_extract(_c(name), r"(\d{4}_\d{2}_\d{2}-\d{2}:\d{2}:\d{2})", 1), F.lit("yyyy_MM_dd-HH:mm:ss"))


def run_name(at: Column | str) -> Column:
    """A run's name from its time."""
    return F.date_format(_c(at), "yyyy_MM_dd-HH:mm:ss")
