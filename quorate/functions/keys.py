"""Keys and categories as the study's exports spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that may surround a key.
OUTER_SPACE = " \t\n\r\x0b\x0c"


def stripped(c: Column | str) -> Column:
    """Text without outer white space; null stays null."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(OUTER_SPACE))


def folded(c: Column | str) -> Column:
    """Text without outer white space, in lower case; null stays null."""
    return F.lower(stripped(c))


def usable(c: Column | str) -> Column:
    """True unless the value is null, blank or a written ``nan``; never null."""
    return F.coalesce(~folded(c).isin("", "nan"), F.lit(False))
