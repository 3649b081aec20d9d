"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it in ``body``: lambdas do not share common subexpressions by themselves."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def text_key(c: Column) -> Column:
    """The comparison key of a command: case folded, white space collapsed."""
    return squeeze(casefold(c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_quotes(c: Column) -> Column:
    """White space, then quotes of either kind, off both ends."""
    return F.regexp_replace(strip(c), "^[\"']+|[\"']+$", "")


def safe_ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))
