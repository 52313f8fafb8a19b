"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\r\f\u000b\u00a0"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def first_nonblank(*texts: Column) -> Column:
    return F.coalesce(*[blank_to_null(t) for t in texts])
