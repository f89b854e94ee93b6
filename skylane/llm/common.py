"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skylane.session import HOT_SHARE, counted, join_answers

__all__ = ["HOT_SHARE", "WHITE_CLASS", "counted", "join_answers", "let", "text_of"]

# The characters that separate words (fixed values: blank, tab, line feed, vertical tab, form feed, carriage return).
WHITE_CLASS = r"[\x20\x09-\x0D]"


def text_of(column: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]
