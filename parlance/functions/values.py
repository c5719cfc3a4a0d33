"""Truthiness: what an empty string, null or a missing list counts as."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(x: Column) -> Column:
    """A string that is neither null nor empty."""
    return F.coalesce(x != "", F.lit(False))


def or_else(*choices: Column | str) -> Column:
    """The first choice that is neither null nor empty, else the last one."""
    columns = [c if isinstance(c, Column) else F.lit(c) for c in choices]
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns[:-1]), columns[-1])


def some(items: Column, test: Callable[[Column], Column]) -> Column:
    """Whether a test holds for some element; false for a null list, and for tests that give null."""
    return F.coalesce(F.exists(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def nonempty(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def contains(text: Column, needle: str) -> Column:
    """Literal substring, case-insensitive; false for null."""
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))
