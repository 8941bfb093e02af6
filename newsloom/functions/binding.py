"""Naming intermediate values, so that big expressions stay small and are computed once.

Functions with many steps are written as SQL lambda text: one call hands them to Spark, where building
them call by call from Python would take longer than many a query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apply(value: Column, function: str) -> Column:
    """A SQL lambda ``x -> ...`` applied to a value, which is computed once."""
    return F.get(F.call_function("transform", F.array(value), F.expr(function)), F.lit(0))


def bind(value: str, name: str, body: str) -> str:
    """The same within SQL text: ``body`` may mention ``name`` any number of times."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def settled(df: DataFrame, *computed: str) -> DataFrame:
    """The same rows; filters on ``computed`` columns stay above their computation.

    Spark pushes a filter below a projection by repeating the projected expression, so a text would be
    taken apart once for the filter and again for the result. A generator is a line filters on its
    output do not cross; the outer form adds no filter of its own.
    """
    others = [c for c in df.columns if c not in computed]
    return df.select(*others, F.inline_outer(F.array(F.struct(*computed)))).select(*df.columns)
