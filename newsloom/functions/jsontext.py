"""Strict JSON on top of Spark's forgiving parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let

_STRICT = {"allowSingleQuotes": "false"}


def parse_one(text: Column, fields: str) -> Column:
    """The struct ``fields`` from a text that is exactly one JSON object, otherwise NULL.

    Wrapped in brackets, anything but a single value fails to parse or has another length, which is
    how trailing junk and concatenated objects are refused.
    """
    array = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{fields}>>", _STRICT)
    # from_json on a plain value inside the brackets yields a NULL struct.
    return F.when(F.size(array) == 1, F.get(array, F.lit(0)))


def value_kind(text: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``NUMBER``, ``INTEGER``, ``BOOLEAN`` or ``NULL`` for a text that is
    exactly one JSON value; otherwise NULL. The first character of a valid value tells its kind."""
    def by_first(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        return (
            F.when(first == "{", "OBJECT").when(first == "[", "ARRAY").when(first == '"', "STRING")
            .when(first.isin("t", "f"), "BOOLEAN").when(t == "null", "NULL")
            .when(F.rlike(t, F.lit("^-?[0-9]+$")), "INTEGER").otherwise("NUMBER"))

    values = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)
    return F.when(F.size(values) == 1, let(F.btrim(text, F.lit(" \t\r\n")), by_first))


def member_kind(text: Column, name: str) -> Column:
    """Kind of one member of a JSON object text."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), f"$.{name}", "variant"))
