"""Date text in and out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats the lenient store date accepts.
LENIENT_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM.dd.yyyy", "MM.dd.yy", "MMMM d, yyyy")


def card_date(text: Column) -> Column:
    """Bring ``MM.DD.YY`` and ``YYYY-MM-DD`` to ``MM.DD.YYYY``; anything else stays."""
    # The two shapes that are brought into the third.
    short = r"^(\d{2})\.(\d{2})\.(\d{2})\n?$"
    iso = r"^(\d{4})-(\d{2})-(\d{2})\n?$"
    return (
        F.when(F.rlike(text, F.lit(short)), F.regexp_replace(text, short, r"$1.$2.20$3"))
        .when(F.rlike(text, F.lit(iso)), F.regexp_replace(text, iso, r"$2.$3.$1"))
        .otherwise(text)
    )


def strict_date(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(text, "yyyy-MM-dd"))


def lenient_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_date(text, fmt) for fmt in LENIENT_FORMATS])
