"""Content identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import collapse, or_empty
from newsloom.profiles import Profile


def normalised_hash(content: Column) -> Column:
    """md5 of the lower-cased text with white space collapsed (profile A)."""
    return F.md5(collapse(F.lower(content)))


def joint_hash(headline: Column, content: Column) -> Column:
    """md5 of headline and text as they stand (profile B)."""
    return F.md5(F.concat(or_empty(headline), F.lit("|"), or_empty(content)))


def content_hash(headline: Column, content: Column, profile: Profile) -> Column:
    if profile.hash_covers_headline:
        return joint_hash(headline, content)
    return normalised_hash(content)
