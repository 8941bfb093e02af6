"""First n rows per group, safe for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bound: int, salt_by: Sequence[str],
    rank: str = "rank", salts: int = 64,
) -> DataFrame:
    """Keep the first ``bound`` rows of every group and add their position as ``rank``.

    A row among the first ``bound`` of its group is also among the first ``bound`` of any part of the
    group. So each group is first cut inside ``salts`` parts, which spreads a giant group over that
    many tasks, and only the survivors meet. The literal bound lets Spark cut rows before the shuffle
    as well (WindowGroupLimit).
    """
    part = F.pmod(F.xxhash64(*salt_by), F.lit(salts))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    cut = (
        df.withColumn("_part", part)
        .withColumn(rank, F.row_number().over(within))
        .filter(F.col(rank) <= F.lit(bound))
        .drop("_part", rank)
    )
    return cut.withColumn(rank, F.row_number().over(overall)).filter(F.col(rank) <= F.lit(bound))
