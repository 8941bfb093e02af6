"""Numbered folders on whatever file system the path names."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def child_names(spark: SparkSession, root: str) -> list[str]:
    """Names below ``root``, none if it does not exist. Goes through Hadoop, so any store works."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(path))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all that is in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbers(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """The numbers of children called ``<prefix><number>``."""
    found = (re.fullmatch(re.escape(prefix) + r"(\d+)", name) for name in child_names(spark, root))
    return sorted(int(match.group(1)) for match in found if match)


def next_number(spark: SparkSession, root: str, prefix: str) -> int:
    return max(numbers(spark, root, prefix), default=0) + 1
