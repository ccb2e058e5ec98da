"""Blocks of rows within groups, for exact work on pairs of a group that must neither emit the pairs nor gather a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def blocks(df: DataFrame, group: list[str], key: list[str], payload: list[str], size: int = 1024) -> DataFrame:
    """(group, block, one array per payload column): groups cut by the hash of ``key`` into blocks of about ``size`` rows.

    The number of blocks comes from the group's count, so a group of any size is spread; rows with a missing group are left out.
    """
    n = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_s"))
    cut = df.join(n, group).withColumn("block", F.pmod(F.xxhash64(*key), F.col("_s")).cast("int"))
    rows = cut.groupBy(*group, "block").agg(F.collect_list(F.struct(*payload)).alias("_r"))
    return rows.select(*group, "block", *[F.col("_r")[c].alias(c) for c in payload])
