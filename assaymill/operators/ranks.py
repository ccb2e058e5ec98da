"""Ranks, surrogate keys, running corrections, quantile bins and guarded correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assaymill.session import settle

HOT_ROWS = 1_000_000  #: rows of a group beyond which it is spread over tasks


def surrogate_key(df: DataFrame, order: Column | str, prefix: str, width: int, name: str) -> DataFrame:
    """Keys such as ``CL0001`` by rank of the distinct order values; the ranked values are small entity sets."""
    distinct = df.select(F.col(order).alias("_k") if isinstance(order, str) else order.alias("_k")).filter("_k IS NOT NULL").distinct()
    ranked = dense_order(distinct, "_k", "_n")
    return ranked.select("_k", F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"), width, "0")).alias(name))


def preceding(df: DataFrame, by: list[str], order: list[str], value: str | None, name: str) -> DataFrame:
    """df with ``name``: the sum of ``value`` (None: the number of rows) over the rows before it in its group, rows being unique in ``order``.

    No task sees a group: rows are cut into ranges of (group, order), the cut is written with the range's number as a column, so that both its later
    uses read the same ranges, and every range gets the total of the ranges before it. Groups may be NULL.
    """
    add = F.sum(value) if value else F.count(F.lit(1))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = settle(df.repartitionByRange(n, *by, *order).withColumn("_pre_p", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_pre_p").rowsBetween(Window.unboundedPreceding, -1)  # at most one row per range and group
    starts = cut.groupBy("_pre_p", *by).agg(add.alias("_pre_s")).select("_pre_p", *by, F.coalesce(F.sum("_pre_s").over(before), F.lit(0)).alias("_pre_off"))
    starts = starts.select(F.col("_pre_p").alias("_pre_q"), *[F.col(c).alias(f"_pre_g{i}") for i, c in enumerate(by)], "_pre_off")
    same = F.col("_pre_p") == F.col("_pre_q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_pre_g{i}"))
    inner = Window.partitionBy("_pre_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_pre_off") + F.coalesce(add.over(inner), F.lit(0))
    return cut.join(starts, same).withColumn(name, total).drop("_pre_p", "_pre_q", "_pre_off", *[f"_pre_g{i}" for i in range(len(by))])


def dense_order(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with row numbers 1..n in the order of its unique keys."""
    return preceding(df, [], [key], None, "_b").withColumn(name, F.col("_b") + 1).drop("_b")


def hot_groups(df: DataFrame, by: list[str], rows: int) -> bool:
    """Whether any group has more rows than one task should sort."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows).limit(1).count() > 0


def average_rank(part: list[str], value: str) -> Column:
    """Ranks with ties averaged, as a window over each group."""
    w, tie = Window.partitionBy(*part).orderBy(value), Window.partitionBy(*part, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(tie) - 1) / 2.0


def group_ranks(df: DataFrame, by: list[str], values: dict[str, str], hot_rows: int = HOT_ROWS, hot: bool | None = None) -> DataFrame:
    """df with a rank column per entry of ``values`` (name: column), ties averaged, among the rows of its group that have a value.

    While every group fits a task (its size is counted), windows; otherwise counts per (group, value) summed over value ranges, in which a
    group of any size is spread. Both give the same ranks; a missing value has no rank. A caller that knows passes ``hot``.
    """
    if hot is None:
        df = df if hasattr(df, "_settled_at") else settle(df)  # it is read for the count and again for the ranks
        hot = hot_groups(df, by, hot_rows)
    out = df
    if not hot:
        return out.withColumns({n: F.when(F.col(v).isNotNull(), average_rank([*by, F.col(v).isNull()], v)) for n, v in values.items()})
    for n, v in values.items():
        counts = df.filter(F.col(v).isNotNull()).groupBy(*by, v).agg(F.count(F.lit(1)).alias("_n"))
        ranked = preceding(counts, by, [v], "_n", "_b")
        ranked = ranked.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(v).alias("_v"), (F.col("_b") + (F.col("_n") + 1) / 2.0).alias(n))
        same = F.col(v) == F.col("_v")
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(ranked, same, "left").drop("_v", *[f"_k{i}" for i in range(len(by))])
    return out


def global_average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks over all rows with ties averaged, from counts per distinct value in value ranges: no task sees all rows."""
    return group_ranks(df, [], {name: value}, hot=True)


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation, NULL for fewer than two rows or a constant side (never a division by zero)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, by: list[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """Rank correlation with average ranks per group."""
    ranked = group_ranks(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y), by, {"_rx": x, "_ry": y})
    return ranked.groupBy(*by).agg(guarded_corr("_rx", "_ry").alias(name))


def holm(df: DataFrame, family: list[str], p: str, tie: str, name: str = "p_adjusted") -> DataFrame:
    """Step-down correction within each family: running maximum of min(1, (m - rank + 1) p)."""
    w = Window.partitionBy(*family).orderBy(p, tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn(name, F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def top_k(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows per group; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def quantile_bins(df: DataFrame, value: str, q: int = 4, name: str = "bin") -> DataFrame:
    """Right-closed bins at exact linear quantiles, equal edges merged; the lowest bin holds the minimum."""
    edges = df.agg(F.percentile(value, F.array(*[F.lit(i / q) for i in range(q + 1)])).alias("_e"))
    cut = F.array_distinct("_e")
    inner = F.slice(cut, 2, F.greatest(F.size(cut) - 2, F.lit(0)))
    met = df.crossJoin(F.broadcast(edges))  # one row
    return met.withColumn(name, F.size(F.filter(inner, lambda e: e < F.col(value))) + 1).drop("_e")
