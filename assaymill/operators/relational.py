"""Joins, flags, set checks and audits; every function maps DataFrames to a DataFrame, every assertion to its violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the first in the given total order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def last_wins(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """(key, value): a lookup in which the row with the greatest position wins; aggregates on the map side."""
    return df.groupBy(key).agg(F.max_by(value, position).alias(value))


def map_join(left: DataFrame, lookup: DataFrame, key: str, value: str, name: str | None = None, default: object = None) -> DataFrame:
    """Left join with a unique lookup, optionally with a default; Catalyst decides whether to broadcast."""
    met = left.join(lookup.select(key, F.col(value).alias(name or value)), key, "left")
    return met if default is None else met.withColumn(name or value, F.coalesce(name or value, F.lit(default)))


def reject_reason(*checks: tuple[str, Column]) -> Column:
    """The names of the conditions that hold, joined by ``|``; NULL if none does."""
    return F.nullif(F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in checks]), F.lit(""))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys with more than one row, with the number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_from(df: DataFrame, other: DataFrame, *key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``other`` lacks: no row means ``df`` is a subset."""
    return df.select(*key).distinct().join(other.select(*key), list(key), "left_anti")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys on one side only; no row means the sets are equal."""
    return missing_from(a, b, key).withColumn("side", F.lit("left")).unionByName(missing_from(b, a, key).withColumn("side", F.lit("right")))


def contract_join(left: DataFrame, right: DataFrame, key: str, contract: str, how: str = "inner") -> tuple[DataFrame, DataFrame]:
    """(joined, violations): ``one_to_one`` wants unique keys on both sides, ``many_to_one`` on the right."""
    sides = {"one_to_one": ("left", "right"), "many_to_one": ("right",)}[contract]
    bad = [duplicates({"left": left, "right": right}[s], key).withColumn("side", F.lit(s)) for s in sides]
    return left.join(right, key, how), reduce(DataFrame.unionByName, bad)


def prioritised(base: DataFrame, key: str, strategies: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Resolve ``key`` by the first strategy that finds exactly one target.

    A strategy is (name, candidates, key column, target column). One that finds several targets sends the key to review unless an earlier
    one resolved it. Output: key, target, status (``resolved:<name>``, ``review:<name>``, ``unresolved``), evidence, n_candidates.
    """
    out, parts = base, []
    for i, (name, cand, k, target) in enumerate(strategies):
        found = cand.filter(F.col(k).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(k).alias(key)).agg(F.countDistinct(target).alias(f"_n{i}"), F.min(target).alias(f"_t{i}"))
        out = out.join(found, key, "left")
        parts.append((name, F.col(f"_n{i}"), F.col(f"_t{i}")))
    target = F.coalesce(*[F.when(n == 1, t) for _, n, t in parts])
    status = F.lit("unresolved")
    for name, n, _ in reversed(parts):
        status = F.when(n > 1, F.lit(f"review:{name}")).otherwise(status)
    for name, n, _ in reversed(parts):
        status = F.when(n == 1, F.lit(f"resolved:{name}")).otherwise(status)
    evidence = F.concat_ws("; ", *[F.when(n.isNotNull(), F.concat(F.lit(f"{name}="), n.cast("string"))) for name, n, _ in parts])
    return out.select(key, target.alias("target"), status.alias("status"), evidence.alias("evidence"))


def full_outer_counts(a: DataFrame, b: DataFrame, key: str, na: str, nb: str) -> DataFrame:
    """Two count columns side by side, 0 where a side lacks the key."""
    met = a.withColumnRenamed("n", na).join(b.withColumnRenamed("n", nb), key, "full_outer")
    return met.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in (na, nb)])


def table_diff(a: DataFrame, b: DataFrame, row: str, numeric: list[str], text: list[str]) -> DataFrame:
    """(column, n_cells, n_missing_row, n_differ, n_blank_only, max_abs_diff) of two tables aligned by row number."""
    long = lambda d, s: d.select(
        F.col(row).alias("_row"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("num"), F.lit(None).cast("string").alias("txt")) for c in numeric],
                          *[F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("num"), F.col(c).alias("txt")) for c in text])).alias("x"),
    ).select("_row", F.col("x.column").alias("column"), F.col("x.num").alias(f"{s}n"), F.col("x.txt").alias(f"{s}t"), F.lit(True).alias(f"{s}has"))
    met = long(a, "a").join(long(b, "b"), ["_row", "column"], "full_outer")
    both = F.col("ahas").isNotNull() & F.col("bhas").isNotNull()
    num_differs = ~F.col("an").eqNullSafe(F.col("bn"))
    txt_differs = ~F.col("at").eqNullSafe(F.col("bt"))
    blank_only = txt_differs & (F.trim("at") == F.trim("bt"))
    return met.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(~both).alias("n_missing_row"), F.count_if(both & (num_differs | txt_differs)).alias("n_differ"),
        F.count_if(both & blank_only).alias("n_blank_only"), F.max(F.when(both, F.abs(F.col("an") - F.col("bn")))).alias("max_abs_diff"),
    )


def waterfall(df: DataFrame, levels: list[tuple[str, Column]], cell: str, drug: str) -> DataFrame:
    """(step, level, n_rows, n_cells, n_drugs, n_pairs) over successively narrower filters, in one pass over the rows.

    A row's depth is the number of levels it passes; a cell, drug or pair is counted at a level if its deepest row reaches it. So rows are reduced to pairs, pairs to
    the deepest level of each entity, and no distinct count expands the rows per level.
    """
    passed, depth = F.lit(True), F.lit(0)
    for _, c in levels:
        passed = passed & F.coalesce(c, F.lit(False))
        depth = depth + passed.cast("int")
    steps = range(1, len(levels) + 1)
    rows = [F.count_if(F.col("depth") >= i).alias(f"r{i}") for i in steps]
    pair = df.select(F.col(cell).alias("c"), F.col(drug).alias("d"), depth.alias("depth")).groupBy("c", "d").agg(F.max("depth").alias("deep"), *rows)
    unit = lambda kind, key, own: F.struct(F.lit(kind).alias("kind"), key.alias("key"), *[(F.col(f"r{i}") if own else F.lit(0).cast("bigint")).alias(f"r{i}") for i in steps])
    both = F.when(F.col("c").isNotNull() & F.col("d").isNotNull(), F.concat_ws("\x1f", F.col("c").cast("string"), F.col("d").cast("string")))
    units = pair.select("deep", F.explode(F.array(unit("c", F.col("c").cast("string"), False), unit("d", F.col("d").cast("string"), False), unit("p", both, True))).alias("u")).select("deep", "u.*")
    entity = units.groupBy("kind", "key").agg(F.max("deep").alias("deep"), *[F.sum(f"r{i}").alias(f"r{i}") for i in steps])
    at = lambda kind, i: F.count_if((F.col("kind") == kind) & F.col("key").isNotNull() & (F.col("deep") >= i))
    one = entity.agg(*[x for i in steps for x in (F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}"), at("c", i).alias(f"c{i}"), at("d", i).alias(f"d{i}"), at("p", i).alias(f"p{i}"))])
    out = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("level"), *[F.col(f"{k}{i}").cast("bigint").alias(m) for k, m in (("r", "n_rows"), ("c", "n_cells"), ("d", "n_drugs"), ("p", "n_pairs"))]) for i, (n, _) in enumerate(levels, 1)]
    return one.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """(content_hash, n): a hash of the multiset of rows, whatever their order and partitions.

    Each row's SHA-256 is cut into four numbers of 60 bits whose sums over all rows are hashed with the count: partial sums combine on the map side
    and no task gathers rows. Values are taken as text, NULL as a zero character.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.select(row.alias("h")).agg(F.sha2(F.concat_ws("|", *[F.coalesce(part(i), F.lit("0")) for i in range(4)], F.count(F.lit(1)).cast("string")), 256).alias("content_hash"), F.count(F.lit(1)).alias("n"))


def schema_problems(df: DataFrame, required: list[str], forbidden: list[str] = ()) -> list[str]:
    """Missing required and present forbidden columns, without a job."""
    have = set(df.columns)
    return [f"missing:{c}" for c in required if c not in have] + [f"forbidden:{c}" for c in forbidden if c in have]


def examples(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in a total order, as the feature of a report."""
    return df.orderBy(*order).limit(n)


def recomputed(saved: DataFrame, fresh: DataFrame, key: list[str], columns: list[str], rtol: float = 1e-9, atol: float = 1e-9) -> DataFrame:
    """(key, column, saved, fresh) of numbers that differ beyond the tolerance or exist on one side only."""
    long = lambda d, n: d.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*key, "x.column", F.col("x.v").alias(n))
    met = long(saved, "saved").join(long(fresh, "fresh"), [*key, "column"], "full_outer")
    near = F.abs(F.col("saved") - F.col("fresh")) <= atol + rtol * F.abs(F.col("fresh"))
    return met.filter(~F.coalesce(near, F.col("saved").isNull() & F.col("fresh").isNull()))
