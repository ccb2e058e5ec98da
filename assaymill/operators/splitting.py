"""Hold-outs, folds, pair hold-outs, inner splits and their leakage audit.

Every draw is a seeded hash order (``draw_order``) with running sums or numbers over ranges of it (``ranks.preceding``): nothing is collected and no task sees
all groups, units or samples of a stratum. The draws are those of MD5, so that any engine can repeat them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assaymill.operators.ranks import preceding
from assaymill.session import settle


def draw_order(seed: int, *cols: Column | str) -> Column:
    """Seeded order of keys, the same in any engine: the MD5 of the seed and the key's parts joined by ``|``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]).cast("binary"))


def group_table(df: DataFrame, group: str, stratum: str, member: str) -> DataFrame:
    """(g, stratum, size, n_strata): a group's stratum is that of its smallest member; the size counts members."""
    return df.groupBy(F.col(group).alias("g")).agg(
        F.min_by(stratum, member).alias("stratum"), F.countDistinct(member).alias("size"), F.countDistinct(stratum).alias("n_strata")
    )


def hold_out(df: DataFrame, group: str, stratum: str, member: str, ratio: float = 0.15, seed: int = 20260923) -> DataFrame:
    """(member, group, region): region ``hold`` or ``dev`` per member; whole groups only.

    The groups of a stratum stand in seeded order on a line, each as long as it has members. A group is held while the middle of its stretch lies below the
    target, so what is held misses the target by no more than half a group. Groups over several strata form the stratum MIXED, whose target is
    rounded and at least 1; the members they hold count for the targets of their own strata too. The line is summed in ranges: no task sees a stratum.
    A missing group or stratum is a value of its own.
    """
    t = group_table(df, group, stratum, member)
    t = t.withColumn("_s", F.when(F.col("n_strata") > 1, "MIXED").otherwise(F.coalesce("stratum", F.lit("")))).withColumn("_h", draw_order(seed, F.coalesce("g", F.lit(""))))
    own = df.groupBy(member).agg(F.coalesce(F.max(stratum), F.lit("")).alias("_s")).groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    mixed = t.groupBy("_s").agg(F.sum("size").alias("_m"))
    target = F.when(F.col("_s") == "MIXED", F.greatest(F.lit(1.0), F.bround(F.col("_m") * ratio))).otherwise(F.col("_n") * ratio)
    goals = mixed.join(own, "_s", "left").select("_s", target.alias("_target"))
    placed = preceding(t, ["_s"], ["_h"], "size", "_before").join(goals, "_s")
    held = placed.filter(F.col("_before") + F.col("size") / 2 < F.col("_target")).select(F.col("g").alias("_g"), F.lit(1).alias("_held"))
    members = df.select(member, group).distinct()
    return members.join(held, members[group].eqNullSafe(held["_g"]), "left").select(member, group, F.when(F.col("_held") == 1, "hold").otherwise("dev").alias("region"))


def dealt_folds(groups: DataFrame, n: int, seed: int) -> DataFrame:
    """(g, s, c, test_fold) for groups (g, s, c): within each stratum the groups in seeded order are dealt round robin; a stratum starts where the ones before
    it (by name) left off, so that the folds' numbers of groups differ by one at most, within a stratum and over all."""
    groups = settle(groups)
    ranked = preceding(groups.withColumn("_h", draw_order(seed, "g")), ["s"], ["_h"], None, "_r")
    starts = groups.groupBy("s").agg(F.count(F.lit(1)).alias("_n"))
    starts = preceding(starts, [], ["s"], "_n", "_first").select(F.col("s").alias("_s"), "_first")
    met = ranked.join(starts, ranked["s"].eqNullSafe(starts["_s"]))
    return met.select("g", "s", "c", F.pmod(F.col("_r") + F.col("_first"), F.lit(n)).cast("int").alias("test_fold"))


def group_folds(df: DataFrame, group: str, stratum: str, sample: str = "sample_id", n: int = 5, seed: int = 42) -> DataFrame:
    """(sample, group, fold, role) in long form: every sample once per fold, ``test`` where its group lies in the fold; samples without a group are left out."""
    t = df.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.coalesce(F.min_by(stratum, sample), F.lit("")).alias("s"), F.count(F.lit(1)).alias("c"))
    plan = dealt_folds(t, n, seed).select(F.col("g").alias(group), "test_fold")
    return (
        df.select(sample, group).join(plan, group).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .select(sample, group, "fold", F.when(F.col("fold") == F.col("test_fold"), "test").otherwise("train").alias("role"))
    )


def first_keys(keys: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The ``k`` first of unique keys, without gathering them: whole ranges of the order, and of the range that holds the cut the rest by number."""
    o = [f"_o{i}" for i in range(len(order))]
    ranked = preceding(keys.withColumns(dict(zip(o, order))), [], o, None, "_b")
    return ranked.filter(F.col("_b") < k).select(*keys.columns)


def pair_hold_out(df: DataFrame, pair: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with role: the ``floor(share n)`` distinct pairs that come first in seeded order are test."""
    pairs = df.select(*pair).distinct()
    first = first_keys(pairs, [draw_order(seed, *pair), *map(F.col, pair)], int(share * pairs.count()))
    return df.join(first.withColumn("_t", F.lit(1)), pair, "left").withColumn("role", F.when(F.col("_t") == 1, "test").otherwise("train")).drop("_t")


def inner_split(df: DataFrame, unit: list[str], share: float = 0.2, seed: int = 20260934) -> DataFrame:
    """df with side ``validation`` for ``max(1, round(share n))`` units by seeded order, else ``train``; labels play no part."""
    units = df.select(*unit).distinct()
    chosen = first_keys(units, [draw_order(seed, *unit), *map(F.col, unit)], max(1, round(share * units.count()))).withColumn("_v", F.lit(1))
    return df.join(chosen, unit, "left").withColumn("side", F.when(F.col("_v") == 1, "validation").otherwise("train")).drop("_v")


def permute_labels(df: DataFrame, group: str, sample: str, y: str, seed: int = 42) -> DataFrame:
    """df with y permuted within each group: the label of seeded rank i goes to the i-th sample; group means stay. Samples are unique."""
    a = preceding(df, [group], [sample], None, "_r")
    b = preceding(df.select(F.col(group).alias("_g"), F.col(y).alias("_y"), draw_order(seed, sample).alias("_h"), F.col(sample).alias("_s")), ["_g"], ["_h", "_s"], None, "_q")
    return a.join(b, a[group].eqNullSafe(b["_g"]) & (a["_r"] == b["_q"])).drop("_r", "_q", "_g", "_h", "_s", y).withColumnRenamed("_y", y)


def first_entities(df: DataFrame, entity: str, share: float) -> DataFrame:
    """Rows of the first ``max(2, round(share n))`` entities in lexicographic order (round half to even)."""
    units = df.select(entity).distinct()
    return df.join(first_keys(units, [F.col(entity)], max(2, round(share * units.count()))), entity, "left_semi")


def quadrant(cell_region: str = "cell_region", drug_region: str = "drug_region") -> Column:
    """dev / lco / ldo_so / db from the two regions."""
    c, d = F.col(cell_region) == "hold", F.col(drug_region) == "hold"
    return F.when(c & d, "db").when(c, "lco").when(d, "ldo_so").otherwise("dev")


def divided(df: DataFrame, key: str, role: str = "role", by: list[str] | None = None) -> DataFrame:
    """Keys that lie in more than one role (per fold): no row means isolation."""
    by = by or []
    return df.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.countDistinct(role).alias("n_roles")).filter("n_roles > 1")


def leakage_audit(folds: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(check, n_violations) per key; zero means pass."""
    parts = [divided(folds, k, "role", by).agg(F.lit(f"{k}_isolated").alias("check"), F.count(F.lit(1)).alias("n_violations")) for k in keys]
    return reduce(DataFrame.unionByName, parts)


def thin_drugs(folds: DataFrame, min_cells: int, by: list[str]) -> DataFrame:
    """(fold, min_test_cells, n_thin): fewest test cells of any compound and compounds below the limit, per fold."""
    t = folds.filter("role = 'test'").groupBy(*by, "compound_id").agg(F.countDistinct("cell_id").alias("n"))
    return t.groupBy(*by).agg(F.min("n").alias("min_test_cells"), F.count_if(F.col("n") < min_cells).alias("n_thin"))
