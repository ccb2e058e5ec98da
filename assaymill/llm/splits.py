"""Splits that keep related records together.

Components come from parallel hooking and shortcutting over a parent table. Their assignment to splits is a
subset-sum choice per stratum over *size multiplicities*: the driver sees one row per (stratum, size), whose number is at most
strata x sqrt(2 x records), never the components; a bitset of reachable totals picks how many components of each size
go to each split; the components are then ranked by a seeded hash within (stratum, size) and cut at these numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assaymill.functions.ids import loose_id, strict_id, trimmed
from assaymill.session import discard, settle

BITSET = 1 << 20  #: bits of a subset-sum bitset: larger totals are counted in larger units


def hook_and_shortcut(links: DataFrame) -> DataFrame:
    """(v, root) for links (v, u); every vertex of the links appears, root is the smallest vertex of its component.

    Per round: each root hooks to the smallest root met over a link, then parents are replaced by grandparents
    until all trees are stars; links are carried as pairs of distinct roots, so they only shrink.
    """
    ends = links.select("v").union(links.select("u")).filter("v IS NOT NULL").distinct()
    parent = settle(ends.select("v", F.col("v").alias("p")))
    live = settle(links.filter("v IS NOT NULL AND u IS NOT NULL AND v <> u").select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct())
    while live.limit(1).count():
        hook = settle(live.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")))
        while True:  # shortcut the trees of roots until each is a star
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("g"))
            jumped = settle(hook.join(up, "p", "left").select("v", F.coalesce("g", "p").alias("p"), F.col("g").isNotNull().alias("moved")))
            discard(hook)
            hook, moved = jumped, jumped.filter("moved").limit(1).count()
            if not moved:
                break
        to = lambda c: hook.select(F.col("v").alias(c), F.col("p").alias(f"r{c}"))
        relabelled = live.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        after = settle(relabelled.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("g"))
        later = settle(parent.join(up, "p", "left").select("v", F.coalesce("g", "p").alias("p")))
        for old in (live, parent, hook):
            discard(old)
        live, parent = after, later
    return parent.select("v", F.col("p").alias("root"))


def nearest_bit(reach: int, rest: float) -> int:
    """The set bit of ``reach`` nearest to ``rest``, the lower one on a tie; bit 0 is always set."""
    at = max(0, math.floor(rest))
    below = (reach & ((1 << (at + 1)) - 1)).bit_length() - 1
    above = reach >> (at + 1)
    if not above:
        return below
    up = at + (above & -above).bit_length()
    return up if up - rest < rest - below else below


def subset(items: list[tuple[int, int]], rest: float) -> list[int]:
    """Indices of the items (size, copies) whose total size x copies comes nearest to ``rest``, by a bitset of reachable totals.

    A bit is set once; the first item that reached each total is kept as the bits it added, so a choice is read back from those.
    """
    mask = (1 << (int(2 * rest) + 2)) - 1  # a larger total is farther away than none at all
    reach, added = 1, []
    for s, k in items:
        new = (reach << (s * k)) & mask & ~reach
        added.append(new)
        reach |= new
    best, chosen = nearest_bit(reach, rest), []
    for i in range(len(items) - 1, -1, -1):
        if added[i] >> best & 1:
            chosen.append(i)
            best -= items[i][0] * items[i][1]
    return chosen


def choose_counts(sizes: dict[int, int], target: float) -> dict[int, int]:
    """How many components of each size sum closest to ``target`` (the smaller total on a tie).

    A proportional part of every size, less one component, is taken first; the remainder is settled by a bitset whose bit t says that total t can be reached, one item per power
    of two of each multiplicity. Beyond BITSET the sizes are counted in units: the bitset settles what makes a unit, and the smaller components fill in
    one size after another. Time and memory of the driver are bounded by BITSET x the number of sizes, whatever the number of records.
    """
    total = sum(s * c for s, c in sizes.items())
    if total == 0 or target <= 0:
        return {}
    share = min(1.0, target / total)
    taken = {s: max(0, int(c * share) - 1) for s, c in sizes.items()}
    left = {s: c - taken[s] for s, c in sizes.items() if c > taken[s]}
    rest = target - sum(s * c for s, c in taken.items())
    if left and rest > 0:
        unit = max(1, math.ceil(2 * rest / BITSET))
        for s, k in _settle_rest({s: c for s, c in left.items() if s >= unit}, rest, unit):
            taken[s] += k
            left[s] -= k
            rest -= s * k
        for s in sorted((s for s in left if unit > 1 and s < unit), reverse=True):  # a unit's worth and the rounding of larger sizes
            k = max(0, min(left[s], round(rest / s)))
            taken[s] += k
            rest -= s * k
    return {s: c for s, c in taken.items() if c}


def _settle_rest(left: dict[int, int], rest: float, unit: int) -> list[tuple[int, int]]:
    items: list[tuple[int, int]] = []  # (size, copies)
    for s in sorted(left, reverse=True):
        c, k = min(left[s], int(2 * rest) // s), 1
        while c > 0:
            items.append((s, min(k, c)))
            c -= k
            k *= 2
    chosen = subset([(1, max(1, round(s * k / unit))) for s, k in items] if unit > 1 else items, rest / unit)
    return [items[i] for i in chosen]


def plan_counts(sizes: list[tuple[str, int, int]], targets: list[tuple[str, float]]) -> list[tuple[str, int, str, int, int]]:
    """(stratum, size, split, lo, hi): ranks lo < rank <= hi of a stratum's components of a size go to the split.

    Splits are filled from the smallest target up, the largest takes what is left; what a stratum could not
    reach is carried to the next one, so totals approach the targets as well.
    """
    norm = sum(t for _, t in targets) or 1.0
    order = sorted(((t / norm, s) for s, t in targets), key=lambda x: (x[0], x[1]))
    by: dict[str, dict[int, int]] = {}
    for stratum, size, n in sizes:
        by.setdefault(stratum, {})[int(size)] = int(n)
    carry = {s: 0.0 for _, s in order}
    out = []
    for stratum in sorted(by, key=lambda g: (-sum(s * c for s, c in by[g].items()), g)):
        left = dict(by[stratum])
        total = sum(s * c for s, c in left.items())
        used = {s: 0 for s in left}
        for share, split in order[:-1]:
            want = share * total + carry[split]
            got = choose_counts(left, want)
            for s, c in got.items():
                out.append((stratum, s, split, used[s], used[s] + c))
                used[s] += c
                left[s] -= c
            left = {s: c for s, c in left.items() if c}
            carry[split] = want - sum(s * c for s, c in got.items())
        for s, c in left.items():
            out.append((stratum, s, order[-1][1], used[s], used[s] + c))
    return out


def assign_components(entities: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """(v, root, stratum, split) for entities (v, root, stratum)."""
    spark: SparkSession = entities.sparkSession
    # a component belongs to the stratum most of its records have
    votes = entities.groupBy("root", "stratum").agg(F.count(F.lit(1)).alias("n"))
    comps = votes.groupBy("root").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("k"), "stratum")).alias("m"))
    comps = settle(comps.select("root", "size", F.col("m.stratum").alias("cs"), F.xxhash64(F.lit(seed), "root").alias("h")))
    comps = comps.withColumn("salt", F.shiftright("h", 58))  # ranges of the hash order
    per = comps.groupBy("cs", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(per)
    sizes = [(r["cs"], r["size"], r["n"]) for r in counts.groupBy("cs", "size").agg(F.sum("n").alias("n")).collect()]
    goal = [(r["split"], float(r["target_share"])) for r in targets.select("split", "target_share").filter("split IS NOT NULL AND target_share > 0").distinct().orderBy("split").collect()]
    if not goal:
        raise ValueError("split_targets names no split with a positive share")
    rows = plan_counts(sizes, goal)
    plan = spark.createDataFrame(rows, "cs string, size bigint, split string, lo bigint, hi bigint")
    mark = F.broadcast if len(rows) <= 200_000 else (lambda d: d)
    w = Window.partitionBy("cs", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("cs", "size", "salt").orderBy("h", "root")) + F.col("before")
    ranked = comps.join(offsets, ["cs", "size", "salt"]).withColumn("rank", rank)
    put = ranked.join(mark(plan), ["cs", "size"]).filter("rank > lo AND rank <= hi").select("root", "split")
    return entities.join(put, "root").select("v", "root", "stratum", "split")


def related_splits(cells: DataFrame, drugs: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """(kind, entity_id, component, lineage, split) for every cell and compound.

    No group_id and no chemical_group_id is divided, directly or through an entity recorded in several; an entity
    without a group (null, blank, placeholder) is a component of its own. The stratum of cells is the
    lineage (missing: ``unknown``); compounds are one stratum. Rows whose entity is no id are ignored, repeated
    rows change nothing. A component larger than a split's share stays whole in the largest split.
    """
    c = cells.select(strict_id("cell_id").alias("v"), loose_id("group_id").alias("g"), F.initcap(trimmed("oncotree_lineage")).alias("stratum"))
    d = drugs.select(strict_id("compound_id").alias("v"), loose_id("chemical_group_id").alias("g"), F.lit("-").alias("stratum"))
    known = c.withColumn("kind", F.lit("cell")).unionByName(d.withColumn("kind", F.lit("compound"))).filter("v IS NOT NULL")
    known = known.select(F.concat("kind", F.lit(":"), "v").alias("v"), F.concat("kind", F.lit("#"), "g").alias("u"), "kind", "stratum")
    linked = known.filter("u IS NOT NULL").select("v", "u").distinct()
    roots = hook_and_shortcut(linked)
    entities = known.groupBy("v", "kind").agg(F.min(F.nullif("stratum", F.lit(""))).alias("s"))
    entities = entities.withColumn("stratum", F.concat("kind", F.lit("/"), F.coalesce("s", F.lit("unknown"))))
    entities = settle(entities.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"), "stratum"))
    a = assign_components(entities, targets, seed)
    return a.select(
        F.split_part("v", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("v", F.lit(":"), F.lit(2)).alias("entity_id"), F.col("root").alias("component"),
        F.split_part("stratum", F.lit("/"), F.lit(2)).alias("lineage"), "split",
    )


def split_gaps(assigned: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """(by, split, n, wanted, gap, largest, within): records of a split against its target, per kind or stratum.

    Whole components cannot come nearer than half the largest one; a stratum also evens out what the strata before it missed, so a gap within the
    largest component of the kind is what can be asked of every row.
    """
    total = assigned.groupBy(*by).agg(F.count(F.lit(1)).alias("of"))
    goal = targets.filter("split IS NOT NULL AND target_share > 0").select("split", F.col("target_share").cast("double").alias("t")).distinct()
    goal = goal.crossJoin(F.broadcast(goal.agg(F.sum("t").alias("norm"))))  # one row
    largest = assigned.groupBy("kind", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("kind").agg(F.max("c").alias("largest"))
    have = assigned.groupBy(*by, "split").agg(F.count(F.lit(1)).alias("n"))
    met = total.crossJoin(F.broadcast(goal)).join(have, [*by, "split"], "left").join(F.broadcast(largest), "kind")  # three splits; two kinds
    wanted = F.col("of") * F.col("t") / F.col("norm")
    n = F.coalesce("n", F.lit(0))
    return met.select(*by, "split", n.alias("n"), wanted.alias("wanted"), F.abs(n - wanted).alias("gap"), "largest", (F.abs(n - wanted) <= F.col("largest")).alias("within"))
