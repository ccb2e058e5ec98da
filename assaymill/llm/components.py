"""Consolidating pairwise matches into groups by randomised contraction.

Each round every vertex hooks to the member of its closed neighbourhood with the smallest fresh hash; edges are
relabelled and deduplicated, loops dropped. A constant share of the vertices disappears per round in expectation,
so a logarithmic number of rounds suffices whatever the diameter. The round's mapping is kept as a table of the shared
folder, and the mappings are expanded backwards at the end. Nothing is collected to the driver but a row count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assaymill.functions.ids import strict_id
from assaymill.session import discard, settle


def star_links(members: DataFrame) -> DataFrame:
    """(a, b) from (v, key): every member of a key is linked to the key's smallest member, so a key of m members costs m links.

    The smallest member is a partial aggregate and the join back splits hot keys adaptively; no group is collected.
    """
    least = members.groupBy("key").agg(F.min("v").alias("a"))
    return members.join(least, "key").filter("v <> a").select("a", F.col("v").alias("b")).distinct()


def contract(edges: DataFrame, seed: int = 17) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b); vertices linked directly or indirectly share a root."""
    live = settle(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    kind = live.schema["a"].dataType
    while live.limit(1).count():
        h = lambda c: F.struct(F.xxhash64(F.lit(seed + len(steps)), c).alias("h"), F.col(c).alias("u"))
        both = live.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(live.select(F.col("b").alias("v"), F.col("a").alias("u")))
        hooks = both.groupBy("v").agg(F.min(h("u")).alias("m")).select("v", F.least("m", h("v"))["u"].alias("r"))
        hooks = settle(hooks)
        to = lambda c: hooks.select(F.col("v").alias(c), F.col("r").alias(f"r{c}"))
        moved = live.join(to("a"), "a").join(to("b"), "b").filter("ra <> rb")
        after = settle(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        discard(live)
        live = after
        steps.append(hooks)
    if not steps:
        return edges.sparkSession.createDataFrame([], "v string, root string").select(F.col("v").cast(kind), F.col("root").cast(kind))
    out = steps[-1].select("v", F.col("r").alias("root"))
    for hooks in reversed(steps[:-1]):
        up = out.select(F.col("v").alias("r"), "root")
        out = hooks.join(up, "r", "left").select("v", F.coalesce("root", "r").alias("root"))
    return out


def chemical_groups(drugs: DataFrame, samples: DataFrame, prefix: str = "CHEM_") -> DataFrame:
    """(compound_id, chemical_group_id, n_members) for every compound of ``drugs``.

    Compounds are linked by a shared normalized_parent_id (all rows of ``drugs``) or scaffold_id (all rows of
    ``samples`` of these compounds). Values that are no ids link nothing and are no members; repeated rows
    change nothing; a compound linked to no other is a group of its own; empty tables give an empty result.
    """
    parents = drugs.select(strict_id("compound_id").alias("v"), strict_id("normalized_parent_id").alias("p"))
    members = settle(parents.select("v").filter("v IS NOT NULL").distinct())
    by_parent = parents.filter("v IS NOT NULL AND p IS NOT NULL").select("v", F.concat(F.lit("P:"), "p").alias("key"))
    by_scaffold = (
        samples.select("compound_id", "scaffold_id").distinct()
        .select(strict_id("compound_id").alias("v"), strict_id("scaffold_id").alias("s"))
        .filter("v IS NOT NULL AND s IS NOT NULL").distinct()
        .join(members, "v", "left_semi").select("v", F.concat(F.lit("S:"), "s").alias("key"))
    )
    keyed = settle(by_parent.unionByName(by_scaffold).distinct())
    roots = settle(contract(star_links(keyed)))
    named = roots.groupBy("root").agg(F.min("v").alias("first"), F.count(F.lit(1)).alias("n"))
    met = members.join(roots.join(named, "root"), "v", "left")
    return met.select(
        F.col("v").alias("compound_id"), F.concat(F.lit(prefix), F.coalesce("first", "v")).alias("chemical_group_id"), F.coalesce("n", F.lit(1)).alias("n_members")
    )
