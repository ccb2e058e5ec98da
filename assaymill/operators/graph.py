"""Bipartite k-core, degree-preserving rewiring and its overlap with the original."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from assaymill.session import discard, settle


def k_core(edges: DataFrame, a: str, b: str, min_b_per_a: int, min_a_per_b: int, max_rounds: int = 10) -> tuple[DataFrame, bool, list[int]]:
    """(edges, converged, sizes): repeatedly drop the nodes of both sides below their degree, judged on the same snapshot.

    ``edges`` are distinct pairs. Stops when nothing changes or after ``max_rounds`` (then converged is False unless the last round was stable).
    Each round is written to the shared folder, so the lineage stays flat and a lost executor repeats one round only.
    """
    live = settle(edges.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    sizes = [live.count()]
    for _ in range(max_rounds):
        keep_a = live.groupBy(a).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_b_per_a).select(a)
        keep_b = live.groupBy(b).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_a_per_b).select(b)
        after = settle(live.join(keep_a, a, "left_semi").join(keep_b, b, "left_semi").select(a, b))
        n = after.count()
        discard(live)
        live = after
        if n == sizes[-1]:
            return live, True, sizes
        sizes.append(n)
    return live, False, sizes


def rigid(members: list[tuple[str, str]]) -> bool:
    """Whether no two edges can be swapped: the sets' members are nested, so no other graph has these set sizes and member counts (a complete graph is one)."""
    sets: dict[str, set[str]] = {}
    for s, x in members:
        sets.setdefault(s, set()).add(x)
    by_size = sorted(sets.values(), key=len)
    return all(a <= b for a, b in zip(by_size, by_size[1:]))


def rewire(members: list[tuple[str, str]], seed: int, swaps_per_edge: int = 20, tries_per_swap: int = 10) -> list[tuple[str, str]]:
    """Double edge swaps of a set-member graph: every set keeps its size, every member its number of sets.

    Each step draws two edges and exchanges their members where that makes two new edges. Where more than half of all cells are edges, the absent cells are
    drawn instead: a swap of two of them is a swap of the two edges across, and in a nearly complete graph hardly any draw of edges would hit one. The chain is
    sequential by definition, for set collections of some thousands of edges; the caller distributes the result. A graph that allows no swap raises.
    """
    given = set(members)
    sets, names = {s for s, _ in given}, {x for _, x in given}
    dense = 2 * len(given) > len(sets) * len(names)
    edges = sorted({(s, x) for s in sets for x in names} - given) if dense else sorted(given)
    have = set(edges)
    rng = np.random.default_rng(seed)
    want, done = swaps_per_edge * len(given), 0
    for _ in range(tries_per_swap * want):
        if done >= want or len(edges) < 2:
            break
        i, j = rng.integers(0, len(edges), 2)
        (s, x), (t, y) = edges[i], edges[j]
        if s == t or x == y or (s, y) in have or (t, x) in have:
            continue
        have -= {(s, x), (t, y)}
        have |= {(s, y), (t, x)}
        edges[i], edges[j] = (s, y), (t, x)
        done += 1
    if not done:
        raise ValueError("no two edges of this graph can be swapped")
    return sorted({(s, x) for s in sets for x in names} - have if dense else have)


def overlap_share(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of the rows of ``a`` that ``b`` has as well."""
    hit = a.distinct().join(b.distinct().withColumn("_h", F.lit(1)), a.columns, "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.count("_h").alias("n_kept"), (F.count("_h") / F.count(F.lit(1))).alias("share"))


def components(links: DataFrame, node: str, keys: list[str], prefix: str = "") -> DataFrame:
    """(node, component, size): nodes that share a value of any key column, directly or through others; named by the smallest member.

    Labels start as the node and become the smallest label met over each key, then the label of the label (a pointer jump), until nothing changes. Only
    partial aggregates meet at a key, so a key shared by many nodes is no hot spot. Nodes without keys stay alone.
    """
    pairs = None
    for i, k in enumerate(keys):
        part = links.select(node, F.concat(F.lit(f"{i}:"), F.col(k).cast("string")).alias("_k")).filter(F.col(node).isNotNull() & F.col("_k").isNotNull())
        pairs = part if pairs is None else pairs.unionByName(part)
    pairs = settle(pairs.distinct())
    label = settle(links.select(node).filter(F.col(node).isNotNull()).distinct().withColumn("_l", F.col(node)))
    while True:
        met = pairs.join(label, node)
        least = met.groupBy("_k").agg(F.min("_l").alias("_m"))
        best = pairs.join(least, "_k").groupBy(node).agg(F.min("_m").alias("_m"))
        near = label.join(best, node, "left").select(node, F.col("_l").alias("_old"), F.least("_l", F.coalesce("_m", "_l")).alias("_l"))
        up = near.select(F.col(node).alias("_l"), F.col("_l").alias("_g"))
        after = settle(near.join(up, "_l", "left").select(node, "_old", F.least("_l", F.coalesce("_g", "_l")).alias("_l")))
        discard(label)
        label = after.select(node, "_l")
        label._settled_at = after._settled_at
        if not after.filter("_l <> _old").limit(1).count():
            break
    size = label.groupBy("_l").agg(F.count(F.lit(1)).alias("size"))
    return label.join(size, "_l").select(node, F.concat(F.lit(prefix), F.col("_l").cast("string")).alias("component"), "size")
