"""References to records that do not exist (yet, or any more).

Plan, made for one key holding a third of all references:

1. references are pre-aggregated per (field, id, period) on the map side to a count and the first and last moment
   of reference; whatever the skew, a key has at most one row per period afterwards;
2. each key-period is judged against the merged validity spans of its id: ``whole`` (all moments inside one span),
   ``orphan`` (none inside any) or ``mixed``; only the last two are kept, usually a few per cent;
3. where single rows are wanted, rows of heavy keys (at least ``heavy_share`` of all references, hence at most
   ``1 / heavy_share`` keys) are checked against a broadcast of those keys' judgements, whose rows are counted first. Rows of the other
   keys meet the settled key-periods in a shuffle anti-join, which leaves whole key-periods out, and for the mixed ones the valid spans decide. Both parts are united.

Defined cases: NULL, blank and placeholder values are no references; a reference without a moment dangles and is counted under period NULL; a row without
an id of its own is reported under NULL; repeated rows are repeated references; a registration without a start, or that ends before it starts, validates
nothing; an empty master leaves every reference dangling, empty facts leave none. Only named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from assaymill.functions.ids import strict_id
from assaymill.session import settle

FOREVER = "9999-12-31 00:00:00"


def validity(master: DataFrame, field: str, id_col: str, start: str = "registered_at", end: str = "retired_at") -> DataFrame:
    """Disjoint spans (field, id, s, e) in which an id is registered: s <= t < e.

    A row without a start or whose span is empty validates nothing; an open end means still valid; overlapping or
    touching spans of an id are merged.
    """
    spans = (
        master.select(strict_id(id_col).alias("id"), F.col(start).alias("s"), F.coalesce(end, F.lit(FOREVER).cast("timestamp_ntz")).alias("e"))
        .filter(F.col("id").isNotNull() & (F.col("s") < F.col("e")))
        .distinct()
    )
    w = Window.partitionBy("id").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1))
        .withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .select(F.lit(field).alias("field"), "id", "s", "e")
    )


def references(rows: DataFrame, fields: list[str], at: str, keep: str | None = None) -> DataFrame:
    """One row per reference (field, id, at, period [, keep]); values that are no ids are no references."""
    per = F.array(*[F.struct(F.lit(f).alias("field"), strict_id(f).alias("id")) for f in fields])
    kept = [F.col(keep).alias("row_id")] if keep else []
    return (
        rows.select(F.col(at).alias("at"), *kept, F.explode(F.filter(per, lambda x: x["id"].isNotNull())).alias("r"))
        .select("r.field", "r.id", "at", F.trunc("at", "month").alias("period"), *(["row_id"] if keep else []))
    )


@dataclass
class Judged:
    refs: DataFrame  #: (field, id, at, period, row_id)
    judged: DataFrame  #: (field, id, period, n, status, spans), settled
    heavy: DataFrame  #: (field, id), at most 1 / heavy_share


KEYS = ["field", "id", "p"]
NEVER = "0001-01-01"  #: stands for a missing period in joins


def judge(refs: DataFrame, spans: DataFrame, heavy_share: float = 0.001) -> Judged:
    """Judge every key-period (steps 1 and 2). ``refs`` may be empty or have no match at all."""
    agg = refs.groupBy("field", "id", "period").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    listed = spans.groupBy("field", "id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    met = agg.join(listed, ["field", "id"], "left")
    whole = F.exists("spans", lambda x: (x["s"] <= F.col("lo")) & (F.col("hi") < x["e"]))
    touched = F.exists("spans", lambda x: (x["s"] <= F.col("hi")) & (F.col("lo") < x["e"]))
    status = F.when(whole, "whole").when(touched, "mixed").otherwise("orphan")
    judged = settle(met.select("field", "id", "period", F.coalesce("period", F.lit(NEVER).cast("date")).alias("p"), "n", status.alias("status"), F.when(status == "mixed", F.col("spans")).alias("spans")))
    totals = judged.groupBy("field", "id").agg(F.sum("n").alias("n"))
    least = F.broadcast(judged.agg((F.sum("n") * heavy_share).alias("least")))  # one row
    heavy = totals.join(least, F.col("n") >= F.greatest("least", F.lit(1))).select("field", "id")
    return Judged(refs, judged, settle(heavy))


def dangling_rows(j: Judged, only_mixed: bool = False, broadcast_rows: int = 200_000) -> DataFrame:
    """Every dangling reference (field, id, period, row_id), redelivered rows included (step 3). ``only_mixed``: those of mixed key-periods alone."""
    heavy = F.broadcast(j.heavy.withColumn("is_heavy", F.lit(True)))  # at most 1 / heavy_share rows
    rows = j.refs.withColumn("p", F.coalesce("period", F.lit(NEVER).cast("date"))).join(heavy, ["field", "id"], "left")
    hot, cold = rows.filter("is_heavy"), rows.filter("is_heavy IS NULL")
    marked = j.judged.join(heavy, ["field", "id"], "left")
    wanted = "status = 'mixed'" if only_mixed else "status <> 'whole'"
    bad = marked.filter(wanted).select(*KEYS, "status", "spans", "is_heavy")
    hot_bad, cold_mixed = (bad.filter(c).drop("is_heavy") for c in ("is_heavy", "is_heavy IS NULL AND status = 'mixed'"))
    small = hot_bad.count() <= broadcast_rows  # a heavy key has a row per period; beyond the bound the skew join splits the heavy keys
    outside = (F.col("status") == "orphan") | ~F.exists("spans", lambda x: (x["s"] <= F.col("at")) & (F.col("at") < x["e"]))
    out = lambda d: d.select("field", "id", "period", "row_id")
    hot_part = out(hot.join(F.broadcast(hot_bad) if small else hot_bad, KEYS).filter(outside))
    if only_mixed:
        return hot_part.unionByName(out(cold.join(cold_mixed, KEYS).filter(outside)))
    # anti-join: a light reference dangles unless its key-period is whole, or is mixed and has a span that holds its moment
    valid = marked.filter("is_heavy IS NULL AND status <> 'orphan'").select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("spans").alias("_spans"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in KEYS])
    holds = F.col("_spans").isNull() | F.exists("_spans", lambda x: (x["s"] <= F.col("at")) & (F.col("at") < x["e"]))
    return hot_part.unionByName(out(cold.join(valid, same & holds, "left_anti")))


def dangling_counts(j: Judged, broadcast_rows: int = 200_000) -> DataFrame:
    """(field, period, n_dangling, n_ids): counts of whole orphan key-periods come from the pre-aggregate alone, only
    rows of mixed key-periods are read again."""
    per_key = j.judged.filter("status = 'orphan'").select("field", "id", "period", "n").unionByName(
        dangling_rows(j, True, broadcast_rows).groupBy("field", "id", "period").agg(F.count(F.lit(1)).alias("n"))
    )
    return per_key.groupBy("field", "period").agg(F.sum("n").alias("n_dangling"), F.count(F.lit(1)).alias("n_ids"))
