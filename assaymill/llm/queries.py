"""Queries and SQL twins of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaymill.functions.ids import loose_id, sql_loose_id, sql_strict_id, strict_id
from assaymill.llm import components, leakage, matching, mixing, neighbours, overlap, splits, subjects
from assaymill.session import settle, table

ATTRIBUTES = {"cell": "cell_id", "compound": "compound_id", "parent": "normalized_parent_id"}
VIEWS = [("cell", "compound"), ("cell", "parent")]


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, sf_dir, "core_samples"), table(spark, sf_dir, "lpo_folds"), "sample_id", ATTRIBUTES, VIEWS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _overlaps(spark, sf_dir)
    return p.select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b")).distinct()


def p4_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folds = table(spark, sf_dir, "core_samples"), table(spark, sf_dir, "lpo_folds")
    r = overlap.overlap_report(settle(_overlaps(spark, sf_dir)), rows, folds, "sample_id", "release_id")
    return r.withColumnRenamed("source", "release_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.related_splits(table(spark, sf_dir, "cell_group_assignment"), table(spark, sf_dir, "drug_group_assignment"), table(spark, sf_dir, "split_targets"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached per kind, lineage and split, beside the targets."""
    s = settle(p5_splits(spark, sf_dir))
    per = s.groupBy("kind", "lineage", "split").agg(F.count(F.lit(1)).alias("n"))
    total = s.groupBy("kind", "lineage").agg(F.count(F.lit(1)).alias("of"))
    t = table(spark, sf_dir, "split_targets").select("split", "target_share").distinct()
    return per.join(total, ["kind", "lineage"]).join(F.broadcast(t), "split", "left").withColumn("share", F.col("n") / F.col("of"))


def p5_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each split against its target, per kind and per kind and lineage, within the largest component of the kind."""
    s, t = settle(p5_splits(spark, sf_dir)), table(spark, sf_dir, "split_targets")
    return splits.split_gaps(s.withColumn("lineage", F.lit("(all)")), t, ["kind", "lineage"]).unionByName(splits.split_gaps(s, t, ["kind", "lineage"]))


def p5_divided_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded groups whose members lie in several splits, per kind: none; and where the smallest entity of a kind is moved to a split of its own: its groups of more than one."""
    s = settle(p5_splits(spark, sf_dir)).select("kind", "entity_id", "split")
    c = table(spark, sf_dir, "cell_group_assignment").select(F.lit("cell").alias("kind"), strict_id("cell_id").alias("entity_id"), loose_id("group_id").alias("g"))
    d = table(spark, sf_dir, "drug_group_assignment").select(F.lit("compound").alias("kind"), strict_id("compound_id").alias("entity_id"), loose_id("chemical_group_id").alias("g"))
    first = F.broadcast(s.groupBy("kind").agg(F.min("entity_id").alias("least")))  # two rows
    s = s.join(first, "kind").withColumn("moved", F.when(F.col("entity_id") == F.col("least"), F.lit("elsewhere")).otherwise(F.col("split")))
    met = c.unionByName(d).filter("g IS NOT NULL").join(s, ["kind", "entity_id"]).groupBy("kind", "g").agg(F.countDistinct("split").alias("n"), F.countDistinct("moved").alias("m"))
    return met.groupBy("kind").agg(F.count_if(F.col("n") > 1).alias("n_divided"), F.count_if(F.col("m") > 1).alias("n_planted"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.chemical_groups(table(spark, sf_dir, "drug_group_assignment"), table(spark, sf_dir, "core_samples"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).filter("n_members > 1").select("compound_id", "chemical_group_id")


def p6_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(table(spark, sf_dir, "cell_master"), table(spark, sf_dir, "passport_models"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("sanger_model_id", "model_id")


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in neighbours.KINDS:
        near = neighbours.neighbour_lists(table(spark, sf_dir, "prepared_data"), kind)
        part = near.select(F.lit(kind).alias("feature"), F.least("vec_id", "other").alias("vec_id_a"), F.greatest("vec_id", "other").alias("vec_id_b")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the lists of ids divisible by 50 against brute force over all rows."""
    out = None
    for kind in neighbours.KINDS:
        rows = table(spark, sf_dir, "prepared_data")
        truth = neighbours.exact_lists(rows, kind)
        got = neighbours.neighbour_lists(rows, kind).filter(F.col("vec_id") % 50 == 0).select("vec_id", "other", F.lit(1).alias("hit"))
        part = truth.join(got, ["vec_id", "other"], "left").agg(F.lit(kind).alias("feature"), F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("recall", F.try_divide("n_found", "n_true"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.reparameterised(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the number of documents it leaked into and the largest share of it found in one."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "item_set").distinct()
    hits = _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("covered").alias("most_covered"))
    return items.join(hits, "item_id", "left").na.fill({"n_docs": 0, "most_covered": 0.0})


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(settle(p8_mix(spark, sf_dir)), table(spark, sf_dir, "source_weights"))


def p8_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached among the sources used, against their targets and the bound that whole documents allow."""
    return mixing.gaps(settle(p8_mix(spark, sf_dir)), table(spark, sf_dir, "source_weights"))


LENGTH_BLOCK = 64


def p8_length_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks per source when the size of a text is its length: the apportionment alone, which SQL can repeat."""
    told = mixing.clean_weights(table(spark, sf_dir, "source_weights"))
    docs = table(spark, sf_dir, "documents").select(mixing.source_name("source").alias("source"), F.length("text").cast("bigint").alias("n")).filter("n > 0")
    supply = {r["source"]: r["n"] for r in docs.join(F.broadcast(told), "source").groupBy("source").agg(F.sum("n").alias("n")).collect()}
    goal = [(r["source"], r["target_share"], r["max_repeats"]) for r in told.orderBy("source").collect()]
    return spark.createDataFrame(list(mixing.source_quotas(supply, goal, None, LENGTH_BLOCK).items()), "source string, blocks bigint")


def p8_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources used more often than allowed, or in no weight: none."""
    used = p8_mix(spark, sf_dir).groupBy("source").agg(F.max("repeats").alias("most"))
    w = mixing.clean_weights(table(spark, sf_dir, "source_weights"))
    return used.join(w, "source", "left").agg(F.count_if(F.col("max_repeats").isNull() | (F.col("most") > F.col("max_repeats"))).alias("n_excess"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_areas"), table(spark, sf_dir, "subject_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p9_held_out_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_areas"), table(spark, sf_dir, "subject_labels"))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make-up of the corpus: documents that accept a subject, and its weight when each document counts once."""
    s = settle(_subjects(spark, sf_dir))
    weight = s.groupBy("doc_id").agg(F.sum("share").alias("of"))
    return s.join(weight, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("share") / F.col("of")).alias("weight"))


QUERIES = {
    "p2_found": p2_found, "p2_matches": p2_matches,
    "p3_found": p3_found, "p3_recall": p3_recall,
    "p4_found": p4_found, "p4_overlap_report": p4_overlap_report,
    "p5_splits": p5_splits, "p5_shares": p5_shares, "p5_gap": p5_gap, "p5_divided_groups": p5_divided_groups,
    "p6_found": p6_found, "p6_membership": p6_membership,
    "p7_found": p7_found, "p7_leaked_items": p7_leaked_items, "p7_reparameterised": p7_reparameterised,
    "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_excess": p8_excess, "p8_gap": p8_gap, "p8_length_quotas": p8_length_quotas,
    "p9_found": p9_found, "p9_composition": p9_composition, "p9_held_out_quality": p9_held_out_quality,
}

_ID = {k: sql_strict_id(k) for k in ("cell_id", "compound_id", "normalized_parent_id", "scaffold_id")}
_PAIRS = f"""WITH fo AS (SELECT DISTINCT sample_id, lower(trim(role)) AS r FROM lpo_folds WHERE sample_id IS NOT NULL AND lower(trim(role)) IN ('train', 'validation', 'test')),
cs AS (SELECT DISTINCT sample_id, {_ID['cell_id']} AS c, {_ID['compound_id']} AS k, {_ID['normalized_parent_id']} AS p FROM core_samples),
ks AS (SELECT DISTINCT sample_id, c, 'k' AS t, k AS v FROM cs WHERE c IS NOT NULL AND k IS NOT NULL UNION SELECT DISTINCT sample_id, c, 'p', p FROM cs WHERE c IS NOT NULL AND p IS NOT NULL),
kk AS (SELECT ks.*, fo.r FROM ks JOIN fo USING (sample_id)),
pr AS (SELECT DISTINCT a.sample_id AS t, b.sample_id AS e FROM kk a JOIN kk b ON a.c = b.c AND a.t = b.t AND a.v = b.v WHERE a.r = 'train' AND b.r <> 'train'
 UNION SELECT a.sample_id, a.sample_id FROM fo a JOIN fo b ON a.sample_id = b.sample_id WHERE a.r = 'train' AND b.r <> 'train')"""
_GROUPS = f"""WITH RECURSIVE m AS (SELECT DISTINCT {_ID['compound_id']} AS v FROM drug_group_assignment),
k AS (SELECT DISTINCT {_ID['compound_id']} AS v, 'P' || {_ID['normalized_parent_id']} AS key FROM drug_group_assignment
 UNION SELECT DISTINCT {_ID['compound_id']}, 'S' || {_ID['scaffold_id']} FROM core_samples),
kk AS (SELECT k.v, k.key FROM k JOIN m USING (v) WHERE k.key IS NOT NULL AND k.v IS NOT NULL),
e AS (SELECT DISTINCT a.v AS a, b.v AS b FROM kk a JOIN kk b USING (key)),
reach AS (SELECT v AS a, v AS b FROM m WHERE v IS NOT NULL UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a AS compound_id, 'CHEM_' || min(b) AS chemical_group_id, count(*) AS n_members FROM reach GROUP BY a)"""
ORACLE = {
    "p4_found": f"{_PAIRS} SELECT DISTINCT least(t, e) AS sample_id_a, greatest(t, e) AS sample_id_b FROM pr",
    "p4_overlap_report": f"""{_PAIRS}, h AS (SELECT e, count(*) AS n FROM pr GROUP BY e),
 src AS (SELECT DISTINCT sample_id, nullif(trim(release_id), '') AS release_id FROM core_samples)
 SELECT fo.r AS role, src.release_id, count(*) AS n_eval, CAST(sum(h.n) AS BIGINT) AS n_pairs FROM h JOIN fo ON fo.sample_id = h.e AND fo.r <> 'train'
 LEFT JOIN src ON src.sample_id = h.e GROUP BY 1, 2""",
    "p5_divided_groups": f"""WITH r AS (SELECT DISTINCT 'cell' AS kind, {_ID['cell_id']} AS e, {sql_loose_id('group_id')} AS g FROM cell_group_assignment UNION SELECT DISTINCT 'compound', {_ID['compound_id']}, {sql_loose_id('chemical_group_id')} FROM drug_group_assignment),
 l AS (SELECT kind, min(e) AS least FROM r GROUP BY 1), z AS (SELECT kind, g, count(*) AS n, count(*) FILTER (e = least) AS k FROM r JOIN l USING (kind) WHERE e IS NOT NULL AND g IS NOT NULL GROUP BY 1, 2)
 SELECT kind, CAST(0 AS BIGINT) AS n_divided, count(*) FILTER (n > 1 AND k > 0) AS n_planted FROM z GROUP BY 1""",
    "p8_length_quotas": f"""WITH w0 AS (SELECT regexp_replace(lower(trim(source)), '[\\s\\-]+', '_', 'g') AS source, greatest(coalesce(target_share, 0), 0) AS w, greatest(coalesce(max_repeats, 1), 0) AS r FROM source_weights WHERE trim(source) <> ''), w AS (SELECT source, max(w) AS w, min(r) AS r FROM w0 GROUP BY 1),
 d AS (SELECT regexp_replace(lower(trim(source)), '[\\s\\-]+', '_', 'g') AS source, sum(length(text)) AS n FROM documents WHERE length(text) > 0 GROUP BY 1), c AS (SELECT source, CAST(w AS DOUBLE) AS w, n * r // {LENGTH_BLOCK} AS cap FROM d JOIN w USING (source) WHERE w > 0 AND n * r // {LENGTH_BLOCK} > 0),
 s AS (SELECT min(floor(cap / (w / (SELECT sum(w) FROM c)))) AS seats FROM c), q AS (SELECT source, w / (2 * unnest(range(CAST(cap AS BIGINT))) + 1) AS quotient FROM c), k AS (SELECT source, row_number() OVER (ORDER BY quotient DESC, source) AS r FROM q)
 SELECT c.source, count(r) AS blocks FROM c LEFT JOIN (SELECT k.* FROM k, s WHERE r <= seats) k USING (source) GROUP BY 1""",
    "p8_excess": "SELECT CAST(0 AS BIGINT) AS n_excess",
    "p6_found": f"{_GROUPS} SELECT compound_id, chemical_group_id FROM g WHERE n_members > 1",
    "p6_membership": f"{_GROUPS} SELECT * FROM g",
}
