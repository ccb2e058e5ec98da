"""Queries: order and limit, set assertions, fold variants, completeness, recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaymill.functions import scalars as X
from assaymill.functions.ids import sql_strict_id, strict_id
from assaymill.operators import features as E, graph as G, metrics as M, models as L, ranks as K, relational as R, splitting as P
from assaymill.plans import base as B, modelling as D
from assaymill.session import settle, table

S = SparkSession


def _roles(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "lpo_folds").select("sample_id", strict_id("cell_id").alias("cell_id"), F.lower(F.trim("role")).alias("role")).distinct()


def p02_derived_columns(spark: S, sf: str) -> DataFrame:
    s = B.samples(spark, sf).withColumns({"pair_key": F.concat_ws("|", "cell_id", "compound_id"), "excess": F.round(F.col("y") - 3.5, 6)}).withColumnRenamed("release_id", "source_release")
    return s.select("sample_id", "pair_key", "excess", "source_release").filter("excess IS NOT NULL")


def p08_finite_filter(spark: S, sf: str) -> DataFrame:
    t = table(spark, sf, "core_samples")
    return t.groupBy("release_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.is_finite("y")).alias("n_finite"), F.count_if(F.col("y").isNull()).alias("n_null"))


def o05_head_per_role(spark: S, sf: str) -> DataFrame:
    t = K.top_k(_roles(spark, sf).select("sample_id", "role").distinct(), ["role"], 25, F.col("sample_id"))
    return t.select("role", "sample_id", F.col("rank").cast("bigint").alias("rank"))


def o08_first_mismatches(spark: S, sf: str) -> DataFrame:
    """The five first samples whose fold row names another cell."""
    m = B.samples(spark, sf).select("sample_id", F.col("cell_id").alias("here")).join(_roles(spark, sf).select("sample_id", F.col("cell_id").alias("there")).distinct(), "sample_id")
    return R.examples(m.filter("NOT here <=> there"), 5, F.col("sample_id"), F.col("there").asc_nulls_first())


def o03_largest_compounds(spark: S, sf: str) -> DataFrame:
    """The ten most measured compounds, ties by id."""
    g = B.samples(spark, sf).filter("compound_id IS NOT NULL").groupBy("compound_id").agg(F.count(F.lit(1)).alias("n"))
    return R.examples(g, 10, F.col("n").desc(), F.col("compound_id"))


def u02_appended_row(spark: S, sf: str) -> DataFrame:
    """Masters with an adjudicated row appended that lacks most columns."""
    c = B.cells(spark, sf).select("cell_id", "lineage", "status")
    return c.unionByName(spark.createDataFrame([("CL9999999", "adjudicated")], "cell_id string, status string"), allowMissingColumns=True)


def u05_shared_between_roles(spark: S, sf: str) -> DataFrame:
    """Samples in train and test: a row for each."""
    r = _roles(spark, sf)
    return r.filter("role = 'train'").select("sample_id").intersect(r.filter("role = 'test'").select("sample_id"))


def u06_not_a_subset(spark: S, sf: str) -> DataFrame:
    """Fold samples that were never delivered."""
    return R.missing_from(table(spark, sf, "lpo_folds"), table(spark, sf, "core_samples"), "sample_id")


def u07_set_equality(spark: S, sf: str) -> DataFrame:
    return R.set_difference(table(spark, sf, "lpo_folds"), table(spark, sf, "core_samples"), "sample_id")


def u09_distinct_configurations(spark: S, sf: str) -> DataFrame:
    """Distinct union of past and planned configurations and whether it stays within a cap."""
    e = table(spark, sf, "events")
    past, planned = e.select("event_type", (F.col("user_id") % 5).alias("k")), e.select("event_type", (F.col("user_id") % 3).alias("k"))
    return past.union(planned).distinct().agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) <= 24).alias("within_cap"))


def w02_average_ranks(spark: S, sf: str) -> DataFrame:
    return K.group_ranks(B.pairs(spark, sf).select("sample_id", "compound_id", "y"), ["compound_id"], {"rank": "y"}).select("sample_id", "rank")


def r03_fold_table(spark: S, sf: str) -> DataFrame:
    """Sizes of the long fold table: every sample once per fold."""
    f = P.group_folds(D._grouped(spark, sf), "cell_group", "lineage")
    return f.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("sample_id").alias("n_samples"), F.count_if(F.col("role") == "test").alias("n_test"))


def r05_cluster_folds(spark: S, sf: str) -> DataFrame:
    """Compounds and clusters divided by folds over chemical clusters: none, but one per fold where one is planted."""
    d = B.samples(spark, sf).filter("compound_id IS NOT NULL")
    c = G.components(d.select("compound_id", "parent", "scaffold"), "compound_id", ["parent", "scaffold"], "CHEM_").select("compound_id", F.col("component").alias("cluster"))
    d = settle(d.join(c, "compound_id").withColumn("stratum", F.lit("NA")))
    f = P.group_folds(d, "cluster", "stratum").join(d.select("sample_id", "compound_id", "parent", "scaffold"), "sample_id")
    return D.audited(f, ["compound_id", "parent", "scaffold"])


def r06_subtype_folds(spark: S, sf: str) -> DataFrame:
    """Subtypes divided by the stress folds: none, but one per fold where one is planted; samples without a subtype are UNKNOWN."""
    m = table(spark, sf, "cell_master").select(strict_id("cell_id").alias("cell_id"), F.trim("oncotree_subtype").alias("st")).filter("cell_id IS NOT NULL AND st <> ''").groupBy("cell_id").agg(F.max("st").alias("st"))
    d = R.map_join(B.samples(spark, sf).filter("cell_id IS NOT NULL"), m, "cell_id", "st", "subtype", "UNKNOWN")
    return D.audited(P.group_folds(d, "subtype", "lineage"), ["subtype"])


def r12_smoke_subset(spark: S, sf: str) -> DataFrame:
    """Pairs of the first 12 compounds with the first 100 training and 40 test cells."""
    p = B.pairs(spark, sf)
    drugs = R.examples(p.select("compound_id").distinct(), 12, F.col("compound_id"))
    out = None
    for role, n in (("train", 100), ("test", 40)):
        side = p.filter(F.col("role") == role)
        part = side.join(R.examples(side.select("cell_id").distinct(), n, F.col("cell_id")), "cell_id", "left_semi").join(drugs, "compound_id", "left_semi").select("sample_id", "role")
        out = part if out is None else out.unionByName(part)
    return out


def f04_constant_labels(spark: S, sf: str) -> DataFrame:
    return B.pairs(spark, sf).groupBy("compound_id").agg((F.max("y") > F.min("y")).alias("varies"))


def f13_projected_scores(spark: S, sf: str) -> DataFrame:
    """Entities' standardised values projected on three fixed directions instead of sets."""
    m = D._long(spark, sf)
    z = E.transform(m, settle(E.fit(m, "vec_id")))
    w = spark.createDataFrame([(p, d, ((p * (d + 2)) % 7 - 3) / 7.0) for p in range(64) for d in range(3)], "pos int, direction int, w double")
    return z.join(F.broadcast(w), "pos").groupBy("vec_id", "direction").agg(F.round(F.sum(F.col("z") * F.col("w")), 5).alias("score"))


def f16_entities_without_features(spark: S, sf: str) -> DataFrame:
    """Sampled cells and compounds without a valid profile or fingerprint record of their own number."""
    have = table(spark, sf, "prepared_data").filter("fingerprints IS NOT NULL").select(F.upper(F.trim("entity_id")).alias("compound_id")).distinct()
    return R.missing_from(B.samples(spark, sf).filter("compound_id IS NOT NULL"), have, "compound_id")


def m12_set_score_ridge(spark: S, sf: str) -> DataFrame:
    """A ridge on set scores of the embeddings against their labels."""
    m = D._long(spark, sf)
    z = E.transform(m, settle(E.fit(m, "vec_id")))
    s = E.set_scores(z, D._sets(spark), ["vec_id"])
    x = s.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("set_name", "score"))), lambda v: v["score"]).alias("features"))
    d = settle(x.join(table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("y")), "vec_id"))
    return L.linear_predict(L.linear(d, 1.0), d).select("vec_id", F.round("y_pred", 5).alias("y_pred"))


def q17_recomputed_metrics(spark: S, sf: str) -> DataFrame:
    """Saved against freshly computed metrics: no difference but the one planted."""
    fresh = M.error_metrics(B.scored(spark, sf), ["lineage"]).filter("lineage IS NOT NULL")
    saved = settle(fresh).withColumn("mae", F.when(F.col("lineage") == "Lung", F.col("mae") + 0.5).otherwise(F.col("mae")))
    return R.recomputed(saved, fresh, ["lineage"], ["rmse", "mae"]).select("lineage", "column")


def q23_alignment_smoke(spark: S, sf: str) -> DataFrame:
    """Pair features of training and test pairs: rows, width, non-finite values."""
    f = D.f15_pair_features(spark, sf)
    bad = F.size(F.filter("features", lambda x: ~X.is_finite(x)))
    return f.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).cast("bigint").alias("width"), F.sum(bad).alias("n_bad"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "fmopqruw" and k[1:3].isdigit()}

_S, _P, _I = B.SAMPLES, B.PAIRS, sql_strict_id
_R = f"r AS (SELECT DISTINCT sample_id, {_I('f.cell_id')} AS cell_id, lower(trim(role)) AS role FROM lpo_folds f)"
ORACLE = {
    "p02_derived_columns": f"WITH {_S} SELECT sample_id, concat_ws('|', cell_id, compound_id) AS pair_key, round(y - 3.5, 6) AS excess, release_id AS source_release FROM s WHERE y IS NOT NULL",
    "p08_finite_filter": "SELECT release_id, count(*) AS n, count(*) FILTER (isfinite(y)) AS n_finite, count(*) FILTER (y IS NULL) AS n_null FROM core_samples GROUP BY 1",
    "o05_head_per_role": f"WITH {_R} SELECT role, sample_id, row_number() OVER (PARTITION BY role ORDER BY sample_id) AS rank FROM (SELECT DISTINCT sample_id, role FROM r) QUALIFY rank <= 25",
    "o08_first_mismatches": f"WITH {_S}, {_R} SELECT DISTINCT sample_id, s.cell_id AS here, r.cell_id AS there FROM s JOIN r USING (sample_id) WHERE s.cell_id IS DISTINCT FROM r.cell_id ORDER BY sample_id, there NULLS FIRST LIMIT 5",
    "o03_largest_compounds": f"WITH {_S} SELECT compound_id, count(*) AS n FROM s WHERE compound_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, compound_id LIMIT 10",
    "u02_appended_row": f"WITH {B.CELLS} SELECT cell_id, lineage, status FROM c UNION ALL SELECT 'CL9999999', NULL, 'adjudicated'",
    "u05_shared_between_roles": f"WITH {_R} SELECT sample_id FROM r WHERE role = 'train' INTERSECT SELECT sample_id FROM r WHERE role = 'test'",
    "u06_not_a_subset": "SELECT DISTINCT sample_id FROM lpo_folds WHERE sample_id NOT IN (SELECT sample_id FROM core_samples)",
    "u07_set_equality": "SELECT sample_id, 'left' AS side FROM (SELECT sample_id FROM lpo_folds EXCEPT SELECT sample_id FROM core_samples) UNION ALL SELECT sample_id, 'right' FROM (SELECT sample_id FROM core_samples EXCEPT SELECT sample_id FROM lpo_folds)",
    "u09_distinct_configurations": "SELECT count(*) AS n, count(*) <= 24 AS within_cap FROM (SELECT event_type, user_id % 5 AS k FROM events UNION SELECT event_type, user_id % 3 FROM events)",
    "w02_average_ranks": f"WITH {_P} SELECT sample_id, CAST(rank() OVER (PARTITION BY compound_id ORDER BY y) + (count(*) OVER (PARTITION BY compound_id, y) - 1) / 2.0 AS DOUBLE) AS rank FROM p",
    "r03_fold_table": f"WITH {_S} SELECT 5 * count(*) AS n_rows, count(*) AS n_samples, count(*) AS n_test FROM s WHERE y IS NOT NULL AND cell_id IS NOT NULL AND compound_id IS NOT NULL",
    "r05_cluster_folds": f"WITH {_S}, d AS (SELECT * FROM s WHERE compound_id IS NOT NULL) {D.sql_planted('d', ['compound_id', 'parent', 'scaffold'])}",
    "r06_subtype_folds": f"""WITH {_S}, m AS (SELECT {_I('cell_id')} AS cell_id, max(nullif(trim(oncotree_subtype), '')) AS st FROM cell_master GROUP BY 1), d AS (SELECT s.sample_id, coalesce(st, 'UNKNOWN') AS subtype FROM s LEFT JOIN m USING (cell_id) WHERE s.cell_id IS NOT NULL) {D.sql_planted('d', ['subtype'])}""",
    "r12_smoke_subset": f"""WITH {_P}, d AS (SELECT DISTINCT compound_id FROM p ORDER BY 1 LIMIT 12), a AS (SELECT DISTINCT cell_id FROM p WHERE role = 'train' ORDER BY 1 LIMIT 100), b AS (SELECT DISTINCT cell_id FROM p WHERE role = 'test' ORDER BY 1 LIMIT 40)
 SELECT sample_id, role FROM p WHERE compound_id IN (SELECT compound_id FROM d) AND (role = 'train' AND cell_id IN (SELECT cell_id FROM a) OR role = 'test' AND cell_id IN (SELECT cell_id FROM b))""",
    "f04_constant_labels": f"WITH {_P} SELECT compound_id, max(y) > min(y) AS varies FROM p GROUP BY 1",
    "f13_projected_scores": f"WITH {D._M}, {D._fit('m', '')} SELECT vec_id, CAST(d AS INTEGER) AS direction, round(sum((coalesce(x, median) - mean) / sd * ((pos * (d + 2)) % 7 - 3) / 7.0), 5) AS score FROM m JOIN fit USING (pos), range(3) t(d) WHERE kept GROUP BY 1, 2",
    "f16_entities_without_features": f"WITH {_S} SELECT DISTINCT compound_id FROM s WHERE compound_id IS NOT NULL AND compound_id NOT IN (SELECT upper(trim(entity_id)) FROM prepared_data WHERE fingerprints IS NOT NULL AND entity_id IS NOT NULL)",
    "q17_recomputed_metrics": "SELECT 'Lung' AS lineage, 'mae' AS \"column\"",
    "q23_alignment_smoke": f"""WITH {_P}, {B.CELLS}, {B.COMPOUNDS}, cv AS (SELECT c.cell_id FROM c JOIN embeddings ON CAST(regexp_extract(cell_id, '([0-9]+)$', 1) AS BIGINT) % (SELECT count(*) FROM embeddings) = vec_id)
 SELECT role, count(*) AS n, CAST(66 AS BIGINT) AS width, CAST(0 AS BIGINT) AS n_bad FROM p JOIN cv ON p.cell_id = cv.cell_id JOIN d ON p.compound_id = d.compound_id GROUP BY 1""",
}
