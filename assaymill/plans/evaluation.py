"""Queries: metrics, comparisons, bins, corrections, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaymill.operators import metrics as M, ranks as K
from assaymill.plans import base as B

R6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
S = SparkSession


def a17_errors_per_lineage(spark: S, sf: str) -> DataFrame:
    e = M.error_metrics(B.scored(spark, sf), ["lineage"])
    return e.select("lineage", "n_samples", *R6("rmse", "mae", "r2"))


def a19_spearman_per_compound(spark: S, sf: str) -> DataFrame:
    return K.spearman(B.scored(spark, sf), ["compound_id"], "y_true", "y_pred").select("compound_id", *R6("rho"))


def a20_pair_accuracy(spark: S, sf: str) -> DataFrame:
    return M.pair_accuracy(B.scored(spark, sf), ["compound_id"]).select("compound_id", *R6("pair_accuracy"))


def a21_per_compound(spark: S, sf: str) -> DataFrame:
    g = M.per_group(B.scored(spark, sf), ["compound_id"])
    return g.select("compound_id", "n_samples", "n_cells", "label_variance", "qualified", "constant_prediction", *R6("spearman_raw", "spearman_selection", "pcc_raw"))


def a21_macro(spark: S, sf: str) -> DataFrame:
    m = M.macro(B.scored(spark, sf))
    return m.select("n_drugs", "n_qualified", "n_constant", "n_samples", *R6("macro_spearman", "macro_pcc", "rmse", "mae", "r2"))


def a22_cell_spearman(spark: S, sf: str) -> DataFrame:
    s = K.spearman(B.scored(spark, sf, "y_b"), ["cell_id"], "y_true", "y_pred").filter("rho IS NOT NULL")
    return s.agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.avg("rho"), 6).alias("mean_rho"))


def a23_strata(spark: S, sf: str) -> DataFrame:
    m = M.strata(B.scored(spark, sf), ["lineage", "ext"], min_cells=3)
    return m.select("dimension", "value", "n_samples", "n_qualified", *R6("macro_spearman", "rmse", "mae"))


def a18_pooled_correlation(spark: S, sf: str) -> DataFrame:
    p = B.scored(spark, sf)
    r = K.global_average_rank(K.global_average_rank(p, "y_true", "rt"), "y_pred", "rp")
    return r.agg(F.round(K.guarded_corr("y_true", "y_pred"), 6).alias("pooled_pcc"), F.round(K.guarded_corr("rt", "rp"), 6).alias("pooled_spearman"))


def q18_paired_difference(spark: S, sf: str) -> DataFrame:
    d = M.paired_difference(B.predictions(spark, sf))
    return d.select("n_qualified", *R6("delta_macro", "rmse_ratio"))


def q02_prediction_violations(spark: S, sf: str) -> DataFrame:
    """Violations in the raw deliveries taken as predictions of themselves."""
    from assaymill.session import table

    raw = table(spark, sf, "core_samples").select("sample_id", "cell_id", "compound_id", F.col("y").alias("y_true"), F.col("y").alias("y_pred"))
    return M.violations(raw)


def _against_lineage(spark: S, sf: str) -> DataFrame:
    """The cell mean beside the training mean of the cell's lineage."""
    m = B.pairs(spark, sf).filter("role = 'train' AND lineage IS NOT NULL").groupBy("lineage").agg(F.avg("y").alias("lm"))
    return B.predictions(spark, sf).join(m, "lineage", "left").withColumn("y_b", F.round(F.coalesce("lm", "y_b"), 9)).drop("lm")


def r11_bootstrap_lco(spark: S, sf: str) -> DataFrame:
    p = _against_lineage(spark, sf).withColumn("cell_group", F.col("cell_id"))
    return M.bootstrap(p, "lco", n_boot=1000)


def r11_bootstrap_ldo(spark: S, sf: str) -> DataFrame:
    p = _against_lineage(spark, sf).withColumn("chemical_group", F.col("compound_id"))
    return M.bootstrap(p, "ldo_so", n_boot=1000)


def r11_bootstrap_db(spark: S, sf: str) -> DataFrame:
    p = _against_lineage(spark, sf).withColumn("cell_group", F.coalesce("lineage", F.lit("none"))).withColumn("chemical_group", F.col("compound_id"))
    return M.bootstrap(p, "db", n_boot=1000)


def w06_holm(spark: S, sf: str) -> DataFrame:
    """Compounds' mean absolute errors turned into stand-in p-values, corrected within each lineage."""
    p = B.scored(spark, sf).groupBy("lineage", "compound_id").agg(F.round(F.least(F.lit(1.0), F.avg(F.abs(F.col("y_pred") - F.col("y_true"))) / 50), 9).alias("p"))
    h = K.holm(p, ["lineage"], "p", "compound_id")
    return h.select("lineage", "compound_id", "p", *R6("p_adjusted"))


def w10_coverage_bins(spark: S, sf: str) -> DataFrame:
    return M.coverage_bins(B.pairs(spark, sf).filter("role = 'train'")).select("compound_id", "n_cells", F.col("bin").cast("bigint").alias("bin"))


def w05_best_compound_per_cell(spark: S, sf: str) -> DataFrame:
    t = K.top_k(B.pairs(spark, sf), ["cell_id"], 3, F.col("y"), F.col("compound_id"))
    return t.select("cell_id", F.col("rank").cast("bigint").alias("rank"), "compound_id", F.round("y", 7).alias("y"))


def q22_error_boxes(spark: S, sf: str) -> DataFrame:
    b = B.scored(spark, sf).groupBy("compound_id").agg(F.percentile(F.abs(F.col("y_pred") - F.col("y_true")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return b.select("compound_id", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


def a27_percentile_interval(spark: S, sf: str) -> DataFrame:
    p = B.samples(spark, sf).groupBy("release_id").agg(F.percentile("y", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("y").alias("n"))
    return p.select("release_id", "n", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def q19_screen(spark: S, sf: str) -> DataFrame:
    """Releases as models, lineages as seeds."""
    g = B.samples(spark, sf).filter("y IS NOT NULL").groupBy("release_id", "lineage").agg(F.round(F.avg("y") - 3, 9).alias("delta_macro"), F.round(1 + F.stddev_pop("y") / 100, 9).alias("rmse_ratio"))
    s = M.screen(g, "release_id")
    return s.select("release_id", "n_positive", "verdict", *R6("mean_gain", "mean_ratio", "sd_gain"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "aqrw" and k[1:3].isdigit()}

_P = B.PREDICTIONS
_G = B.sql_groups("pred", "compound_id", "y_a")
ORACLE = {
    "a17_errors_per_lineage": f"""WITH {_P} SELECT lineage, count(*) AS n_samples, round(sqrt(avg((y_a - y_true) * (y_a - y_true))), 6) AS rmse, round(avg(abs(y_a - y_true)), 6) AS mae,
 round(1 - avg((y_a - y_true) * (y_a - y_true)) / nullif(var_pop(y_true), 0), 6) AS r2 FROM pred GROUP BY 1""",
    "a19_spearman_per_compound": f"WITH {_P}, {_G} SELECT compound_id, round(rho, 6) AS rho FROM g0",
    "a20_pair_accuracy": f"""WITH {_P} SELECT a.compound_id, round(avg(CASE WHEN sign(a.y_true - b.y_true) = sign(a.y_a - b.y_a) THEN 1.0 ELSE 0.0 END), 6) AS pair_accuracy
 FROM pred a JOIN pred b ON a.compound_id = b.compound_id AND a.y_true < b.y_true GROUP BY 1""",
    "a21_per_compound": f"""WITH {_P}, {_G} SELECT compound_id, n_samples, n_cells, label_variance, qualified, constant_prediction, round(spearman_raw, 6) AS spearman_raw, round(spearman_selection, 6) AS spearman_selection,
 round(pcc_raw, 6) AS pcc_raw FROM g""",
    "a21_macro": f"""WITH {_P}, {_G}, m AS (SELECT count(*) AS n_drugs, count(*) FILTER (qualified) AS n_qualified, count(*) FILTER (constant_prediction) AS n_constant, round(avg(spearman_selection), 6) AS macro_spearman, round(avg(pcc_raw), 6) AS macro_pcc FROM g),
 e AS (SELECT count(*) AS n_samples, round(sqrt(avg((y_a - y_true) * (y_a - y_true))), 6) AS rmse, round(avg(abs(y_a - y_true)), 6) AS mae, round(1 - avg((y_a - y_true) * (y_a - y_true)) / nullif(var_pop(y_true), 0), 6) AS r2 FROM pred) SELECT * FROM m, e""",
    "a22_cell_spearman": f"""WITH {_P}, {B.sql_groups('pred', 'cell_id', 'y_b')} SELECT count(*) AS n_cells, round(avg(rho), 6) AS mean_rho FROM g0 WHERE rho IS NOT NULL""",
    "a23_strata": f"""WITH {_P}, long AS (SELECT 'lineage' AS dimension, coalesce(lineage, '(missing)') AS value, * FROM pred UNION ALL SELECT 'ext', coalesce(CAST(ext AS VARCHAR), '(missing)'), * FROM pred),
 {B.sql_groups('long', 'dimension, value, compound_id', 'y_a', 3)}, m AS (SELECT dimension, value, count(*) FILTER (qualified) AS n_qualified, round(avg(spearman_selection), 6) AS macro_spearman FROM g GROUP BY 1, 2),
 e AS (SELECT dimension, value, count(*) AS n_samples, round(sqrt(avg((y_a - y_true) * (y_a - y_true))), 6) AS rmse, round(avg(abs(y_a - y_true)), 6) AS mae FROM long GROUP BY 1, 2) SELECT * FROM m JOIN e USING (dimension, value)""",
    "a18_pooled_correlation": f"""WITH {_P}, r AS (SELECT *, rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2.0 AS rt, rank() OVER (ORDER BY y_a) + (count(*) OVER (PARTITION BY y_a) - 1) / 2.0 AS rp FROM pred)
 SELECT round(corr(y_true, y_a), 6) AS pooled_pcc, round(corr(rt, rp), 6) AS pooled_spearman FROM r""",
    "q18_paired_difference": f"""WITH {_P}, two AS (SELECT 'a' AS side, *, y_a AS y_pred FROM pred UNION ALL SELECT 'b', *, y_b FROM pred), {B.sql_groups('two', 'side, compound_id', 'y_pred')},
 m AS (SELECT side, count(*) FILTER (qualified) AS nq, avg(spearman_selection) AS ms FROM g GROUP BY 1), e AS (SELECT side, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse FROM two GROUP BY 1)
 SELECT max(nq) AS n_qualified, round(max(ms) FILTER (side = 'a') - max(ms) FILTER (side = 'b'), 6) AS delta_macro, round(max(rmse) FILTER (side = 'a') / max(rmse) FILTER (side = 'b'), 6) AS rmse_ratio FROM m JOIN e USING (side)""",
    "q02_prediction_violations": """SELECT * FROM (SELECT 'missing_sample_id' AS reason, count(*) FILTER (sample_id IS NULL) AS n FROM core_samples UNION ALL SELECT 'missing_entity', count(*) FILTER (cell_id IS NULL OR compound_id IS NULL) FROM core_samples
 UNION ALL SELECT 'non_finite', count(*) FILTER (y IS NULL OR NOT isfinite(y)) FROM core_samples UNION ALL SELECT 'duplicate_sample_id', count(*) FROM (SELECT sample_id FROM core_samples WHERE sample_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0""",
    "w06_holm": f"""WITH {_P}, q AS (SELECT lineage, compound_id, round(least(1.0, avg(abs(y_a - y_true)) / 50), 9) AS p FROM pred GROUP BY 1, 2),
 t AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY lineage) - row_number() OVER (PARTITION BY lineage ORDER BY p, compound_id) + 1) * p) AS st FROM q)
 SELECT lineage, compound_id, p, round(max(st) OVER (PARTITION BY lineage ORDER BY p, compound_id ROWS UNBOUNDED PRECEDING), 6) AS p_adjusted FROM t""",
    "w10_coverage_bins": f"""WITH {B.PAIRS}, n AS (SELECT compound_id, count(DISTINCT cell_id) AS n_cells FROM p WHERE role = 'train' GROUP BY 1), e AS (SELECT unnest(quantile_cont(n_cells, [0.25, 0.5, 0.75])) AS e, min(n_cells) AS lo, max(n_cells) AS hi FROM n),
 ed AS (SELECT DISTINCT e FROM e WHERE e > lo AND e < hi) SELECT compound_id, n_cells, (SELECT count(*) FROM ed WHERE ed.e < n.n_cells) + 1 AS bin FROM n""",
    "w05_best_compound_per_cell": f"""WITH {B.PAIRS} SELECT cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY y, compound_id) AS rank, compound_id, round(y, 7) AS y FROM p QUALIFY rank <= 3""",
    "q22_error_boxes": f"""WITH {_P} SELECT compound_id, round(quantile_cont(abs(y_a - y_true), 0.25), 6) AS q25, round(quantile_cont(abs(y_a - y_true), 0.5), 6) AS q50, round(quantile_cont(abs(y_a - y_true), 0.75), 6) AS q75 FROM pred GROUP BY 1""",
    "a27_percentile_interval": f"""WITH {B.SAMPLES} SELECT release_id, count(y) AS n, round(quantile_cont(y, 0.025), 6) AS low, round(quantile_cont(y, 0.975), 6) AS high FROM s GROUP BY 1""",
    "q19_screen": f"""WITH {B.SAMPLES}, g AS (SELECT release_id, lineage, round(avg(y) - 3, 9) AS dm, round(1 + stddev_pop(y) / 100, 9) AS rr FROM s WHERE y IS NOT NULL GROUP BY 1, 2),
 a AS (SELECT release_id, avg(dm) AS mg, count(*) FILTER (dm > 0) AS n_positive, avg(rr) AS mr, stddev_samp(dm) AS sg FROM g GROUP BY 1)
 SELECT release_id, n_positive, CASE WHEN round(mg, 9) >= 0.02 AND n_positive >= 2 AND round(mr, 9) <= 1.02 THEN 'pass' ELSE 'fail' END AS verdict, round(mg, 6) AS mean_gain, round(mr, 6) AS mean_ratio, round(sg, 6) AS sd_gain FROM a""",
}
