"""Cleaned views of the domain tables that the queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaymill.functions.ids import sql_strict_id, strict_id
from assaymill.functions.scalars import finite, integral_text
from assaymill.operators.relational import latest
from assaymill.session import table

blank = lambda c: F.nullif(F.trim(c), F.lit(""))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """The latest delivery of every sample; ids cleaned, y finite or NULL."""
    return latest(table(spark, sf, "core_samples"), "sample_id", F.col("loaded_at").desc()).select(
        "sample_id", strict_id("cell_id").alias("cell_id"), strict_id("compound_id").alias("compound_id"), finite("y").alias("y"), F.col("y").alias("raw_y"), "n_measurements",
        "replicate_dispersion", "any_extrapolation", blank("oncotree_lineage").alias("lineage"), strict_id("normalized_parent_id").alias("parent"), strict_id("scaffold_id").alias("scaffold"),
        blank("release_id").alias("release_id"), "condition_key", "loaded_at", "screened_at",
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """The latest registration of every cell."""
    c = table(spark, sf, "cell_master").withColumn("cid", strict_id("cell_id")).filter("cid IS NOT NULL")
    order = [F.col("registered_at").desc_nulls_last(), *[F.col(x).asc_nulls_last() for x in ("cell_line_name", "depmap_model_id", "profile_rna_model_id", "profile_mut_model_id", "oncotree_lineage", "cosmic_id")]]
    return latest(c, "cid", *order).select(
        F.col("cid").alias("cell_id"), strict_id("sanger_model_id").alias("sanger_model_id"), blank("depmap_model_id").alias("depmap_model_id"), integral_text(blank("cosmic_id")).alias("cosmic_id"),
        blank("cell_line_name").alias("cell_line_name"), blank("oncotree_lineage").alias("lineage"), blank("profile_rna_model_id").alias("rna"), blank("profile_mut_model_id").alias("mut"), "status",
    )


def compounds(spark: SparkSession, sf: str) -> DataFrame:
    """The latest registration of every compound."""
    d = table(spark, sf, "compound_master").withColumn("cid", strict_id("compound_id")).filter("cid IS NOT NULL")
    order = [F.col("registered_at").desc_nulls_last(), *[F.col(x).asc_nulls_last() for x in ("source_name", "inchikey_recomputed", "putative_target", "original_smiles", "source_drug_id")]]
    return latest(d, "cid", *order).select(
        F.col("cid").alias("compound_id"), blank("source_drug_id").alias("source_drug_id"), blank("source_name").alias("source_name"), blank("inchikey_adjudicated").alias("ik_a"),
        blank("inchikey_recomputed").alias("ik_r"), blank("original_smiles").alias("smiles"), blank("putative_target").alias("target"), strict_id("normalized_parent_id").alias("parent"),
        strict_id("scaffold_id").alias("scaffold"),
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (cell, compound): median label, role by id arithmetic, strata."""
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("bigint")
    return (
        samples(spark, sf).filter("y IS NOT NULL AND cell_id IS NOT NULL AND compound_id IS NOT NULL").groupBy("cell_id", "compound_id")
        .agg(F.median("y").alias("y"), F.max("lineage").alias("lineage"), F.max("any_extrapolation").alias("ext"), F.count(F.lit(1)).alias("n"))
        .withColumn("sample_id", F.concat_ws("|", "cell_id", "compound_id"))
        .withColumn("role", F.when((number("cell_id") + number("compound_id")) % 3 == 0, "test").otherwise("train"))
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Test pairs with two predictors: training cell mean (y_a) and cell plus compound mean less the global mean (y_b)."""
    p = pairs(spark, sf)
    train, test = p.filter("role = 'train'"), p.filter("role = 'test'")
    cm = train.groupBy("cell_id").agg(F.avg("y").alias("cm"))
    dm = train.groupBy("compound_id").agg(F.avg("y").alias("dm"))
    g = F.broadcast(train.agg(F.avg("y").alias("g")))  # one row
    met = test.join(cm, "cell_id", "left").join(dm, "compound_id", "left").crossJoin(g)
    return met.select(
        "sample_id", "cell_id", "compound_id", "lineage", "ext", F.col("y").alias("y_true"), F.round(F.coalesce("cm", "g"), 9).alias("y_a"),
        F.round(F.coalesce("cm", "g") + F.coalesce("dm", "g") - F.col("g"), 9).alias("y_b"),
    )


def scored(spark: SparkSession, sf: str, side: str = "y_a") -> DataFrame:
    return predictions(spark, sf).withColumnRenamed(side, "y_pred")


_I = sql_strict_id
SAMPLES = f"""s AS (SELECT sample_id, {_I('cell_id')} AS cell_id, {_I('compound_id')} AS compound_id, CASE WHEN isfinite(y) THEN y END AS y, y AS raw_y, n_measurements, replicate_dispersion,
 any_extrapolation, nullif(trim(oncotree_lineage), '') AS lineage, {_I('normalized_parent_id')} AS parent, {_I('scaffold_id')} AS scaffold, nullif(trim(release_id), '') AS release_id, condition_key, loaded_at, screened_at
 FROM core_samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY loaded_at DESC) = 1)"""
CELLS = f"""c AS (SELECT {_I('cell_id')} AS cell_id, {_I('sanger_model_id')} AS sanger_model_id, nullif(trim(depmap_model_id), '') AS depmap_model_id, regexp_replace(nullif(trim(cosmic_id), ''), '\\.0+$', '') AS cosmic_id,
 nullif(trim(cell_line_name), '') AS cell_line_name, nullif(trim(oncotree_lineage), '') AS lineage, nullif(trim(profile_rna_model_id), '') AS rna, nullif(trim(profile_mut_model_id), '') AS mut, status
 FROM cell_master m WHERE {_I('m.cell_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_I('m.cell_id')} ORDER BY registered_at DESC NULLS LAST, m.cell_line_name NULLS LAST, m.depmap_model_id NULLS LAST, profile_rna_model_id NULLS LAST, profile_mut_model_id NULLS LAST, oncotree_lineage NULLS LAST, m.cosmic_id NULLS LAST) = 1)"""
COMPOUNDS = f"""d AS (SELECT {_I('compound_id')} AS compound_id, nullif(trim(source_drug_id), '') AS source_drug_id, nullif(trim(source_name), '') AS source_name, nullif(trim(inchikey_adjudicated), '') AS ik_a,
 nullif(trim(inchikey_recomputed), '') AS ik_r, nullif(trim(original_smiles), '') AS smiles, nullif(trim(putative_target), '') AS target, {_I('normalized_parent_id')} AS parent, {_I('scaffold_id')} AS scaffold
 FROM compound_master m WHERE {_I('m.compound_id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_I('m.compound_id')} ORDER BY registered_at DESC NULLS LAST, m.source_name NULLS LAST, inchikey_recomputed NULLS LAST, putative_target NULLS LAST, original_smiles NULLS LAST, m.source_drug_id NULLS LAST) = 1)"""
PAIRS = f"""{SAMPLES}, p AS (SELECT *, cell_id || '|' || compound_id AS sample_id, CASE WHEN (CAST(regexp_extract(cell_id, '([0-9]+)$', 1) AS BIGINT) + CAST(regexp_extract(compound_id, '([0-9]+)$', 1) AS BIGINT)) % 3 = 0 THEN 'test' ELSE 'train' END AS role
 FROM (SELECT cell_id, compound_id, median(y) AS y, max(lineage) AS lineage, max(any_extrapolation) AS ext, count(*) AS n FROM s WHERE y IS NOT NULL AND cell_id IS NOT NULL AND compound_id IS NOT NULL GROUP BY 1, 2))"""
PREDICTIONS = f"""{PAIRS}, cm AS (SELECT cell_id, avg(y) AS cm FROM p WHERE role = 'train' GROUP BY 1), dm AS (SELECT compound_id, avg(y) AS dm FROM p WHERE role = 'train' GROUP BY 1), gm AS (SELECT avg(y) AS g FROM p WHERE role = 'train'),
pred AS (SELECT sample_id, p.cell_id, p.compound_id, lineage, ext, y AS y_true, round(coalesce(cm, g), 9) AS y_a, round(coalesce(cm, g) + coalesce(dm, g) - g, 9) AS y_b
 FROM p LEFT JOIN cm USING (cell_id) LEFT JOIN dm USING (compound_id) CROSS JOIN gm WHERE role = 'test')"""


def sql_groups(src: str, by: str, pred: str, min_cells: int = 10) -> str:
    """CTEs g (per group metrics) over ``src``; by: comma separated grouping columns that end with compound_id."""
    part = f"PARTITION BY {by}"
    return f"""rk AS (SELECT *, rank() OVER ({part} ORDER BY y_true) + (count(*) OVER ({part}, y_true) - 1) / 2.0 AS rt, rank() OVER ({part} ORDER BY {pred}) + (count(*) OVER ({part}, {pred}) - 1) / 2.0 AS rp FROM {src}),
g0 AS (SELECT {by}, count(*) AS n_samples, count(DISTINCT cell_id) AS n_cells, max(y_true) > min(y_true) AS label_variance, max({pred}) = min({pred}) AS const_pred,
 CASE WHEN max(y_true) > min(y_true) AND max({pred}) > min({pred}) THEN corr(rt, rp) END AS rho, CASE WHEN max(y_true) > min(y_true) AND max({pred}) > min({pred}) THEN corr(y_true, {pred}) END AS pcc FROM rk GROUP BY {by}),
g AS (SELECT {by}, n_samples, n_cells, label_variance, n_cells >= {min_cells} AND label_variance AS qualified, CASE WHEN n_cells >= {min_cells} AND label_variance THEN rho END AS spearman_raw,
 CASE WHEN n_cells >= {min_cells} AND label_variance THEN coalesce(rho, 0) END AS spearman_selection, CASE WHEN n_cells >= {min_cells} AND label_variance THEN pcc END AS pcc_raw, n_cells >= {min_cells} AND label_variance AND const_pred AS constant_prediction FROM g0)"""
