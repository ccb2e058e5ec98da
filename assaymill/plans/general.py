"""Queries of the general training-data problems (p1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaymill.functions.ids import sql_strict_id
from assaymill.operators import orphans as O
from assaymill.session import table

REF_FIELDS = ["cell_id", "compound_id", "sanger_model_id"]


def _judged(spark: SparkSession, sf_dir: str) -> O.Judged:
    cells, compounds = table(spark, sf_dir, "cell_master"), table(spark, sf_dir, "compound_master")
    spans = (
        O.validity(cells, "cell_id", "cell_id")
        .unionByName(O.validity(cells, "sanger_model_id", "sanger_model_id"))
        .unionByName(O.validity(compounds, "compound_id", "compound_id"))
    )
    return O.judge(O.references(table(spark, sf_dir, "core_samples"), REF_FIELDS, "loaded_at", "sample_id"), spans)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.dangling_rows(_judged(spark, sf_dir))
    return rows.select(F.col("row_id").alias("sample_id"), F.col("field").alias("ref_field")).distinct()


def p1_orphans_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = O.dangling_counts(_judged(spark, sf_dir))
    return c.select(F.col("field").alias("ref_field"), F.date_format("period", "yyyy-MM").alias("month"), "n_dangling", "n_ids")


QUERIES = {"p1_found": p1_found, "p1_orphans_per_month": p1_orphans_per_month}

_REFS = " UNION ALL ".join(
    f"SELECT sample_id, '{f}' AS ref_field, {sql_strict_id(f)} AS id, loaded_at FROM core_samples" for f in REF_FIELDS
)
_SPANS = " UNION ALL ".join(
    f"SELECT '{f}' AS f, {sql_strict_id(f)} AS id, registered_at AS s, coalesce(retired_at, TIMESTAMP '9999-12-31') AS e FROM {t}"
    for f, t in zip(REF_FIELDS, ["cell_master", "compound_master", "cell_master"])
)
_DANGLING = f"""WITH r AS ({_REFS}), m AS ({_SPANS}),
d AS (SELECT * FROM r WHERE id IS NOT NULL AND NOT EXISTS
      (SELECT 1 FROM m WHERE m.f = r.ref_field AND m.id = r.id AND m.s <= r.loaded_at AND r.loaded_at < m.e))"""
ORACLE = {
    "p1_found": f"{_DANGLING} SELECT DISTINCT sample_id, ref_field FROM d",
    "p1_orphans_per_month": f"""{_DANGLING} SELECT ref_field, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n_dangling,
 count(DISTINCT id) AS n_ids FROM d GROUP BY 1, 2""",
}
