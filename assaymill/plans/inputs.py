"""Queries: sources and sinks by round trip, scalar functions, the streaming extension.

The files that a query reads back are written to the shared folder first, from the whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaymill.functions import chemistry as C, scalars as X
from assaymill.functions.ids import sql_strict_id, strict_id
from assaymill.plans import base as B
from assaymill.session import shared_dir, table
from assaymill.sources import readers as R, sinks as W
from assaymill.streaming import events as V

S = SparkSession


def _path(spark: S, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, path: str) -> str:
    """Text lines (value) in one file per task."""
    df.write.text(path)
    return path


def s01_csv_strings(spark: S, sf: str) -> DataFrame:
    p = _path(spark, "csv")
    cols = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    W.csv(table(spark, sf, "customer").select(*cols), p)
    return R.csv_strings(spark, p, cols)


def s02_csv_projection(spark: S, sf: str) -> DataFrame:
    p = _path(spark, "csv")
    cols = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    W.csv(table(spark, sf, "part").select(*cols), p)
    return R.csv_strings(spark, p, cols, ["p_partkey", "p_brand"])


def s03_csv_with_mark(spark: S, sf: str) -> DataFrame:
    t = table(spark, sf, "nation").select(F.lit(1).alias("o"), F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    head = spark.createDataFrame([(0, "﻿n_nationkey,n_name")], "o int, value string")
    p = _lines(head.unionByName(t).coalesce(1).sortWithinPartitions("o").select("value"), _path(spark, "bom"))
    return R.csv_with_mark(spark, p)


def _header(spark: S, sf: str) -> str:
    cols = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")")).alias("c"))
    line = cols.agg(F.concat(F.lit("ModelID,profile,"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]), ",")).alias("value"))  # a header is one line by nature
    return _lines(line, _path(spark, "header"))


def s04_header_pairs(spark: S, sf: str) -> DataFrame:
    return R.header_pairs(R.header_line(spark, _header(spark, sf)))[0]


def s05_header_rejects(spark: S, sf: str) -> DataFrame:
    return R.header_pairs(R.header_line(spark, _header(spark, sf)))[1]


def s06_matrix_rows(spark: S, sf: str) -> DataFrame:
    """Rows of a wide matrix for the vectors of one label."""
    e = table(spark, sf, "embeddings")
    rows = e.select(F.lit(1).alias("o"), F.concat_ws(",", F.col("vec_id").cast("string"), F.lit("m"), F.array_join(F.transform("embedding", lambda x: F.when(x < -2, "NA").otherwise(x.cast("string"))), ",")).alias("value"))
    head = spark.createDataFrame([(0, "entity,meta," + ",".join(f"G{i} ({i})" for i in range(64)))], "o int, value string")
    p = _lines(head.unionByName(rows).coalesce(1).sortWithinPartitions("o").select("value"), _path(spark, "matrix"))
    keep = e.filter("label = 3").select(F.col("vec_id").cast("string").alias("entity"))
    m = R.matrix_rows(spark, p, 2, 0, keep)
    return m.select("entity", F.size("values").cast("bigint").alias("n"), F.size(F.filter("values", lambda x: x.isNull())).cast("bigint").alias("n_missing"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 3).alias("total"))


def s08_gene_sets(spark: S, sf: str) -> DataFrame:
    t = table(spark, sf, "part").groupBy("p_brand").agg(F.concat_ws("\t", F.col("p_brand"), F.lit("http://x"), F.array_join(F.array_sort(F.collect_list(F.col("p_partkey").cast("string"))), "\t"), F.lit("not_a_number")).alias("value"))
    g = R.gene_sets(spark, _lines(t.select("value"), _path(spark, "gmt")), numeric_only=True)
    return g.select("set_name", F.size("members").cast("bigint").alias("n"), F.array_min(F.transform("members", lambda m: m.cast("bigint"))).alias("least"))


def s09_flat_records(spark: S, sf: str) -> DataFrame:
    m = table(spark, sf, "cell_master").select(F.trim("cellosaurus_accession").alias("a"), F.trim("cell_line_name").alias("n"), strict_id("cell_id").alias("c")).filter("a <> '' AND n <> '' AND c IS NOT NULL").groupBy("a").agg(F.min("n").alias("n"), F.array_sort(F.collect_set("c")).alias("cs"))
    text = m.select(F.concat(F.lit("ID   "), "n", F.lit("\nAC   "), "a", F.lit(";\n"), F.array_join(F.transform("cs", lambda c: F.concat(F.lit("DR   Cells; "), c, F.lit("\n"))), ""), F.lit("//")).alias("value"))
    r = R.flat_records(spark, _lines(text, _path(spark, "records")), ["Cells", "Cosmic"])
    return r.select("accession", "name", F.array_join("cells", ";").alias("cells"), F.size("cosmic").cast("bigint").alias("n_cosmic"))


def s11_pruned_scan(spark: S, sf: str) -> DataFrame:
    """Column pruning and pushed predicates reach the scan."""
    return table(spark, sf, "lineitem").filter("l_quantity < 5 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


def s16_json_lines(spark: S, sf: str) -> DataFrame:
    p = _path(spark, "json")
    W.json_lines(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props"), p)
    j = R.json_lines(spark, p, "event_id bigint, user_id bigint, event_type string, value double, props string")
    return j.select("event_id", "event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), "value")


def s14_json_documents(spark: S, sf: str) -> DataFrame:
    """One document per nation in a folder, those of status done."""
    p = _path(spark, "docs")
    t = table(spark, sf, "nation").select("n_regionkey", F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "done").otherwise("open").alias("status")).alias("d"))
    t.select(F.to_json("d").alias("value"), F.col("d.key").alias("k")).repartition(5, "k").write.partitionBy("k").text(p)
    return R.json_documents(spark, p, "name string, key int, status string", "done").select("name", "key")


def s18_inventory(spark: S, sf: str) -> DataFrame:
    """Files below the table folder with the digests of their contents."""
    return R.inventory(spark, sf, "*.parquet").select("name", "length", "sha256")


def s22_seed_candidates(spark: S, sf: str) -> DataFrame:
    m = table(spark, sf, "compound_master")
    c = R.seed_candidates((m.select("source_name", F.concat("source_drug_id", F.lit(".0")).alias("i")), "number", "source_name", "i"), (m.select("source_name", "chembl_id"), "registry", "source_name", "chembl_id"))
    return c.select("name", F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["source"], x["id"])), ";").alias("candidates"))


def s23_first_per_id(spark: S, sf: str) -> DataFrame:
    m = table(spark, sf, "compound_master").filter("source_drug_id IS NOT NULL AND registered_at IS NOT NULL").select("source_drug_id", "source_name", F.struct("registered_at", F.coalesce("source_name", F.lit(""))).alias("at"))
    return R.first_per_id(m, "source_drug_id", "at").select("source_drug_id", "source_name", "id_number")


def k03_partitioned_parquet(spark: S, sf: str) -> DataFrame:
    """Written by priority and read back with partition pruning."""
    p = _path(spark, "parts")
    W.parquet(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), p, ["o_orderpriority"])
    return spark.read.parquet(p).filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")


def k04_wide_contributions(spark: S, sf: str) -> DataFrame:
    t = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    return W.wide_contributions(t, "user_id", "event_type", "v", ["click", "error", "purchase", "signup", "view"])


def k12_cached_features(spark: S, sf: str) -> DataFrame:
    f = table(spark, sf, "embeddings").select("vec_id", F.round(X.dot("embedding", "embedding"), 4).alias("norm2"))
    return W.cached_features(f, _path(spark, "features"), {"table": "embeddings"}, {"policy": "norm2"})


def x01_text_functions(spark: S, sf: str) -> DataFrame:
    m = table(spark, sf, "cell_master").select("cell_line_name", "cosmic_id", "cellosaurus_accession", "registered_at").filter("cell_line_name IS NOT NULL").distinct()
    return m.groupBy("cell_line_name").agg(F.max("cosmic_id").alias("c"), F.max("cellosaurus_accession").alias("a")).select(
        "cell_line_name", X.name_key("cell_line_name").alias("name_key"), X.integral_text("c").alias("number"), F.split_part("a", F.lit("_"), F.lit(2)).alias("code"),
        F.regexp_extract("cell_line_name", r"(\d+)$", 1).alias("digits"), F.lpad("c", 12, "0").alias("padded"), F.substring(F.sha2("cell_line_name", 256), 1, 16).alias("hash16"),
    )


def x10_number_functions(spark: S, sf: str) -> DataFrame:
    s = B.samples(spark, sf)
    return s.select(
        "sample_id", F.round(F.exp("y"), 3).alias("micromolar"), F.round(X.micromolar_pic50("y"), 6).alias("pic50"), X.half_even(F.round(F.col("y") * 2, 0) / 2).cast("double").alias("half"),
        F.floor(F.col("y") * 0.2).cast("bigint").alias("fifth"), X.is_close(F.col("y"), F.round("y", 2), 1e-3, 1e-3).alias("near"), F.signum(F.col("y") - 3).alias("sign"), F.nanvl("raw_y", F.lit(0.0)).isNotNull().alias("present"),
    )


def x21_bit_similarity(spark: S, sf: str) -> DataFrame:
    """Similarity of consecutive vectors' set bits."""
    on = lambda s: table(spark, sf, "embeddings").select(F.col("vec_id").alias(f"v{s}"), F.filter(F.transform("embedding", lambda x, i: F.when(x > 0.5, i)), lambda x: x.isNotNull()).alias(f"b{s}"))
    a, b = on(1), on(2)
    return a.join(b, F.col("v2") == F.col("v1") + 1).select("v1", F.round(X.tanimoto("b1", "b2"), 6).alias("tanimoto"))


def x22_json_functions(spark: S, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.col("p.k").cast("bigint").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"), F.lit(True).alias("ok"))).alias("again"))


def f06_salt_screen(spark: S, sf: str) -> DataFrame:
    d = B.compounds(spark, sf).filter("smiles IS NOT NULL")
    return d.select("compound_id", C.has_counter_ion("smiles").alias("has_counter_ion"), F.instr(C.largest_fragment("smiles"), ".").cast("bigint").alias("dots_left"))


def f07_salt_class(spark: S, sf: str) -> DataFrame:
    """Compounds' structures by the text rules: metals in brackets, fragments parted by dots."""
    d = B.compounds(spark, sf).filter("smiles IS NOT NULL")
    return d.select("compound_id", C.text_salt_class("smiles").alias("salt_class"))


def v01_windowed_events(spark: S, sf: str) -> DataFrame:
    """Extension: counts and sums per type and hour by a stream over the event files that ends when they are read."""
    return V.windowed(spark, f"{sf}/events.parquet", _path(spark, "stream"))


def v02_sessions(spark: S, sf: str) -> DataFrame:
    """Extension: sessions of users, closed by 30 minutes of silence."""
    return V.sessions(table(spark, sf, "events"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "skxfv" and k[1:3].isdigit()}

_I = sql_strict_id
ORACLE = {
    "s01_csv_strings": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer",
    "s02_csv_projection": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand FROM part",
    "s03_csv_with_mark": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation",
    "s04_header_pairs": "SELECT CAST(row_number() OVER (ORDER BY p_partkey) + 1 AS INTEGER) AS pos, p_name AS symbol, CAST(p_partkey AS VARCHAR) AS number FROM part",
    "s05_header_rejects": "SELECT * FROM (VALUES (0, 'ModelID'), (1, 'profile')) t(pos, name)",
    "s06_matrix_rows": "SELECT CAST(vec_id AS VARCHAR) AS entity, count(*) AS n, count(*) FILTER (x < -2) AS n_missing, round(sum(CASE WHEN x < -2 THEN 0 ELSE CAST(x AS DOUBLE) END), 3) AS total FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings WHERE label = 3) GROUP BY 1",
    "s08_gene_sets": "SELECT p_brand AS set_name, count(*) AS n, min(p_partkey) AS least FROM part GROUP BY 1",
    "s09_flat_records": f"SELECT a AS accession, min(n) AS name, string_agg(DISTINCT c, ';' ORDER BY c) AS cells, CAST(0 AS BIGINT) AS n_cosmic FROM (SELECT trim(cellosaurus_accession) AS a, trim(cell_line_name) AS n, {_I('cell_id')} AS c FROM cell_master) WHERE a <> '' AND n <> '' AND c IS NOT NULL GROUP BY 1",
    "s11_pruned_scan": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R'",
    "s16_json_lines": "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events",
    "s14_json_documents": "SELECT n_name AS name, n_nationkey AS key FROM nation WHERE n_nationkey % 2 = 0",
    "s22_seed_candidates": """SELECT name, string_agg(c, ';' ORDER BY c) AS candidates FROM (SELECT DISTINCT trim(source_name) AS name, 'number:' || trim(source_drug_id) AS c FROM compound_master WHERE source_drug_id IS NOT NULL UNION SELECT trim(source_name), 'registry:' || regexp_replace(trim(chembl_id), '\\.0+$', '') FROM compound_master WHERE chembl_id IS NOT NULL)
 WHERE name <> '' AND lower(split_part(c, ':', 2)) NOT IN ('', 'nan', 'none') GROUP BY 1""",
    "s23_first_per_id": "SELECT source_drug_id, source_name, TRY_CAST(source_drug_id AS BIGINT) AS id_number FROM compound_master WHERE source_drug_id IS NOT NULL AND registered_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_drug_id ORDER BY registered_at, coalesce(source_name, '')) = 1",
    "k03_partitioned_parquet": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'",
    "k04_wide_contributions": "SELECT user_id, " + ", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 4) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "k12_cached_features": "SELECT vec_id, round(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 4) AS norm2 FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1",
    "x01_text_functions": """SELECT cell_line_name, regexp_replace(lower(cell_line_name), '[-_;\\s/.]', '', 'g') AS name_key, regexp_replace(max(cosmic_id), '\\.0+$', '') AS number, split_part(max(cellosaurus_accession), '_', 2) AS code, regexp_extract(cell_line_name, '([0-9]+)$', 1) AS digits,
 CASE WHEN length(max(cosmic_id)) <= 12 THEN lpad(max(cosmic_id), 12, '0') ELSE left(max(cosmic_id), 12) END AS padded, left(sha256(cell_line_name), 16) AS hash16 FROM cell_master WHERE cell_line_name IS NOT NULL GROUP BY 1""",
    "x10_number_functions": f"""WITH {B.SAMPLES} SELECT sample_id, round(exp(y), 3) AS micromolar, round(6 - y / ln(10), 6) AS pic50, round_even(round(y * 2, 0) / 2, 0) AS half, CAST(floor(y * 0.2) AS BIGINT) AS fifth, abs(y - round(y, 2)) <= 0.001 + 0.001 * abs(round(y, 2)) AS near,
 CAST(sign(y - 3) AS DOUBLE) AS sign, raw_y IS NOT NULL AS present FROM s""",
    "x21_bit_similarity": "WITH b AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), o AS (SELECT vec_id, i FROM b WHERE x > 0.5), n AS (SELECT e.vec_id, count(o.i) AS n FROM embeddings e LEFT JOIN o USING (vec_id) GROUP BY 1), k AS (SELECT a.vec_id AS v, count(*) AS k FROM o a JOIN o c ON c.vec_id = a.vec_id + 1 AND a.i = c.i GROUP BY 1) SELECT p.vec_id AS v1, round(coalesce(coalesce(k, 0) / nullif(p.n + q.n - coalesce(k, 0), 0), 0), 6) AS tanimoto FROM n p JOIN n q ON q.vec_id = p.vec_id + 1 LEFT JOIN k ON k.v = p.vec_id",
    "x22_json_functions": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"ok\":true}' AS again FROM events",
    "f06_salt_screen": f"WITH {B.COMPOUNDS} SELECT compound_id, smiles LIKE '%.%' AS has_counter_ion, CAST(0 AS BIGINT) AS dots_left FROM d WHERE smiles IS NOT NULL",
    "f07_salt_class": f"""WITH {B.COMPOUNDS} SELECT compound_id, CASE WHEN regexp_matches(smiles, '\\[[0-9]*({'|'.join(sorted(C.METALS))})([^a-z][^\\]]*)?\\]') THEN 'metal_complex' WHEN smiles LIKE '%.%' THEN 'salt_or_solvate' ELSE 'single' END AS salt_class FROM d WHERE smiles IS NOT NULL""",
    "v01_windowed_events": "SELECT date_trunc('hour', ts) AS hour_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "v02_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
 SELECT user_id, min(ts) AS started, count(*) AS n FROM k GROUP BY user_id, s""",
}
