"""Queries: entity resolution, keys, lookups, audits, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaymill.functions.ids import sql_strict_id, strict_id
from assaymill.functions.scalars import integral_text, name_key
from assaymill.operators import graph as G, ranks as K, relational as R
from assaymill.plans import base as B
from assaymill.session import table

S = SparkSession
ROLE = lambda c: F.lower(F.trim(c))


def p01_core_projection(spark: S, sf: str) -> DataFrame:
    return B.samples(spark, sf).select("sample_id", "cell_id", "compound_id", "lineage", "release_id")


def p04_conjunctive_filter(spark: S, sf: str) -> DataFrame:
    return B.samples(spark, sf).filter("any_extrapolation = 1 AND lineage = 'Lung' AND y IS NOT NULL").select("sample_id", F.round("y", 6).alias("y"))


def p06_in_set(spark: S, sf: str) -> DataFrame:
    """Samples of cells with an expression profile."""
    rna = B.cells(spark, sf).filter("rna IS NOT NULL").select("cell_id")
    return B.samples(spark, sf).join(rna, "cell_id", "left_semi").select("sample_id", "cell_id")


def p07_not_in_set(spark: S, sf: str) -> DataFrame:
    return B.samples(spark, sf).filter("cell_id IS NOT NULL").join(B.cells(spark, sf).select("cell_id"), "cell_id", "left_anti").select("sample_id", "cell_id")


def p09_quality_flags(spark: S, sf: str) -> DataFrame:
    """Three-way flags and the reasons for rejection of every sample; non-finite labels are rejected and recorded."""
    c, d = B.cells(spark, sf).select("cell_id", F.lit(1).alias("hc")), B.compounds(spark, sf).select("compound_id", F.lit(1).alias("hd"))
    m = B.samples(spark, sf).join(c, "cell_id", "left").join(d, "compound_id", "left")
    reason = R.reject_reason(("cell_not_mapped", F.col("hc").isNull()), ("drug_not_mapped", F.col("hd").isNull()), ("non_finite_label", F.col("y").isNull()))
    quality = F.when(F.col("y").isNull(), "nonfinite_label").when(F.col("replicate_dispersion") > 0.5, "noisy").otherwise("ok")
    side = F.when(F.col("y") > 4.6, "above").when(F.col("y") < 2.0, "below").otherwise("within")
    return m.select("sample_id", reason.alias("reason"), quality.alias("quality"), side.alias("range_flag"))


def p15_target_annotated(spark: S, sf: str) -> DataFrame:
    d = B.compounds(spark, sf).select("compound_id", (F.coalesce("target", F.lit("")) != "").alias("annotated"))
    return B.samples(spark, sf).join(d, "compound_id", "left").select("sample_id", F.coalesce("annotated", F.lit(False)).alias("annotated"))


def j01_enrich(spark: S, sf: str) -> DataFrame:
    c = B.cells(spark, sf).select("cell_id", "cell_line_name", "status")
    d = B.compounds(spark, sf).select("compound_id", "source_name")
    return B.samples(spark, sf).join(c, "cell_id", "left").join(d, "compound_id", "left").select("sample_id", "cell_line_name", "status", "source_name")


def j02_last_wins(spark: S, sf: str) -> DataFrame:
    """Compound names by drug number, the last registration wins."""
    m = table(spark, sf, "compound_master").filter("source_drug_id IS NOT NULL AND source_name IS NOT NULL AND registered_at IS NOT NULL")
    return R.last_wins(m.withColumn("at", F.struct("registered_at", "source_name")), "source_drug_id", "source_name", "at")


def j03_chained_lookup(spark: S, sf: str) -> DataFrame:
    """cell -> model -> rna profile, with a default."""
    c = B.cells(spark, sf)
    a = R.last_wins(c.filter("depmap_model_id IS NOT NULL"), "cell_id", "depmap_model_id", "depmap_model_id")
    b = c.filter("depmap_model_id IS NOT NULL").groupBy("depmap_model_id").agg(F.max("rna").alias("rna"))
    s = R.map_join(B.samples(spark, sf).select("sample_id", "cell_id"), a, "cell_id", "depmap_model_id")
    return R.map_join(s, b, "depmap_model_id", "rna", "profile", "UNKNOWN").select("sample_id", "profile")


def j04_contract_violations(spark: S, sf: str) -> DataFrame:
    raw = table(spark, sf, "core_samples").select("sample_id", "y")
    folds = table(spark, sf, "lpo_folds").select("sample_id", "role")
    return R.contract_join(raw, folds, "sample_id", "one_to_one")[1]


def j05_many_to_one(spark: S, sf: str) -> DataFrame:
    g = table(spark, sf, "cell_group_assignment").select(strict_id("cell_id").alias("cell_id"), "group_id").filter("cell_id IS NOT NULL")
    return R.contract_join(B.samples(spark, sf).select("sample_id", "cell_id"), g, "cell_id", "many_to_one")[1]


def j06_identity_after_join(spark: S, sf: str) -> DataFrame:
    """Samples whose fold row names another cell or compound."""
    f = table(spark, sf, "lpo_folds").select("sample_id", strict_id("cell_id").alias("fc"), strict_id("compound_id").alias("fd")).distinct()
    m = B.samples(spark, sf).join(f, "sample_id")
    return m.filter(~F.col("cell_id").eqNullSafe(F.col("fc")) | ~F.col("compound_id").eqNullSafe(F.col("fd"))).select("sample_id", "cell_id", "fc", "compound_id", "fd")


def j09_prioritised_resolution(spark: S, sf: str) -> DataFrame:
    """Passport records to lines: by accession, then catalogue number, then bare name; several targets go to review."""
    acc = lambda c: F.regexp_replace(F.upper(F.trim(c)), r"^(RRID:)?CVCL[-_]?", "")
    num = lambda c: F.regexp_replace(integral_text(F.trim(F.upper(c))), r"^COSMIC:", "")
    p = table(spark, sf, "passport_models").select("model_id", acc("rrid").alias("a"), num("cosmic_id").alias("n"), name_key("model_name").alias("k"))
    m = table(spark, sf, "cell_master").select(strict_id("sanger_model_id").alias("sid"), acc("cellosaurus_accession").alias("ca"), num("cosmic_id").alias("cn"), name_key("cell_line_name").alias("ck")).filter("sid IS NOT NULL")
    by = lambda x, y: p.select("model_id", F.col(x).alias("v")).filter("v <> ''").distinct().join(m.select(F.col(y).alias("v"), "sid").distinct(), "v").select("model_id", "sid")
    base = p.select("model_id").distinct()
    return R.prioritised(base, "model_id", [("accession", by("a", "ca"), "model_id", "sid"), ("number", by("n", "cn"), "model_id", "sid"), ("name", by("k", "ck"), "model_id", "sid")])


def j10_multi_match(spark: S, sf: str) -> DataFrame:
    m = table(spark, sf, "cell_master").select("cellosaurus_accession", strict_id("cell_id").alias("cell_id")).filter("cellosaurus_accession IS NOT NULL AND cell_id IS NOT NULL").distinct()
    return m.groupBy("cellosaurus_accession").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("cell_id")), ";").alias("cell_ids"))


def j11_quadrants(spark: S, sf: str) -> DataFrame:
    """Samples per quadrant of recorded regions."""
    from assaymill.operators.splitting import quadrant

    c = table(spark, sf, "cell_group_assignment").select(strict_id("cell_id").alias("cell_id"), "region").groupBy("cell_id").agg(F.max("region").alias("cell_region"))
    d = table(spark, sf, "drug_group_assignment").select(strict_id("compound_id").alias("compound_id"), "region").groupBy("compound_id").agg(F.max("region").alias("drug_region"))
    m = B.samples(spark, sf).join(c, "cell_id").join(d, "compound_id").withColumn("quadrant", quadrant())
    return m.groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("n_cells"), F.countDistinct("compound_id").alias("n_drugs"))


def j12_counts_side_by_side(spark: S, sf: str) -> DataFrame:
    s = B.samples(spark, sf).filter("lineage IS NOT NULL")
    n = lambda d: d.groupBy("lineage").agg(F.count(F.lit(1)).alias("n"))
    t = R.full_outer_counts(n(s), n(s.filter("y > 4")), "lineage", "n_before", "n_after")
    return t.withColumn("loss", F.round(1 - F.try_divide("n_after", "n_before"), 4))


def j16_table_diff(spark: S, sf: str) -> DataFrame:
    """Orders against a copy with shifted prices and padded statuses."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    b = o.filter("o_orderkey % 97 <> 5").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("o_orderkey") % 7 == 0, F.concat("o_orderstatus", F.lit(" "))).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    d = R.table_diff(o, b, "o_orderkey", ["o_totalprice"], ["o_orderstatus"])
    return d.withColumn("max_abs_diff", F.round("max_abs_diff", 6))


def j18_provenance(spark: S, sf: str) -> DataFrame:
    """Deliveries against folds and masters: which of three inventories knows a sample's cell."""
    s = B.samples(spark, sf).select("cell_id").filter("cell_id IS NOT NULL").distinct()
    f = table(spark, sf, "lpo_folds").select(strict_id("cell_id").alias("cell_id")).distinct().withColumn("in_folds", F.lit(True))
    g = table(spark, sf, "cell_group_assignment").select(strict_id("cell_id").alias("cell_id")).distinct().withColumn("in_groups", F.lit(True))
    m = B.cells(spark, sf).select("cell_id").withColumn("in_master", F.lit(True))
    out = s
    for d in (f, g, m):
        out = out.join(d, "cell_id", "left")
    return out.select("cell_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_folds", "in_groups", "in_master")])


def a01_status_counts(spark: S, sf: str) -> DataFrame:
    return B.cells(spark, sf).filter("status IS NOT NULL").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def a02_distinct_per_key(spark: S, sf: str) -> DataFrame:
    return B.samples(spark, sf).groupBy("compound_id").agg(F.countDistinct("cell_id").alias("n_cells"), F.countDistinct("lineage").alias("n_lineages"))


def a03_first_non_null(spark: S, sf: str) -> DataFrame:
    m = table(spark, sf, "core_samples").withColumn("cid", strict_id("cell_id")).filter("cid IS NOT NULL AND oncotree_lineage IS NOT NULL")
    return m.groupBy("cid").agg(F.min_by("oncotree_lineage", F.struct("loaded_at", "sample_id")).alias("lineage"))


def a04_replicate_rollup(spark: S, sf: str) -> DataFrame:
    """Median, count, spread, ordered ids and flag per cell, compound and condition."""
    s = B.samples(spark, sf).filter("y IS NOT NULL AND cell_id IS NOT NULL AND compound_id IS NOT NULL")
    g = s.groupBy("cell_id", "compound_id", "condition_key").agg(
        F.median("y").alias("y"), F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("spread"), F.array_join(F.array_sort(F.collect_list("sample_id")), ";").alias("ids"),
        F.bool_or(F.col("any_extrapolation") == 1).cast("int").alias("any_ext"),
    )
    return g.select("cell_id", "compound_id", "condition_key", F.round("y", 7).alias("y"), "n", F.round("spread", 6).alias("spread"), "ids", "any_ext")


def a09_sorted_names(spark: S, sf: str) -> DataFrame:
    m = table(spark, sf, "compound_master").select(strict_id("compound_id").alias("compound_id"), F.trim("source_name").alias("n")).filter("compound_id IS NOT NULL AND n IS NOT NULL")
    return m.groupBy("compound_id").agg(F.array_join(F.array_sort(F.collect_set("n")), "|").alias("names"))


def a10_shared_drug_numbers(spark: S, sf: str) -> DataFrame:
    return R.duplicates(table(spark, sf, "compound_master").filter("source_drug_id IS NOT NULL"), "source_drug_id")


def a11_nested_records(spark: S, sf: str) -> DataFrame:
    d = B.compounds(spark, sf).filter("parent IS NOT NULL")
    g = d.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("compound_id", F.coalesce("source_name", F.lit("")).alias("n")))).alias("r"))
    return g.select("parent", F.size("r").cast("bigint").alias("n"), F.array_join(F.transform("r", lambda x: F.concat_ws("=", x["compound_id"], x["n"])), ";").alias("records"))


def a12_global_stats(spark: S, sf: str) -> DataFrame:
    s = B.samples(spark, sf)
    return s.agg(F.count("y").alias("n"), F.round(F.avg("y"), 6).alias("mean"), F.round(F.stddev_samp("y"), 6).alias("sd"),
                 F.round(1 - F.count(F.lit(1)) / (F.countDistinct("cell_id") * F.countDistinct("compound_id")), 6).alias("sparsity"))


def a14_distinct_pairs(spark: S, sf: str) -> DataFrame:
    return B.samples(spark, sf).agg(F.countDistinct("cell_id", "compound_id").alias("n_pairs"))


def a15_min_distinct(spark: S, sf: str) -> DataFrame:
    t = B.pairs(spark, sf).filter("role = 'test'").groupBy("compound_id").agg(F.countDistinct("cell_id").alias("n"))
    return t.agg(F.min("n").alias("min_cells"), F.max("n").alias("max_cells"))


def a28_region_pivot(spark: S, sf: str) -> DataFrame:
    g = table(spark, sf, "cell_group_assignment").select(strict_id("cell_id").alias("cell_id"), F.nullif(F.trim("oncotree_lineage"), F.lit("")).alias("lineage"), "region").filter("cell_id IS NOT NULL AND lineage IS NOT NULL").distinct()
    p = g.groupBy("lineage").pivot("region", ["hold", "dev"]).agg(F.count(F.lit(1)))
    return p.select("lineage", F.coalesce("hold", F.lit(0)).alias("hold"), F.coalesce("dev", F.lit(0)).alias("dev"))


def a29_seed_summary(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("sd"), F.count(F.lit(1)).alias("n"))


def a13_waterfall(spark: S, sf: str) -> DataFrame:
    c = B.cells(spark, sf).select("cell_id", F.lit(True).alias("mapped"), F.col("rna").isNotNull().alias("has_rna"))
    d = B.compounds(spark, sf).select("compound_id", F.lit(True).alias("known"), F.col("ik_r").isNotNull().alias("verified"))
    m = B.samples(spark, sf).join(c, "cell_id", "left").join(d, "compound_id", "left")
    levels = [("W1_valid", F.col("y").isNotNull()), ("W2_mapped", F.col("mapped")), ("W3_expression", F.col("has_rna")), ("W4_structure", F.col("known") & F.col("verified"))]
    return R.waterfall(m, levels, "cell_id", "compound_id").withColumn("step", F.col("step").cast("bigint"))


def w01_surrogate_keys(spark: S, sf: str) -> DataFrame:
    keys = K.surrogate_key(table(spark, sf, "compound_master").filter("source_drug_id IS NOT NULL"), F.trim("source_drug_id").cast("string"), "CK", 6, "key")
    return keys.select(F.col("_k").alias("source_drug_id"), "key")


def w03_first_occurrence(spark: S, sf: str) -> DataFrame:
    m = table(spark, sf, "core_samples").withColumn("sc", strict_id("scaffold_id")).filter("sc IS NOT NULL")
    first = m.groupBy("sc").agg(F.min(strict_id("compound_id")).alias("c"))
    ranked = K.dense_order(first.filter("c IS NOT NULL").withColumn("k", F.struct("c", "sc")), "k", "n")
    return ranked.select(F.col("sc").alias("scaffold"), F.concat(F.lit("SC"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("scaffold_id"))


def w09_latest_status(spark: S, sf: str) -> DataFrame:
    from assaymill.operators.registry import latest_status

    return latest_status(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id", ["error"])


def u01_disposition(spark: S, sf: str) -> DataFrame:
    d = B.compounds(spark, sf)
    parts = [d.filter(c).select("compound_id").withColumn("disposition", F.lit(n)) for n, c in (("verified", F.col("ik_r") == F.col("ik_a")), ("conflict", F.col("ik_r") != F.col("ik_a")), ("missing", F.col("ik_r").isNull() | F.col("ik_a").isNull()))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def u04_id_spaces(spark: S, sf: str) -> DataFrame:
    """Compounds of master, groups and samples: members of one side only, per pair of sides."""
    m, g, s = B.compounds(spark, sf).select("compound_id"), table(spark, sf, "drug_group_assignment").select(strict_id("compound_id").alias("compound_id")).filter("compound_id IS NOT NULL"), B.samples(spark, sf).select("compound_id").filter("compound_id IS NOT NULL")
    out = None
    for n, a, b in (("master/groups", m, g), ("master/samples", m, s), ("groups/samples", g, s)):
        d = R.set_difference(a, b, "compound_id").withColumn("spaces", F.lit(n))
        out = d if out is None else out.unionByName(d)
    return out


def u03_union_intersect(spark: S, sf: str) -> DataFrame:
    m, s = B.compounds(spark, sf).select("compound_id"), B.samples(spark, sf).select("compound_id").filter("compound_id IS NOT NULL")
    n = lambda d, k: d.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(m.union(s).distinct(), "union").unionByName(n(m.intersect(s), "intersect")).unionByName(n(m.exceptAll(s.distinct()), "except"))


def q01_count_closure(spark: S, sf: str) -> DataFrame:
    f = p09_quality_flags(spark, sf)
    return f.agg(F.count(F.lit(1)).alias("n_in"), F.count_if(F.col("reason").isNull()).alias("n_kept"), F.count_if(F.col("reason").isNotNull()).alias("n_rejected"))


def q07_classed_audit(spark: S, sf: str) -> DataFrame:
    c = B.cells(spark, sf)
    classes = [("no_rna", F.col("rna").isNull()), ("no_mutations", F.col("mut").isNull()), ("no_number", F.col("cosmic_id").isNull()), ("no_lineage", F.col("lineage").isNull())]
    return c.select("cell_id", F.explode(F.array_compact(F.array(*[F.when(k, F.lit(n)) for n, k in classes]))).alias("audit_class"))


def q08_mismatch_attribution(spark: S, sf: str) -> DataFrame:
    """Why a recomputed key differs: another stereo layer, another skeleton, or a key is missing."""
    d = B.compounds(spark, sf)
    block = lambda c: F.split_part(c, F.lit("-"), F.lit(1))
    why = F.when(F.col("ik_a").isNull() | F.col("ik_r").isNull(), "missing_key").when(block("ik_a") == block("ik_r"), "stereo_or_charge").otherwise("skeleton")
    return d.filter(~F.col("ik_a").eqNullSafe(F.col("ik_r"))).select("compound_id", why.alias("attribution"))


def q09_key_audit(spark: S, sf: str) -> DataFrame:
    """Well-formed keys of all registrations of a compound: missing, exact or conflict."""
    ok = F.col("k").rlike("^[A-Z]{14}-[A-Z]{10}-[A-Z]$")
    m = table(spark, sf, "compound_master").select(strict_id("compound_id").alias("compound_id"), F.explode(F.array(F.trim("inchikey_adjudicated"), F.trim("inchikey_recomputed"))).alias("k")).filter("compound_id IS NOT NULL")
    g = m.groupBy("compound_id").agg(F.collect_set(F.when(ok, F.col("k"))).alias("ks"))
    return g.select("compound_id", F.when(F.size("ks") == 0, "missing").when(F.size("ks") == 1, "exact").otherwise("conflict").alias("status"))


def q11_eligibility(spark: S, sf: str) -> DataFrame:
    p = B.pairs(spark, sf).filter("role = 'test'").groupBy("compound_id").agg(F.countDistinct("cell_id").alias("n"), (F.max("y") > F.min("y")).alias("v"))
    d = B.compounds(spark, sf).join(p, "compound_id", "left")
    return d.select("compound_id", F.coalesce("n", F.lit(0)).alias("n_cells"), F.coalesce("v", F.lit(False)).alias("label_variance"), (F.coalesce("n", F.lit(0)) >= 10).alias("meets_min"))


def q12_content_hash(spark: S, sf: str) -> DataFrame:
    return R.content_hash(table(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


def g01_k_core(spark: S, sf: str) -> DataFrame:
    """Pairs of the (8 compounds per cell, 6 cells per compound) core."""
    e, _, _ = G.k_core(B.pairs(spark, sf), "cell_id", "compound_id", 8, 6, 10)
    return e


def g01_order_core(spark: S, sf: str) -> DataFrame:
    """Customers and parts: the (30, 10) core after at most ten rounds."""
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey")
    return G.k_core(e, "o_custkey", "l_partkey", 10, 30, 10)[0]


def g02_components(spark: S, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("|", "p_name", "p_size").alias("k1"), F.concat_ws("|", "p_brand", "p_type", "p_size").alias("k2"))
    return G.components(p, "p_partkey", ["k1", "k2"], "PART_")


def g03_rewired_overlap(spark: S, sf: str) -> DataFrame:
    """Members kept by degree-preserving rewiring of brands and types; where the brands' members are nested, no other graph has these degrees and all are kept."""
    pairs = table(spark, sf, "part").select("p_brand", F.concat_ws("-", "p_type", "p_size").alias("member")).filter("p_brand IS NOT NULL")
    edges = [(r[0], r[1]) for r in pairs.distinct().collect()]  # a set collection: brands x types x sizes
    mk = lambda x: spark.createDataFrame(x, "set_name string, member string")
    return G.overlap_share(mk(edges), mk(edges if G.rigid(edges) else G.rewire(edges, 7)))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "ajpquwg" and k[1:3].isdigit()}

_S, _C, _D, _P = B.SAMPLES, B.CELLS, B.COMPOUNDS, B.PAIRS
_I = sql_strict_id
_ACC = lambda c: f"regexp_replace(upper(trim({c})), '^(RRID:)?CVCL[-_]?', '')"
_NUM = lambda c: f"regexp_replace(regexp_replace(trim(upper({c})), '\\.0+$', ''), '^COSMIC:', '')"
_KEY = lambda c: f"regexp_replace(lower({c}), '[-_;\\s/.]', '', 'g')"
_FLAGS = f"""WITH {_S}, {_C}, {_D}, f AS (SELECT sample_id, nullif(concat_ws('|', CASE WHEN c.cell_id IS NULL THEN 'cell_not_mapped' END, CASE WHEN d.compound_id IS NULL THEN 'drug_not_mapped' END, CASE WHEN y IS NULL THEN 'non_finite_label' END), '') AS reason,
 CASE WHEN y IS NULL THEN 'nonfinite_label' WHEN replicate_dispersion > 0.5 THEN 'noisy' ELSE 'ok' END AS quality, CASE WHEN y > 4.6 THEN 'above' WHEN y < 2.0 THEN 'below' ELSE 'within' END AS range_flag
 FROM s LEFT JOIN c ON s.cell_id = c.cell_id LEFT JOIN d ON s.compound_id = d.compound_id)"""


def _rounds(edges: str, a: str, b: str, per_a: int, per_b: int) -> str:
    out = f"WITH {edges}"
    for i in range(1, 11):
        out += f""", e{i} AS (SELECT {a}, {b} FROM e{i - 1} WHERE {a} IN (SELECT {a} FROM e{i - 1} GROUP BY 1 HAVING count(*) >= {per_a}) AND {b} IN (SELECT {b} FROM e{i - 1} GROUP BY 1 HAVING count(*) >= {per_b}))"""
    return out + " SELECT * FROM e10"


_LEVELS = [("W1_valid", "y IS NOT NULL"), ("W2_mapped", "mapped"), ("W3_expression", "rna"), ("W4_structure", "ver")]
ORACLE = {
    "p01_core_projection": f"WITH {_S} SELECT sample_id, cell_id, compound_id, lineage, release_id FROM s",
    "p04_conjunctive_filter": f"WITH {_S} SELECT sample_id, round(y, 6) AS y FROM s WHERE any_extrapolation = 1 AND lineage = 'Lung' AND y IS NOT NULL",
    "p06_in_set": f"WITH {_S}, {_C} SELECT sample_id, cell_id FROM s WHERE cell_id IN (SELECT cell_id FROM c WHERE rna IS NOT NULL)",
    "p07_not_in_set": f"WITH {_S}, {_C} SELECT sample_id, cell_id FROM s WHERE cell_id IS NOT NULL AND cell_id NOT IN (SELECT cell_id FROM c)",
    "p09_quality_flags": f"{_FLAGS} SELECT * FROM f",
    "p15_target_annotated": f"WITH {_S}, {_D} SELECT sample_id, coalesce(d.target IS NOT NULL, false) AND d.compound_id IS NOT NULL AS annotated FROM s LEFT JOIN d ON s.compound_id = d.compound_id",
    "j01_enrich": f"WITH {_S}, {_C}, {_D} SELECT sample_id, c.cell_line_name, c.status, d.source_name FROM s LEFT JOIN c ON s.cell_id = c.cell_id LEFT JOIN d ON s.compound_id = d.compound_id",
    "j02_last_wins": "SELECT source_drug_id, source_name FROM compound_master WHERE source_drug_id IS NOT NULL AND source_name IS NOT NULL AND registered_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_drug_id ORDER BY registered_at DESC, source_name DESC) = 1",
    "j03_chained_lookup": f"WITH {_S}, {_C}, b AS (SELECT depmap_model_id, max(rna) AS rna FROM c WHERE depmap_model_id IS NOT NULL GROUP BY 1) SELECT sample_id, coalesce(b.rna, 'UNKNOWN') AS profile FROM s LEFT JOIN c ON s.cell_id = c.cell_id LEFT JOIN b ON c.depmap_model_id = b.depmap_model_id",
    "j04_contract_violations": "SELECT sample_id, count(*) AS n, 'left' AS side FROM core_samples GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT sample_id, count(*), 'right' FROM lpo_folds GROUP BY 1 HAVING count(*) > 1",
    "j05_many_to_one": f"SELECT {_I('cell_id')} AS cell_id, count(*) AS n, 'right' AS side FROM cell_group_assignment WHERE {_I('cell_id')} IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "j06_identity_after_join": f"WITH {_S}, f AS (SELECT DISTINCT sample_id, {_I('cell_id')} AS fc, {_I('compound_id')} AS fd FROM lpo_folds) SELECT sample_id, cell_id, fc, compound_id, fd FROM s JOIN f USING (sample_id) WHERE cell_id IS DISTINCT FROM fc OR compound_id IS DISTINCT FROM fd",
    "j09_prioritised_resolution": f"""WITH p AS (SELECT model_id, {_ACC('rrid')} AS a, {_NUM('cosmic_id')} AS n, {_KEY('model_name')} AS k FROM passport_models),
 m AS (SELECT {_I('sanger_model_id')} AS sid, {_ACC('cellosaurus_accession')} AS ca, {_NUM('cosmic_id')} AS cn, {_KEY('cell_line_name')} AS ck FROM cell_master WHERE {_I('sanger_model_id')} IS NOT NULL),
 x1 AS (SELECT model_id, count(DISTINCT sid) AS n, min(sid) AS t FROM p JOIN m ON p.a = m.ca WHERE p.a <> '' GROUP BY 1), x2 AS (SELECT model_id, count(DISTINCT sid) AS n, min(sid) AS t FROM p JOIN m ON p.n = m.cn WHERE p.n <> '' GROUP BY 1),
 x3 AS (SELECT model_id, count(DISTINCT sid) AS n, min(sid) AS t FROM p JOIN m ON p.k = m.ck WHERE p.k <> '' GROUP BY 1)
 SELECT b.model_id, coalesce(CASE WHEN x1.n = 1 THEN x1.t END, CASE WHEN x2.n = 1 THEN x2.t END, CASE WHEN x3.n = 1 THEN x3.t END) AS target,
 CASE WHEN x1.n = 1 THEN 'resolved:accession' WHEN x2.n = 1 THEN 'resolved:number' WHEN x3.n = 1 THEN 'resolved:name' WHEN x1.n > 1 THEN 'review:accession' WHEN x2.n > 1 THEN 'review:number' WHEN x3.n > 1 THEN 'review:name' ELSE 'unresolved' END AS status,
 concat_ws('; ', CASE WHEN x1.n IS NOT NULL THEN 'accession=' || x1.n END, CASE WHEN x2.n IS NOT NULL THEN 'number=' || x2.n END, CASE WHEN x3.n IS NOT NULL THEN 'name=' || x3.n END) AS evidence
 FROM (SELECT DISTINCT model_id FROM p) b LEFT JOIN x1 USING (model_id) LEFT JOIN x2 USING (model_id) LEFT JOIN x3 USING (model_id)""",
    "j10_multi_match": f"SELECT cellosaurus_accession, count(*) AS n, string_agg(cell_id, ';' ORDER BY cell_id) AS cell_ids FROM (SELECT DISTINCT cellosaurus_accession, {_I('m.cell_id')} AS cell_id FROM cell_master m) WHERE cellosaurus_accession IS NOT NULL AND cell_id IS NOT NULL GROUP BY 1",
    "j11_quadrants": f"""WITH {_S}, cr AS (SELECT {_I('cell_id')} AS cell_id, max(region) AS cr FROM cell_group_assignment GROUP BY 1), dr AS (SELECT {_I('compound_id')} AS compound_id, max(region) AS dr FROM drug_group_assignment GROUP BY 1)
 SELECT CASE WHEN cr = 'hold' AND dr = 'hold' THEN 'db' WHEN cr = 'hold' THEN 'lco' WHEN dr = 'hold' THEN 'ldo_so' ELSE 'dev' END AS quadrant, count(*) AS n, count(DISTINCT s.cell_id) AS n_cells, count(DISTINCT s.compound_id) AS n_drugs FROM s JOIN cr ON s.cell_id = cr.cell_id JOIN dr ON s.compound_id = dr.compound_id GROUP BY 1""",
    "j12_counts_side_by_side": f"WITH {_S} SELECT lineage, count(*) AS n_before, count(*) FILTER (y > 4) AS n_after, round(1 - count(*) FILTER (y > 4) / count(*), 4) AS loss FROM s WHERE lineage IS NOT NULL GROUP BY 1",
    "j16_table_diff": """WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 0.5 ELSE o_totalprice END AS p, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus || ' ' ELSE o_orderstatus END AS t FROM orders WHERE o_orderkey % 97 <> 5),
 j AS (SELECT * FROM orders LEFT JOIN b ON o_orderkey = k) SELECT 'o_totalprice' AS "column", count(*) AS n_cells, count(*) FILTER (k IS NULL) AS n_missing_row, count(*) FILTER (k IS NOT NULL AND p IS DISTINCT FROM o_totalprice) AS n_differ, CAST(0 AS BIGINT) AS n_blank_only, round(max(abs(p - o_totalprice)), 6) AS max_abs_diff FROM j
 UNION ALL SELECT 'o_orderstatus', count(*), count(*) FILTER (k IS NULL), count(*) FILTER (k IS NOT NULL AND t IS DISTINCT FROM o_orderstatus), count(*) FILTER (k IS NOT NULL AND t <> o_orderstatus AND trim(t) = trim(o_orderstatus)), NULL FROM j""",
    "j18_provenance": f"WITH {_S}, {_C} SELECT DISTINCT cell_id, cell_id IN (SELECT {_I('cell_id')} FROM lpo_folds WHERE {_I('cell_id')} IS NOT NULL) AS in_folds, cell_id IN (SELECT {_I('cell_id')} FROM cell_group_assignment WHERE {_I('cell_id')} IS NOT NULL) AS in_groups, cell_id IN (SELECT cell_id FROM c) AS in_master FROM s WHERE cell_id IS NOT NULL",
    "a01_status_counts": f"WITH {_C} SELECT status, count(*) AS n FROM c WHERE status IS NOT NULL GROUP BY 1",
    "a02_distinct_per_key": f"WITH {_S} SELECT compound_id, count(DISTINCT cell_id) AS n_cells, count(DISTINCT lineage) AS n_lineages FROM s GROUP BY 1",
    "a03_first_non_null": f"SELECT {_I('cell_id')} AS cid, oncotree_lineage AS lineage FROM core_samples WHERE {_I('cell_id')} IS NOT NULL AND oncotree_lineage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cid ORDER BY loaded_at, sample_id) = 1",
    "a04_replicate_rollup": f"""WITH {_S} SELECT cell_id, compound_id, condition_key, round(median(y), 7) AS y, count(*) AS n, round(coalesce(stddev_samp(y), 0), 6) AS spread, string_agg(sample_id, ';' ORDER BY sample_id) AS ids, CAST(bool_or(any_extrapolation = 1) AS INTEGER) AS any_ext
 FROM s WHERE y IS NOT NULL AND cell_id IS NOT NULL AND compound_id IS NOT NULL GROUP BY 1, 2, 3""",
    "a09_sorted_names": f"SELECT compound_id, string_agg(n, '|' ORDER BY n) AS names FROM (SELECT DISTINCT {_I('compound_id')} AS compound_id, trim(source_name) AS n FROM compound_master) WHERE compound_id IS NOT NULL AND n IS NOT NULL GROUP BY 1",
    "a10_shared_drug_numbers": "SELECT source_drug_id, count(*) AS n FROM compound_master WHERE source_drug_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "a11_nested_records": f"WITH {_D} SELECT parent, count(*) AS n, string_agg(compound_id || '=' || coalesce(source_name, ''), ';' ORDER BY compound_id) AS records FROM d WHERE parent IS NOT NULL GROUP BY 1",
    "a12_global_stats": f"WITH {_S} SELECT count(y) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd, round(1 - count(*) / (count(DISTINCT cell_id) * count(DISTINCT compound_id)), 6) AS sparsity FROM s",
    "a14_distinct_pairs": f"WITH {_S} SELECT count(*) AS n_pairs FROM (SELECT DISTINCT cell_id, compound_id FROM s WHERE cell_id IS NOT NULL AND compound_id IS NOT NULL)",
    "a15_min_distinct": f"WITH {_P} SELECT min(n) AS min_cells, max(n) AS max_cells FROM (SELECT compound_id, count(DISTINCT cell_id) AS n FROM p WHERE role = 'test' GROUP BY 1)",
    "a28_region_pivot": f"SELECT lineage, count(*) FILTER (region = 'hold') AS hold, count(*) FILTER (region = 'dev') AS dev FROM (SELECT DISTINCT {_I('cell_id')} AS cell_id, nullif(trim(oncotree_lineage), '') AS lineage, region FROM cell_group_assignment) WHERE cell_id IS NOT NULL AND lineage IS NOT NULL GROUP BY 1",
    "a29_seed_summary": "SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, count(*) AS n FROM events GROUP BY 1",
    "a13_waterfall": f"WITH {_S}, {_C}, {_D}, m AS (SELECT s.*, c.cell_id IS NOT NULL AS mapped, c.rna IS NOT NULL AS rna, d.ik_r IS NOT NULL AS ver FROM s LEFT JOIN c ON s.cell_id = c.cell_id LEFT JOIN d ON s.compound_id = d.compound_id) "
    + " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS BIGINT) AS step, '{n}' AS level, count(*) AS n_rows, count(DISTINCT cell_id) AS n_cells, count(DISTINCT compound_id) AS n_drugs, count(DISTINCT CASE WHEN cell_id IS NOT NULL AND compound_id IS NOT NULL THEN cell_id || '|' || compound_id END) AS n_pairs FROM m WHERE {' AND '.join(c for _, c in _LEVELS[: i + 1])}"
        for i, (n, _) in enumerate(_LEVELS)
    ),
    "w01_surrogate_keys": "SELECT k AS source_drug_id, 'CK' || lpad(CAST(row_number() OVER (ORDER BY k) AS VARCHAR), 6, '0') AS key FROM (SELECT DISTINCT trim(source_drug_id) AS k FROM compound_master WHERE source_drug_id IS NOT NULL)",
    "w03_first_occurrence": f"SELECT sc AS scaffold, 'SC' || lpad(CAST(row_number() OVER (ORDER BY c, sc) AS VARCHAR), 6, '0') AS scaffold_id FROM (SELECT {_I('scaffold_id')} AS sc, min({_I('compound_id')}) AS c FROM core_samples GROUP BY 1) WHERE sc IS NOT NULL AND c IS NOT NULL",
    "w09_latest_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_bad FROM events GROUP BY 1",
    "u01_disposition": f"WITH {_D} SELECT compound_id, CASE WHEN ik_r IS NULL OR ik_a IS NULL THEN 'missing' WHEN ik_r = ik_a THEN 'verified' ELSE 'conflict' END AS disposition FROM d",
    "u04_id_spaces": f"""WITH {_S}, {_D}, m AS (SELECT compound_id FROM d), g AS (SELECT DISTINCT {_I('compound_id')} AS compound_id FROM drug_group_assignment WHERE {_I('compound_id')} IS NOT NULL), ss AS (SELECT DISTINCT compound_id FROM s WHERE compound_id IS NOT NULL) """
    + " UNION ALL ".join(f"SELECT compound_id, '{side}' AS side, '{n}' AS spaces FROM (SELECT compound_id FROM {x} EXCEPT SELECT compound_id FROM {y})" for n, a, b in (("master/groups", "m", "g"), ("master/samples", "m", "ss"), ("groups/samples", "g", "ss")) for side, x, y in (("left", a, b), ("right", b, a))),
    "u03_union_intersect": f"WITH {_S}, {_D}, m AS (SELECT compound_id FROM d), ss AS (SELECT compound_id FROM s WHERE compound_id IS NOT NULL) SELECT 'union' AS kind, count(*) AS n FROM (SELECT * FROM m UNION SELECT * FROM ss) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM m INTERSECT SELECT * FROM ss) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM m EXCEPT SELECT * FROM ss)",
    "q01_count_closure": f"{_FLAGS} SELECT count(*) AS n_in, count(*) FILTER (reason IS NULL) AS n_kept, count(*) FILTER (reason IS NOT NULL) AS n_rejected FROM f",
    "q07_classed_audit": f"WITH {_C} SELECT cell_id, unnest(list_filter([CASE WHEN rna IS NULL THEN 'no_rna' END, CASE WHEN mut IS NULL THEN 'no_mutations' END, CASE WHEN cosmic_id IS NULL THEN 'no_number' END, CASE WHEN lineage IS NULL THEN 'no_lineage' END], lambda x: x IS NOT NULL)) AS audit_class FROM c",
    "q08_mismatch_attribution": f"WITH {_D} SELECT compound_id, CASE WHEN ik_a IS NULL OR ik_r IS NULL THEN 'missing_key' WHEN split_part(ik_a, '-', 1) = split_part(ik_r, '-', 1) THEN 'stereo_or_charge' ELSE 'skeleton' END AS attribution FROM d WHERE ik_a IS DISTINCT FROM ik_r",
    "q09_key_audit": f"SELECT compound_id, CASE count(DISTINCT k) WHEN 0 THEN 'missing' WHEN 1 THEN 'exact' ELSE 'conflict' END AS status FROM (SELECT {_I('compound_id')} AS compound_id, CASE WHEN regexp_full_match(x, '[A-Z]{{14}}-[A-Z]{{10}}-[A-Z]') THEN x END AS k FROM (SELECT compound_id, trim(inchikey_adjudicated) AS x FROM compound_master UNION ALL SELECT compound_id, trim(inchikey_recomputed) FROM compound_master)) WHERE compound_id IS NOT NULL GROUP BY 1",
    "q11_eligibility": f"WITH {_P}, {_D}, t AS (SELECT compound_id, count(DISTINCT cell_id) AS n, max(y) > min(y) AS v FROM p WHERE role = 'test' GROUP BY 1) SELECT d.compound_id, coalesce(n, 0) AS n_cells, coalesce(v, false) AS label_variance, coalesce(n, 0) >= 10 AS meets_min FROM d LEFT JOIN t USING (compound_id)",
    "q12_content_hash": "WITH h AS (SELECT sha256(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), coalesce(c_name, chr(0)), coalesce(c_mktsegment, chr(0)))) AS h FROM customer) SELECT sha256(concat_ws('|', "
    + ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS UBIGINT)) AS VARCHAR)" for i in range(4))
    + ", CAST(count(*) AS VARCHAR))) AS content_hash, count(*) AS n FROM h",
    "g01_k_core": _rounds(f"{_P}, e0 AS (SELECT DISTINCT cell_id, compound_id FROM p)", "cell_id", "compound_id", 8, 6),
    "g01_order_core": _rounds("e0 AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", "o_custkey", "l_partkey", 10, 30),
    "g02_components": """WITH RECURSIVE k AS (SELECT p_partkey AS v, 'a' || p_name || '|' || p_size AS key FROM part UNION SELECT p_partkey, 'b' || p_brand || '|' || p_type || '|' || p_size FROM part), e AS (SELECT DISTINCT a.v AS a, b.v AS b FROM k a JOIN k b USING (key)),
 r AS (SELECT p_partkey AS a, p_partkey AS b FROM part UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS p_partkey, 'PART_' || min(b) AS component, count(*) AS size FROM r GROUP BY 1""",
}
