"""Queries: feature statistics, set scores, similarities, splits and their audit, baselines, selection, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaymill.functions import scalars as X
from assaymill.functions.ids import loose_id, sql_loose_id, sql_strict_id, strict_id
from assaymill.operators import features as E, models as L, registry as G, splitting as P
from assaymill.plans import base as B
from assaymill.session import settle, shared_dir, table

S = SparkSession
R6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


def _long(spark: S, sf: str) -> DataFrame:
    """Embeddings as an expression matrix with holes (every element whose id and position sum to a multiple of 17)."""
    m = E.long_matrix(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return m.withColumn("x", F.when((F.col("vec_id") + F.col("pos")) % 17 != 0, F.col("x")))


def _folds(spark: S, sf: str) -> DataFrame:
    """Every entity in every fold: test where its number lies in the fold."""
    return _long(spark, sf).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("is_test", F.col("vec_id") % 5 == F.col("fold"))


def a24_column_statistics(spark: S, sf: str) -> DataFrame:
    s = E.fit(_long(spark, sf), "vec_id")
    return s.select("pos", "kept", *R6("missing", "median", "mean", "variance", "sd"))


def f01_fit_all_folds(spark: S, sf: str) -> DataFrame:
    hole = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 17 != 0, x.cast("double")))
    v = table(spark, sf, "embeddings").select("vec_id", hole.alias("values"), (F.col("vec_id") % 5).alias("test_fold"))
    return E.fit_matrix(v, "vec_id", "values", "test_fold", 5, top=20).select("fold", "pos", "selected", *R6("median", "mean", "sd"))


def f02_transform_test_rows(spark: S, sf: str) -> DataFrame:
    m = _folds(spark, sf)
    state = settle(E.fit(m.filter("NOT is_test").select("fold", "vec_id", "pos", "x"), "vec_id", ["fold"], top=20))
    z = E.transform(m.filter("is_test").select("fold", "vec_id", "pos", "x"), state, ["fold"])
    return z.select("fold", "vec_id", "pos", F.round("z", 5).alias("z"))


def f03_missing_mask(spark: S, sf: str) -> DataFrame:
    return _long(spark, sf).groupBy("vec_id").agg(F.count_if(F.col("x").isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n"))


def _sets(spark: S) -> DataFrame:
    """Sixteen overlapping sets of positions: residues modulo 8 and modulo 5, and three larger unions."""
    return spark.createDataFrame(_SET_ROWS, "set_name string, member int")


_SET_ROWS = [(f"mod8_{k}", p) for k in range(8) for p in range(64) if p % 8 == k] + [(f"mod5_{k}", p) for k in range(5) for p in range(64) if p % 5 == k] + [(f"low_{k}", p) for k in (3, 9, 40) for p in range(k)]


_SETS = " UNION ALL ".join([
    "SELECT 'mod8_' || (p % 8) AS set_name, p AS member FROM range(64) t(p)", "SELECT 'mod5_' || (p % 5), p FROM range(64) t(p)",
    *[f"SELECT 'low_{k}', p FROM range({k}) t(p)" for k in (3, 9, 40)],
])


def f11_set_coverage(spark: S, sf: str) -> DataFrame:
    measured = _long(spark, sf).filter("pos % 3 <> 0").select("pos").distinct()
    return E.set_coverage(_sets(spark), measured, 6)


def f12_set_scores(spark: S, sf: str) -> DataFrame:
    """Means of standardised members, standardised again by set."""
    m = _long(spark, sf)
    z = E.transform(m, settle(E.fit(m, "vec_id")))
    s = E.set_scores(z, _sets(spark), ["vec_id"])
    stats = s.groupBy("set_name").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"))
    return s.join(F.broadcast(stats), "set_name").select("vec_id", "set_name", F.round((F.col("score") - F.col("m")) / F.when(F.col("sd") > 1e-8, F.col("sd")).otherwise(1.0), 5).alias("score"))


def f14_intervention(spark: S, sf: str) -> DataFrame:
    """Set scores before and after zeroing one position: a caller's function on rows, then the same recomputation."""
    before = _long(spark, sf).withColumnRenamed("x", "z")
    knock = lambda d: d.withColumn("z", F.when(F.col("pos") == 8, F.lit(0.0)).otherwise(F.col("z")))
    a, b = (E.set_scores(d, _sets(spark), ["vec_id"], impute=False) for d in (before, knock(before)))
    met = a.withColumnRenamed("score", "before").join(b.withColumnRenamed("score", "after"), ["vec_id", "set_name"])
    return met.select("vec_id", "set_name", F.round("before", 5).alias("before"), F.round("after", 5).alias("after"))


def j15_set_overlap(spark: S, sf: str) -> DataFrame:
    return E.set_overlap(_sets(spark)).select("set_a", "set_b", "shared", *R6("jaccard"))


def f10_nearest_fingerprint(spark: S, sf: str) -> DataFrame:
    """Nearest other vector by the signs of the embeddings."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits"))
    return E.nearest_other(e, "vec_id", "bits").select("vec_id", "nearest", *R6("tanimoto"))


def x20_projection(spark: S, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    w = F.array(*[F.lit((i % 7 - 3) / 7.0) for i in range(64)])
    return e.select("vec_id", F.round(X.dot("embedding", w), 5).alias("projection"))


def _cell_vectors(spark: S, sf: str) -> DataFrame:
    """The embedding of every cell, by cell number."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("cell_vec"))
    n = e.count()
    c = B.cells(spark, sf).select("cell_id", (F.regexp_extract("cell_id", r"(\d+)$", 1).cast("bigint") % n).alias("vec_id"))
    return c.join(e, "vec_id").select("cell_id", "cell_vec")


def j14_knn_prediction(spark: S, sf: str) -> DataFrame:
    p = B.pairs(spark, sf).join(_cell_vectors(spark, sf), "cell_id")
    return E.neighbour_mean(p.filter("role = 'train'"), p.filter("role = 'test'").select("sample_id", "compound_id", "cell_vec"), "compound_id", "cell_vec", 3).select("sample_id", F.round(F.col("prediction") + 1e-9, 4).alias("prediction"))


def _drug_vector():
    return F.array((F.regexp_extract("compound_id", r"(\d+)$", 1).cast("double") % 11) / 10, F.length(F.coalesce("smiles", F.lit(""))).cast("double") / 50)


def f15_pair_features(spark: S, sf: str) -> DataFrame:
    drugs = B.compounds(spark, sf).select("compound_id", _drug_vector().alias("drug_vec"))
    return E.pair_features(B.pairs(spark, sf).select("sample_id", "cell_id", "compound_id", "y", "role"), _cell_vectors(spark, sf), drugs)


def f15_pair_feature_sums(spark: S, sf: str) -> DataFrame:
    f = f15_pair_features(spark, sf)
    return f.select("sample_id", F.size("features").cast("bigint").alias("n"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def m01_mean_baselines(spark: S, sf: str) -> DataFrame:
    p = B.pairs(spark, sf)
    t, q = p.filter("role = 'train'"), p.filter("role = 'test'").select("sample_id", "cell_id", "compound_id")
    out = L.mean_baseline(t, q, "cell_id").withColumnRenamed("y_pred", "by_cell")
    out = L.mean_baseline(t, out, "compound_id").withColumnRenamed("y_pred", "by_drug")
    return L.mean_baseline(t, out, None).select("sample_id", F.round("by_cell", 4).alias("by_cell"), F.round("by_drug", 4).alias("by_drug"), F.round("y_pred", 4).alias("overall"))


def m02_two_way_additive(spark: S, sf: str) -> DataFrame:
    p = B.pairs(spark, sf)
    return L.two_way_additive(p.filter("role = 'train'"), p.filter("role = 'test'"), "compound_id", "cell_id").select("sample_id", *R6("y_pred"))


def m03_ridge(spark: S, sf: str) -> DataFrame:
    f = settle(f15_pair_features(spark, sf))
    return L.linear_predict(L.linear(f.filter("role = 'train'"), 1.0), f.filter("role = 'test'")).select("sample_id", F.round("y_pred", 5).alias("y_pred"))


def m04_elastic_net(spark: S, sf: str) -> DataFrame:
    f = settle(f15_pair_features(spark, sf))
    return L.linear_predict(L.linear(f.filter("role = 'train'"), 0.01, 0.5), f.filter("role = 'test'")).select("sample_id", F.round("y_pred", 5).alias("y_pred"))


VECTORS = 100_000  #: vectors up to which they are sent to the rows


def _slim_features(spark: S, sf: str):
    """(rows, attach): the pairs of ``f15_pair_features`` with their vector's number and the drug's vector instead of features, written; attach adds the features
    without moving a row, or is None where there are so many vectors that they had to be joined by a shuffle."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("cell_vec"))
    e = settle(e)  # read again by every scan
    n = e.count()
    if n > VECTORS:
        return settle(f15_pair_features(spark, sf)), None
    c = B.cells(spark, sf).select("cell_id", (F.regexp_extract("cell_id", r"(\d+)$", 1).cast("bigint") % n).alias("vec_id"))
    drugs = B.compounds(spark, sf).select("compound_id", _drug_vector().alias("drug_vec"))
    rows = B.pairs(spark, sf).select("sample_id", "cell_id", "compound_id", "y", "role").join(c, "cell_id").join(drugs, "compound_id")
    known = settle(rows.join(F.broadcast(e.select("vec_id")), "vec_id"))  # at most VECTORS rows, counted
    return known, lambda d: d.join(F.broadcast(e), "vec_id").withColumn("features", F.concat("cell_vec", "drug_vec")).drop("cell_vec", "drug_vec", "vec_id")


def m05_per_drug_elastic_net(spark: S, sf: str) -> DataFrame:
    f, attach = _slim_features(spark, sf)
    return L.per_group_elastic_net(f.filter("role = 'train'"), f.filter("role = 'test'"), "compound_id", 0.01, 0.5, attach=attach).select("sample_id", *R6("y_pred"))


def m06_forest(spark: S, sf: str) -> DataFrame:
    f = settle(f15_pair_features(spark, sf))
    m = L.forest(f.filter("role = 'train'"), share=1.0)
    return L.linear_predict(m, f.filter("role = 'test'")).select("sample_id", *R6("y_pred"))


def m09_factorisation(spark: S, sf: str) -> DataFrame:
    f, attach = _slim_features(spark, sf)
    model, test = L.factorisation(f.filter("role = 'train'"), attach=attach), f.filter("role = 'test'")
    return model.predict(attach(test) if attach else test).select("sample_id", *R6("y_pred"))


def m11_set_contributions(spark: S, sf: str) -> DataFrame:
    """Signed contributions of the cells' set scores to the predictions of test pairs, per pair and set, beside the compound's base."""
    v = _long(spark, sf).withColumnRenamed("x", "z")
    sc = E.set_scores(v, _sets(spark), ["vec_id"])
    n = table(spark, sf, "embeddings").count()
    x = sc.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("set_name", "score"))), lambda t: t["score"]).alias("features"))
    c = B.cells(spark, sf).select("cell_id", (F.regexp_extract("cell_id", r"(\d+)$", 1).cast("bigint") % n).alias("vec_id")).join(x, "vec_id").select("cell_id", "features")
    p = settle(B.pairs(spark, sf).select("sample_id", "cell_id", "compound_id", "y", "role").join(c, "cell_id"))
    names = F.array(*[F.lit(n) for n in sorted(set(r[0] for r in _SET_ROWS))])
    out = L.pathway_additive(p.filter("role = 'train'"), p.filter("role = 'test'"), "compound_id").withColumn("set_name", names)
    long = out.select("sample_id", "base", "y_pred", F.explode(F.arrays_zip("set_name", "contributions")).alias("x"))
    return long.select("sample_id", F.col("x.set_name").alias("set_name"), *R6("base", "y_pred"), F.round("x.contributions", 6).alias("contribution"))


def k11_reload_changes(spark: S, sf: str) -> DataFrame:
    """Predictions compared and those that a saved and reloaded model changes: none."""
    from pyspark.ml.functions import array_to_vector

    from assaymill.sources.sinks import reload_changes

    f = settle(f15_pair_features(spark, sf)).withColumn("features", array_to_vector("features"))
    from pyspark.ml.regression import LinearRegression

    model = LinearRegression(labelCol="y", regParam=0.1).fit(f)
    import uuid

    return reload_changes(model, f, f"{shared_dir(spark)}/model-{uuid.uuid4().hex}", "sample_id").agg(F.lit(f.count()).alias("n_compared"), F.count(F.lit(1)).alias("n_changed"))


def m14_guarded_selection(spark: S, sf: str) -> DataFrame:
    """Users as runs, their events as trials."""
    t = table(spark, sf, "events").select("user_id", F.col("event_id").alias("trial_no"), F.when(F.col("event_type") != "error", F.round(F.col("value") / 100, 6)).alias("macro"), F.round(1 + F.col("value") / 50, 6).alias("rmse"), F.lit(1.5).alias("baseline_rmse"))
    return L.select_trial(t, ["user_id"]).select("user_id", "trial_no", "eligible", "macro", "rmse")


def m16_contribution_mismatch(spark: S, sf: str) -> DataFrame:
    p = B.predictions(spark, sf).withColumns({"mu": F.lit(3.0), "b": F.col("y_a") - 3.0, "extra": F.when(F.col("ext") == 1, 0.001).otherwise(0.0)})
    return L.contribution_mismatch(p, ["mu", "b", "extra"], "y_a").select("sample_id")


def _grouped(spark: S, sf: str) -> DataFrame:
    g = table(spark, sf, "cell_group_assignment").select(strict_id("cell_id").alias("cell_id"), F.upper(F.trim("group_id")).alias("g")).filter("cell_id IS NOT NULL AND g <> ''").groupBy("cell_id").agg(F.min("g").alias("g"))
    s = B.samples(spark, sf).filter("y IS NOT NULL AND cell_id IS NOT NULL AND compound_id IS NOT NULL")
    return s.join(g, "cell_id", "left").withColumn("cell_group", F.coalesce("g", F.concat(F.lit("CG_"), "cell_id"))).drop("g")


def r01_hold_out(spark: S, sf: str) -> DataFrame:
    d = _grouped(spark, sf).withColumn("lineage", F.coalesce("lineage", F.lit("none")))
    return P.hold_out(d, "cell_group", "lineage", "cell_id")


def r02_group_folds(spark: S, sf: str) -> DataFrame:
    """Five grouped folds, summarised per fold."""
    d = settle(_grouped(spark, sf).select("sample_id", "cell_id", "compound_id", "cell_group", "lineage"))
    f = P.group_folds(d, "cell_group", "lineage").join(d.select("sample_id", "cell_id", "compound_id"), "sample_id")
    return f.groupBy("fold").agg(F.count_if(F.col("role") == "test").alias("n_test"), F.count_if(F.col("role") == "train").alias("n_train"), F.countDistinct(F.when(F.col("role") == "test", F.col("cell_group"))).alias("n_test_groups"))


def r04_pair_hold_out(spark: S, sf: str) -> DataFrame:
    p = P.pair_hold_out(B.pairs(spark, sf).drop("role"), ["cell_id", "compound_id"])
    return p.select("cell_id", "compound_id", "role")


def r08_inner_split(spark: S, sf: str) -> DataFrame:
    return P.inner_split(_grouped(spark, sf), ["cell_group"]).select("cell_group", "side").distinct()


def r09_label_permutation(spark: S, sf: str) -> DataFrame:
    """Labels permuted within their compounds."""
    p = B.pairs(spark, sf).select("sample_id", "compound_id", "y")
    return P.permute_labels(p, "compound_id", "sample_id", "y").select("sample_id", F.round(F.col("y") + 1e-7, 4).alias("y"))


def r10_learning_curve_subset(spark: S, sf: str) -> DataFrame:
    d = P.first_entities(P.first_entities(B.pairs(spark, sf), "cell_id", 0.5), "compound_id", 0.25)
    return d.select("sample_id")


ROLES = ("train", "validation", "test")


def _recorded(spark: S, sf: str, roles: tuple[str, ...]) -> DataFrame:
    """Recorded samples of these roles, with the pair of cell and compound."""
    f = table(spark, sf, "lpo_folds").select("sample_id", strict_id("cell_id").alias("cell_id"), strict_id("compound_id").alias("compound_id"), F.lower(F.trim("role")).alias("role")).filter(F.col("role").isin(*roles))
    return f.withColumn("pair", F.when(F.col("cell_id").isNotNull() & F.col("compound_id").isNotNull(), F.concat_ws("|", "cell_id", "compound_id")))


def q03_leakage_audit(spark: S, sf: str) -> DataFrame:
    """Violations of the recorded roles: samples, pairs, cells and compounds in more than one of train, validation and test."""
    return P.leakage_audit(_recorded(spark, sf, ROLES), ["sample_id", "pair", "cell_id", "compound_id"], [])


def q03_sealed_hold_out(spark: S, sf: str) -> DataFrame:
    """g2: cells and compounds of the recorded region of the groups that lie on the other side of it as well, per entity; g6: sizes of both sides of the quick fold."""
    c = table(spark, sf, "cell_group_assignment").select(F.lit("cell").alias("kind"), strict_id("cell_id").alias("e"), F.lower(F.trim("region")).alias("region"))
    d = table(spark, sf, "drug_group_assignment").select(F.lit("compound").alias("kind"), strict_id("compound_id").alias("e"), F.lower(F.trim("region")).alias("region"))
    both = c.unionByName(d).filter("e IS NOT NULL AND region <> ''").groupBy("kind", "e").agg(F.countDistinct("region").alias("n"))
    g2 = both.groupBy(F.concat("kind", F.lit("_in_both_regions")).alias("check")).agg(F.count_if(F.col("n") > 1).alias("n"))
    quick = _grouped(spark, sf)
    f = P.group_folds(quick, "cell_group", "lineage").filter("fold = 0").groupBy(F.concat(F.lit("quick_"), "role").alias("check")).agg(F.count(F.lit(1)).alias("n"))
    return g2.unionByName(f)


def _planted(f: DataFrame, sample: str = "sample_id") -> DataFrame:
    """The folds with the role of the smallest sample turned round in each: a violation that an audit must show."""
    least = F.broadcast(f.agg(F.min(sample).alias("_x")))  # one row
    return f.crossJoin(least).withColumn("role", F.when(F.col(sample) == F.col("_x"), F.when(F.col("role") == "test", "train").otherwise("test")).otherwise(F.col("role"))).drop("_x")


def audited(f: DataFrame, keys: list[str]) -> DataFrame:
    """(check, n_violations, n_planted): violations of the folds as they are, and with one planted per fold."""
    f = settle(f)
    return P.leakage_audit(f, keys, ["fold"]).join(P.leakage_audit(_planted(f), keys, ["fold"]).withColumnRenamed("n_violations", "n_planted"), "check")


def q03_fold_isolation(spark: S, sf: str) -> DataFrame:
    """Groups and cells divided by the folds built here: none, but one per fold where one is planted."""
    d = settle(_grouped(spark, sf).select("sample_id", "cell_id", "cell_group", "lineage"))
    return audited(P.group_folds(d, "cell_group", "lineage").join(d.select("sample_id", "cell_id"), "sample_id"), ["cell_group", "cell_id"])


def q04_order_invariance(spark: S, sf: str) -> DataFrame:
    """The fold of every group, built from rows in another order with permuted labels: its SQL twin builds it from the rows as they are."""
    d = P.permute_labels(_grouped(spark, sf), "compound_id", "sample_id", "y").repartition(7, F.xxhash64("sample_id"))
    f = P.group_folds(d, "cell_group", "lineage").filter("role = 'test'")
    return f.select("cell_group", F.col("fold").cast("bigint").alias("fold")).distinct()


def q05_thin_drugs(spark: S, sf: str) -> DataFrame:
    f = table(spark, sf, "lpo_folds").select("sample_id", strict_id("cell_id").alias("cell_id"), strict_id("compound_id").alias("compound_id"), F.lower(F.trim("role")).alias("role")).filter("compound_id IS NOT NULL").withColumn("fold", F.lit(0))
    return P.thin_drugs(f, 10, ["fold"])


def _chemical(spark: S, sf: str, roles: tuple[str, ...]) -> DataFrame:
    r = table(spark, sf, "lpo_folds").select("sample_id", F.lower(F.trim("role")).alias("role")).filter(F.col("role").isin(*roles)).distinct()
    return B.samples(spark, sf).select("sample_id", "compound_id", "parent", "scaffold").join(r, "sample_id")


def q06_chemical_isolation(spark: S, sf: str) -> DataFrame:
    """Parents, scaffolds and chemical groups that lie in more than one of the recorded roles."""
    g = table(spark, sf, "drug_group_assignment").select(strict_id("compound_id").alias("compound_id"), loose_id("chemical_group_id").alias("chemical_group"))
    g = g.filter("compound_id IS NOT NULL AND chemical_group IS NOT NULL").distinct()
    return P.leakage_audit(_chemical(spark, sf, ROLES).join(g, "compound_id", "left"), ["parent", "scaffold", "chemical_group"], [])


def _runs(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("model"), F.lit("lco").alias("protocol"), (F.col("user_id") % 7).cast("int").alias("seed"), F.round("value", 6).alias("macro"), F.hour("ts").alias("n_train"))


def q20_control_pairs(spark: S, sf: str) -> DataFrame:
    r = _runs(spark, sf).groupBy("model", "protocol", "seed").agg(F.max("macro").alias("macro"))
    extra = r.filter("seed = 3 AND model = 'view'")  # an ambiguous duplicate
    controls = spark.createDataFrame([("click", "view"), ("purchase", "click")], "model string, control string")
    return G.pair_controls(r.unionByName(extra), controls).select("model", "control", "protocol", "seed", F.round("macro", 6).alias("macro"), F.round("gain", 6).alias("gain"))


def q21_learning_curve(spark: S, sf: str) -> DataFrame:
    return G.learning_curve(_runs(spark, sf)).select("model", F.col("n_train").cast("bigint").alias("n_train"), "n_runs", *R6("macro"))


def q14_transition_violations(spark: S, sf: str) -> DataFrame:
    """Steps of users' event logs that a table of transitions does not declare."""
    steps = [("", "view"), ("", "click"), ("view", "view"), ("view", "click"), ("click", "click"), ("click", "purchase"), ("purchase", "view"), ("view", "error")]
    v = G.transition_violations(table(spark, sf, "events"), "user_id", "event_type", ("ts", "event_id"), steps)
    return v.select("user_id", "from_status", "to_status", "n")


def q15_plan(spark: S, sf: str) -> DataFrame:
    return G.plan(spark, ["click", "view", "signup"], ["lco", "lpo"], [0, 1, 2], {"signup"}, 24)


def q16_preflight(spark: S, sf: str) -> DataFrame:
    """Orders as runs that lines build on: a line of the first part number wants another data hash, a line without an order finds no run."""
    runs = table(spark, sf, "orders").filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").cast("string").alias("run_key"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("running").alias("status"), F.col("o_custkey").alias("data_hash"), F.lit(1).alias("split_hash"), F.lit(1).alias("code_hash"))
    want = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("run_key"), (F.col("o_custkey") + (F.col("o_orderkey") % 7 == 0).cast("int")).alias("data_hash"), F.lit(1).alias("split_hash"), F.lit(1).alias("code_hash"))
    return G.preflight(runs, want)


def u08_missing_entries(spark: S, sf: str) -> DataFrame:
    plan = q15_plan(spark, sf)
    done = _runs(spark, sf).select("model", "protocol", "seed").distinct().withColumn("status", F.lit("succeeded"))
    return G.missing_entries(plan, done).withColumn("seed", F.col("seed").cast("bigint"))


QUERIES = {k: v for k, v in globals().items() if callable(v) and k[0] in "afjkmqrux" and k[1:3].isdigit() and k not in ("f15_pair_features", "audited")}

_I, _P, _S = sql_strict_id, B.PAIRS, B.SAMPLES
_M = "m AS (SELECT vec_id, pos, CASE WHEN (vec_id + pos) % 17 <> 0 THEN CAST(x AS DOUBLE) END AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"


def _fit(src: str, by: str) -> str:
    return f"""md AS (SELECT {by}pos, median(x) AS median, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS missing FROM {src} GROUP BY ALL),
 st AS (SELECT {by}pos, md.missing, md.median, avg(coalesce(x, md.median)) AS mean, var_samp(coalesce(x, md.median)) AS variance FROM {src} JOIN md USING ({by}pos) GROUP BY ALL),
 fit AS (SELECT *, coalesce(missing < 0.5 AND variance > 1e-8, false) AS kept, CASE WHEN sqrt(variance) > 1e-8 THEN sqrt(variance) ELSE 1.0 END AS sd FROM st)"""


_FOLDS = f"WITH {_M}, fm AS (SELECT f.fold, m.*, vec_id % 5 = f.fold AS is_test FROM m, range(5) f(fold)), tr AS (SELECT fold, vec_id, pos, x FROM fm WHERE NOT is_test), {_fit('tr', 'fold, ')}, sel AS (SELECT *, kept AND row_number() OVER (PARTITION BY fold, kept ORDER BY round(variance, 12) DESC, pos) <= 20 AS selected FROM fit)"
_GROUPED = f"""{_S}, gg AS (SELECT cell_id, min(g) AS g FROM (SELECT {_I('cell_id')} AS cell_id, upper(trim(group_id)) AS g FROM cell_group_assignment) WHERE cell_id IS NOT NULL AND g <> '' GROUP BY 1),
 gd AS (SELECT s.*, coalesce(gg.g, 'CG_' || s.cell_id) AS cell_group FROM s LEFT JOIN gg ON s.cell_id = gg.cell_id WHERE y IS NOT NULL AND s.cell_id IS NOT NULL AND compound_id IS NOT NULL)"""


def sql_folds(src: str, group: str, stratum: str, seed: int = 42, n: int = 5) -> str:
    """CTE dealt (g, test_fold): the folds of the groups of ``src``."""
    return f"""fg AS (SELECT {group} AS g, coalesce(arg_min(coalesce({stratum}, ''), sample_id), '') AS s FROM {src} WHERE {group} IS NOT NULL GROUP BY 1), fs AS (SELECT s, coalesce(sum(count(*)) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM fg GROUP BY 1),
 dealt AS (SELECT g, CAST((row_number() OVER (PARTITION BY fg.s ORDER BY md5('{seed}|' || g)) - 1 + f) % {n} AS BIGINT) AS test_fold FROM fg JOIN fs ON fg.s = fs.s)"""


def sql_planted(src: str, keys: list[str], n: int = 5) -> str:
    """No violation of folds by ``keys``, and one per fold for the smallest sample's key if other samples share it."""
    return " UNION ALL ".join(f"SELECT '{k}_isolated' AS \"check\", CAST(0 AS BIGINT) AS n_violations, CAST({n} * (SELECT CAST(count(*) > 1 AS INTEGER) FROM {src} a WHERE a.{k} = (SELECT arg_min_null({k}, sample_id) FROM {src})) AS BIGINT) AS n_planted" for k in keys)


_FOLDROLE = f"f AS (SELECT sample_id, {_I('cell_id')} AS cell_id, {_I('compound_id')} AS compound_id, lower(trim(role)) AS role FROM lpo_folds)"
_AUDIT = lambda src, keys: " UNION ALL ".join(f"SELECT '{k}_isolated' AS \"check\", count(*) AS n_violations FROM (SELECT {k} FROM {src} WHERE {k} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT role) > 1)" for k in keys)
_RUNS = "r AS (SELECT event_type AS model, 'lco' AS protocol, user_id % 7 AS seed, round(value, 6) AS macro, hour(ts) AS n_train FROM events)"
ORACLE = {
    "a24_column_statistics": f"WITH {_M}, {_fit('m', '')} SELECT CAST(pos AS INTEGER) AS pos, kept, round(missing, 6) AS missing, round(median, 6) AS median, round(mean, 6) AS mean, round(variance, 6) AS variance, round(sd, 6) AS sd FROM fit",
    "f01_fit_all_folds": f"{_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, CAST(pos AS INTEGER) AS pos, selected, round(median, 6) AS median, round(mean, 6) AS mean, round(sd, 6) AS sd FROM sel",
    "f02_transform_test_rows": f"{_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, vec_id, CAST(pos AS INTEGER) AS pos, round((coalesce(x, median) - mean) / sd, 5) AS z FROM fm JOIN sel USING (fold, pos) WHERE is_test AND selected",
    "f03_missing_mask": f"WITH {_M} SELECT vec_id, count(*) FILTER (x IS NULL) AS n_missing, count(*) AS n FROM m GROUP BY 1",
    "f11_set_coverage": f"WITH st AS ({_SETS}) SELECT set_name, count(*) AS n_members, count(*) FILTER (member % 3 <> 0) AS n_effective, count(*) FILTER (member % 3 <> 0) >= 6 AS usable FROM st GROUP BY 1",
    "f12_set_scores": f"WITH {_M}, {_fit('m', '')}, sets AS ({_SETS}), z AS (SELECT vec_id, pos, (coalesce(x, median) - mean) / sd AS z FROM m JOIN fit USING (pos) WHERE kept), sc AS (SELECT vec_id, set_name, avg(z) AS score FROM z JOIN sets ON pos = member GROUP BY 1, 2), ss AS (SELECT set_name, avg(score) AS m, stddev_samp(score) AS sd FROM sc GROUP BY 1) SELECT vec_id, set_name, round((score - m) / CASE WHEN sd > 1e-8 THEN sd ELSE 1.0 END, 5) AS score FROM sc JOIN ss USING (set_name)",
    "f14_intervention": f"WITH {_M}, sets AS ({_SETS}) SELECT vec_id, set_name, round(CASE WHEN count(x) = count(*) THEN avg(x) END, 5) AS before, round(CASE WHEN count(CASE WHEN pos = 8 THEN 0.0 ELSE x END) = count(*) THEN avg(CASE WHEN pos = 8 THEN 0.0 ELSE x END) END, 5) AS after FROM m JOIN sets ON pos = member GROUP BY 1, 2",
    "j15_set_overlap": f"WITH st AS ({_SETS}), n AS (SELECT set_name, count(*) AS n FROM st GROUP BY 1), sh AS (SELECT a.set_name AS set_a, b.set_name AS set_b, count(*) AS shared FROM st a JOIN st b USING (member) GROUP BY 1, 2) SELECT a.set_name AS set_a, b.set_name AS set_b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (a.n + b.n - coalesce(shared, 0)), 6) AS jaccard FROM n a CROSS JOIN n b LEFT JOIN sh ON set_a = a.set_name AND set_b = b.set_name",
    "f10_nearest_fingerprint": "WITH b AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), o AS (SELECT vec_id, i FROM b WHERE x > 0), n AS (SELECT vec_id, count(*) AS n FROM o GROUP BY 1), s AS (SELECT a.vec_id AS v, c.vec_id AS w, count(*) AS k FROM o a JOIN o c ON a.i = c.i AND a.vec_id <> c.vec_id GROUP BY 1, 2) SELECT v AS vec_id, w AS nearest, round(t, 6) AS tanimoto FROM (SELECT v, w, k / (p.n + q.n - k) AS t FROM s JOIN n p ON p.vec_id = v JOIN n q ON q.vec_id = w) QUALIFY row_number() OVER (PARTITION BY v ORDER BY t DESC, w) = 1",
    "x20_projection": "SELECT vec_id, round(sum(CAST(x AS DOUBLE) * ((i - 1) % 7 - 3) / 7.0), 5) AS projection FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1",
    "j14_knn_prediction": f"""WITH {_P}, {B.CELLS}, cv AS (SELECT c.cell_id, CAST(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS DOUBLE[64]) AS v FROM c JOIN embeddings ON CAST(regexp_extract(cell_id, '([0-9]+)$', 1) AS BIGINT) % (SELECT count(*) FROM embeddings) = vec_id),
 t AS (SELECT p.*, v FROM p JOIN cv ON p.cell_id = cv.cell_id), d AS (SELECT q.sample_id, r.y, r.sample_id AS rs, round(array_distance(q.v, r.v) ** 2, 9) AS d2 FROM t q JOIN t r ON q.compound_id = r.compound_id AND q.role = 'test' AND r.role = 'train')
 SELECT sample_id, round(avg(y) + 1e-9, 4) AS prediction FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY d2, rs) <= 3) GROUP BY 1""",
    "f15_pair_feature_sums": f"""WITH {_P}, {B.CELLS}, {B.COMPOUNDS}, cv AS (SELECT c.cell_id, list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6))) AS v FROM c JOIN embeddings ON CAST(regexp_extract(cell_id, '([0-9]+)$', 1) AS BIGINT) % (SELECT count(*) FROM embeddings) = vec_id)
 SELECT p.sample_id, CAST(66 AS BIGINT) AS n, round(cv.v + CAST(regexp_extract(d.compound_id, '([0-9]+)$', 1) AS DOUBLE) % 11 / 10 + length(coalesce(smiles, '')) / 50, 6) AS total FROM p JOIN cv ON p.cell_id = cv.cell_id JOIN d ON p.compound_id = d.compound_id""",
    "m01_mean_baselines": f"WITH {B.PREDICTIONS} SELECT p.sample_id, round(coalesce(cm, g), 4) AS by_cell, round(coalesce(dm, g), 4) AS by_drug, round(g, 4) AS overall FROM p LEFT JOIN cm USING (cell_id) LEFT JOIN dm USING (compound_id) CROSS JOIN gm WHERE role = 'test'",
    "k11_reload_changes": f"""WITH {_P}, {B.CELLS}, {B.COMPOUNDS}, cv AS (SELECT c.cell_id FROM c JOIN embeddings ON CAST(regexp_extract(cell_id, '([0-9]+)$', 1) AS BIGINT) % (SELECT count(*) FROM embeddings) = vec_id)
 SELECT CAST(count(*) AS INTEGER) AS n_compared, CAST(0 AS BIGINT) AS n_changed FROM p JOIN cv ON p.cell_id = cv.cell_id JOIN d ON p.compound_id = d.compound_id""",
    "m14_guarded_selection": "WITH t AS (SELECT user_id, event_id AS trial_no, CASE WHEN event_type <> 'error' THEN round(value / 100, 6) END AS macro, round(1 + value / 50, 6) AS rmse, round(1 + value / 50, 6) <= 1.5 * 1.02 AS eligible FROM events) SELECT user_id, trial_no, eligible, macro, rmse FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY eligible DESC, CASE WHEN eligible THEN macro END DESC NULLS LAST, rmse, trial_no) = 1",
    "m16_contribution_mismatch": f"WITH {B.PREDICTIONS} SELECT sample_id FROM pred WHERE ext = 1",
    "r01_hold_out": f"""WITH {_GROUPED}, ln AS (SELECT * REPLACE (coalesce(lineage, 'none') AS lineage) FROM gd), t AS (SELECT cell_group AS g, CASE WHEN count(DISTINCT lineage) > 1 THEN 'MIXED' ELSE min(lineage) END AS s, count(DISTINCT cell_id) AS size FROM ln GROUP BY 1),
 own AS (SELECT s, count(*) AS n FROM (SELECT cell_id, max(lineage) AS s FROM ln GROUP BY 1) GROUP BY 1), tg AS (SELECT t.s, CASE WHEN t.s = 'MIXED' THEN greatest(1.0, round_even(sum(size) * CAST(0.15 AS DOUBLE), 0)) ELSE max(n) * CAST(0.15 AS DOUBLE) END AS target FROM t LEFT JOIN own ON t.s = own.s GROUP BY 1),
 pl AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY s ORDER BY md5('20260923|' || g) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
 SELECT DISTINCT ln.cell_id, ln.cell_group, CASE WHEN before + size / 2 < target THEN 'hold' ELSE 'dev' END AS region FROM ln JOIN pl ON ln.cell_group = pl.g JOIN tg ON pl.s = tg.s""",
    "r02_group_folds": f"""WITH {_GROUPED}, {sql_folds('gd', 'cell_group', 'lineage')} SELECT CAST(fold AS INTEGER) AS fold, count(*) FILTER (fold = test_fold) AS n_test, count(*) FILTER (fold <> test_fold) AS n_train, count(DISTINCT CASE WHEN fold = test_fold THEN g END) AS n_test_groups FROM gd JOIN dealt ON cell_group = g, range(5) f(fold) GROUP BY 1""",
    "r04_pair_hold_out": f"WITH {_P} SELECT cell_id, compound_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || cell_id || '|' || compound_id), cell_id, compound_id) <= floor(CAST(0.2 AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS role FROM p",
    "r08_inner_split": f"""WITH {_GROUPED}, u AS (SELECT DISTINCT cell_group FROM gd) SELECT cell_group, CASE WHEN row_number() OVER (ORDER BY md5('20260934|' || cell_group), cell_group) <= greatest(1, round_even(count(*) OVER () * CAST(0.2 AS DOUBLE), 0)) THEN 'validation' ELSE 'train' END AS side FROM u""",
    "r09_label_permutation": f"WITH {_P}, a AS (SELECT *, row_number() OVER (PARTITION BY compound_id ORDER BY sample_id) AS r, row_number() OVER (PARTITION BY compound_id ORDER BY md5('42|' || sample_id), sample_id) AS q FROM p) SELECT a.sample_id, round(b.y + 1e-7, 4) AS y FROM a JOIN a b ON a.compound_id = b.compound_id AND a.r = b.q",
    "r10_learning_curve_subset": f"""WITH {_P}, c AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT cell_id FROM p)), a AS (SELECT p.* FROM p JOIN c USING (cell_id) WHERE r <= greatest(2, round_even(c.n * 0.5, 0))),
 d AS (SELECT compound_id, row_number() OVER (ORDER BY compound_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT compound_id FROM a)) SELECT sample_id FROM a JOIN d USING (compound_id) WHERE r <= greatest(2, round_even(d.n * 0.25, 0))""",
    "q03_leakage_audit": f"WITH {_FOLDROLE}, ff AS (SELECT *, CASE WHEN cell_id IS NOT NULL AND compound_id IS NOT NULL THEN cell_id || '|' || compound_id END AS pair FROM f WHERE role IN ('train', 'validation', 'test')) {_AUDIT('ff', ['sample_id', 'pair', 'cell_id', 'compound_id'])}",
    "q03_fold_isolation": f"WITH {_GROUPED} {sql_planted('gd', ['cell_group', 'cell_id'])}",
    "q03_sealed_hold_out": f"""WITH {_GROUPED}, {sql_folds('gd', 'cell_group', 'lineage')}, e AS (SELECT 'cell' AS kind, {_I('cell_id')} AS e, lower(trim(region)) AS region FROM cell_group_assignment UNION ALL SELECT 'compound', {_I('compound_id')}, lower(trim(region)) FROM drug_group_assignment),
 b AS (SELECT kind, e, count(DISTINCT region) AS n FROM e WHERE e IS NOT NULL AND region <> '' GROUP BY 1, 2) SELECT kind || '_in_both_regions' AS "check", count(*) FILTER (n > 1) AS n FROM b GROUP BY 1 UNION ALL SELECT CASE WHEN test_fold = 0 THEN 'quick_test' ELSE 'quick_train' END, count(*) FROM gd JOIN dealt ON cell_group = g GROUP BY 1""",
    "q04_order_invariance": f"WITH {_GROUPED}, {sql_folds('gd', 'cell_group', 'lineage')} SELECT g AS cell_group, test_fold AS fold FROM dealt",
    "q14_transition_violations": """WITH st AS (SELECT user_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS from_status, event_type AS to_status FROM events) SELECT user_id, from_status, to_status, count(*) AS n FROM st
 WHERE (from_status, to_status) NOT IN (('', 'view'), ('', 'click'), ('view', 'view'), ('view', 'click'), ('click', 'click'), ('click', 'purchase'), ('purchase', 'view'), ('view', 'error')) GROUP BY 1, 2, 3""",
    "q15_plan": "SELECT m AS model, p AS protocol, CAST(s AS INTEGER) AS seed FROM (VALUES ('click'), ('view'), ('signup')) a(m), (VALUES ('lco'), ('lpo')) b(p), range(3) c(s) WHERE m <> 'signup' OR s = 0",
    "q16_preflight": """SELECT run_key, problem FROM (SELECT CAST(o_orderkey AS VARCHAR) AS run_key, unnest([CASE WHEN o_orderkey % 11 = 0 THEN 'missing' END, CASE WHEN o_orderkey % 11 <> 0 AND o_orderstatus <> 'F' THEN 'status:running' END, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0 THEN 'data_hash' END]) AS problem FROM orders) WHERE problem IS NOT NULL""",
    "q05_thin_drugs": f"WITH {_FOLDROLE}, t AS (SELECT compound_id, count(DISTINCT cell_id) AS n FROM f WHERE role = 'test' AND compound_id IS NOT NULL GROUP BY 1) SELECT 0 AS fold, min(n) AS min_test_cells, count(*) FILTER (n < 10) AS n_thin FROM t",
    "q06_chemical_isolation": f"""WITH {_S}, rr AS (SELECT DISTINCT sample_id, lower(trim(role)) AS role FROM lpo_folds WHERE lower(trim(role)) IN ('train', 'validation', 'test')), gr AS (SELECT DISTINCT {_I('compound_id')} AS compound_id, {sql_loose_id('chemical_group_id')} AS chemical_group FROM drug_group_assignment),
 x AS (SELECT parent, scaffold, chemical_group, role FROM s JOIN rr USING (sample_id) LEFT JOIN gr ON s.compound_id = gr.compound_id AND chemical_group IS NOT NULL) {_AUDIT('x', ['parent', 'scaffold', 'chemical_group'])}""",
    "q20_control_pairs": f"WITH {_RUNS}, g AS (SELECT model, protocol, CAST(seed AS INTEGER) AS seed, max(macro) AS macro FROM r GROUP BY 1, 2, 3), x AS (SELECT * FROM g WHERE NOT (seed = 3 AND model = 'view')), k(model, control) AS (VALUES ('click', 'view'), ('purchase', 'click')) SELECT x.model, k.control, x.protocol, x.seed, round(x.macro, 6) AS macro, round(x.macro - c.macro, 6) AS gain FROM x JOIN k ON x.model = k.model JOIN x c ON c.model = k.control AND c.protocol = x.protocol AND c.seed = x.seed",
    "q21_learning_curve": f"WITH {_RUNS}, p AS (SELECT model, n_train, round(avg(macro), 6) AS macro, count(*) AS n_runs FROM r GROUP BY 1, 2) SELECT model, n_train, n_runs, macro FROM p WHERE model IN (SELECT model FROM p GROUP BY 1 HAVING count(*) >= 2)",
    "u08_missing_entries": f"WITH {_RUNS}, w(model, protocol, seed) AS (SELECT m, p, s FROM (VALUES ('click'), ('view')) a(m), (VALUES ('lco'), ('lpo')) b(p), range(3) c(s) UNION ALL VALUES ('signup', 'lco', 0), ('signup', 'lpo', 0)) SELECT * FROM w WHERE (model, protocol, seed) NOT IN (SELECT (model, protocol, seed) FROM r)",
}
