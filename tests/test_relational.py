"""Joins, flags, diffs, waterfalls, keys, hashes and semantic traps on literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from assaymill.functions import chemistry, ids, scalars as X
from assaymill.operators import graph as G, ranks as K, relational as R
from tests.conftest import rows

NAN, INF = float("nan"), float("inf")


def test_ids(spark):
    d = spark.createDataFrame([(" cl0012\t",), ("CL",), ("12",), ("",), (None,), ("N/A",), ("cl-1",)], "x string")
    assert [r[0] for r in d.select(ids.strict_id("x")).collect()] == ["CL0012", None, None, None, None, None, None]
    assert [r[0] for r in d.select(ids.loose_id("x")).collect()] == ["CL0012", "CL", "12", None, None, None, "CL-1"]


def test_finite_and_rounding(spark):
    d = spark.createDataFrame([(1.5,), (NAN,), (INF,), (-INF,), (None,)], "x double")
    assert [r[0] for r in d.select(X.finite("x")).collect()] == [1.5, None, None, None, None]
    assert [r[0] for r in spark.createDataFrame([(2.5,), (3.5,)], "x double").select(X.half_even(F.col("x"))).collect()] == [2.0, 4.0]
    assert [r[0] for r in spark.createDataFrame([(0.0001,), (1e7,), (-2.5,)], "x double").select(X.canonical_number("x")).collect()] == ["0.0001", "10000000.0", "-2.5"]
    assert X.values_agree({"a": [1.0, {"b": True}]}, {"a": [1.0 + 1e-14, {"b": True}]})
    assert not X.values_agree({"a": 1}, {"a": True}) and not X.values_agree([NAN], [NAN]) and not X.values_agree({"a": 1}, {"b": 1})


def test_close_forms_differ(spark):
    d = spark.createDataFrame([(100.0, 100.1)], "a double, b double")
    r = d.select(X.is_close(F.col("a"), F.col("b"), 1e-3, 0.0), X.is_close(F.col("a"), F.col("b"), 9.9e-4, 0.0, symmetric=True)).first()
    assert tuple(r) == (True, False)


def test_last_wins_and_defaults(spark):
    look = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "k string, v int, p int")
    left = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    got = R.map_join(left, R.last_wins(look, "k", "v", "p"), "k", "v", default=-1)
    assert rows(got) == [("a", 2), ("b", 3), ("c", -1), (None, -1)]


def test_reject_reason_joins_and_is_null_without(spark):
    d = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "a int, b int")
    assert [r[0] for r in d.select(R.reject_reason(("x", F.col("a") == 1), ("y", F.col("b") == 1))).collect()] == ["x|y", "x", None]


def test_contracts_and_sets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(R.contract_join(a, b, "k", "one_to_one")[1]) == [(1, 2, "left")]
    assert rows(R.contract_join(a, b, "k", "many_to_one")[1]) == []
    assert rows(R.set_difference(a, b, "k")) == [(1, "left"), (3, "right")]


def test_prioritised_resolution(spark):
    base = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p4",)], "k string")
    s1 = spark.createDataFrame([("p1", "t1"), ("p2", "t2"), ("p2", "t3")], "k string, t string")
    s2 = spark.createDataFrame([("p1", "t9"), ("p2", "t2"), ("p3", "t7"), ("p3", "t8")], "k string, t string")
    got = {r["k"]: (r["target"], r["status"]) for r in R.prioritised(base, "k", [("id", s1, "k", "t"), ("name", s2, "k", "t")]).collect()}
    assert got == {"p1": ("t1", "resolved:id"), "p2": ("t2", "resolved:name"), "p3": (None, "review:name"), "p4": (None, "unresolved")}


def test_table_diff(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (3, NAN, "z")], "r int, n double, t string")
    b = spark.createDataFrame([(1, 1.5, "x "), (2, 2.0, "q")], "r int, n double, t string")
    got = {r["column"]: (r["n_cells"], r["n_missing_row"], r["n_differ"], r["n_blank_only"], r["max_abs_diff"]) for r in R.table_diff(a, b, "r", ["n"], ["t"]).collect()}
    assert got == {"n": (3, 1, 1, 0, 0.5), "t": (3, 1, 2, 1, None)}


def test_waterfall_counts_null_flags_as_failed(spark):
    d = spark.createDataFrame([("c1", "d1", True, True), ("c1", "d1", True, None), ("c2", "d1", False, True), (None, "d2", True, True)], "c string, d string, a boolean, b boolean")
    assert rows(R.waterfall(d, [("L1", F.col("a")), ("L2", F.col("b"))], "c", "d")) == [(1, "L1", 3, 1, 2, 1), (2, "L2", 2, 1, 2, 1)]


def test_content_hash_ignores_row_order_and_partitions(spark):
    d = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "k int, v string")
    h = lambda x: R.content_hash(x, ["k", "v"]).first()["content_hash"]
    assert h(d) == h(d.repartition(7).orderBy(F.rand(1))) != h(d.withColumn("v", F.when(F.col("k") == 3, "w").otherwise(F.col("v"))))


def test_schema_and_recomputation(spark):
    d = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 3.0)], "k string, x double, z double")
    assert R.schema_problems(d, ["k", "q"], ["z"]) == ["missing:q", "forbidden:z"]
    e = d.withColumn("x", F.col("x") + F.when(F.col("k") == "b", 0.1).otherwise(1e-12)).filter("k <> 'c'")
    assert rows(R.recomputed(d, e, ["k"], ["x", "z"]).select("k", "column")) == [("b", "x")]


def test_ranks_correlation_and_holm(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 2.0, 3.0), ("b", 1.0, 5.0), ("b", 2.0, 5.0), ("c", 1.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in K.spearman(d, ["g"], "x", "y").collect()}
    assert got["a"] == pytest.approx(0.8660254) and got["b"] is None and got["c"] is None
    p = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.8)], "i int, p double").withColumn("f", F.lit(1))
    assert [round(r["p_adjusted"], 9) for r in K.holm(p, ["f"], "p", "i").orderBy("i").collect()] == [0.03, 0.08, 0.8]


def test_global_average_rank_and_dense_order(spark):
    d = spark.createDataFrame([(float(x),) for x in (5, 1, 5, 2, 9)], "x double")
    assert rows(K.global_average_rank(d, "x", "r")) == [(1.0, 1.0), (2.0, 2.0), (5.0, 3.5), (5.0, 3.5), (9.0, 5.0)]
    keys = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "k string").repartition(6)
    assert [r["n"] for r in K.dense_order(keys, "k", "n").orderBy("k").collect()] == list(range(1, 51))


def test_numbers_stay_gapless_with_payload_over_many_ranges(spark):
    n = 3_000_000
    d = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("v"), F.rand(3).alias("x"))
    got = K.dense_order(d, "k", "n").agg(F.countDistinct("n").alias("u"), F.max("n").alias("m"), F.count_if(F.col("n") != F.col("k") + 1).alias("wrong")).first()
    assert (got["u"], got["m"], got["wrong"]) == (n, n, 0)


def test_ranks_of_hot_groups_equal_those_of_windows(spark):
    d = spark.range(6000).select((F.col("id") % 10).alias("r"), (F.xxhash64("id") % 97).cast("double").alias("x")).withColumn("g", F.when(F.col("r") < 4, "hot").when(F.col("r") < 9, F.concat(F.lit("g"), F.col("r").cast("string"))))
    d = d.withColumn("x", F.when(F.col("x") == 5, F.lit(None)).otherwise(F.col("x"))).distinct()
    a, b = (rows(K.group_ranks(d, ["g"], {"rank": "x"}, hot=h).select("g", "r", "x", "rank")) for h in (False, True))
    assert a == b and any(r[3] is None for r in a)


def test_salt_classes_from_text(spark):
    d = spark.createDataFrame([("CCO",), ("CCO.Cl",), ("[Pt+2].NCCN",), ("[Na+].CC(=O)[O-]",), ("[13CH3]O",), (None,)], "s string")
    assert [r[0] for r in d.select(chemistry.text_salt_class("s")).collect()] == ["single", "salt_or_solvate", "metal_complex", "salt_or_solvate", "single", None]


def test_quantile_bins_merge_equal_edges(spark):
    d = spark.createDataFrame([(x,) for x in (1, 1, 1, 1, 2, 9)], "x int")
    assert [r["bin"] for r in K.quantile_bins(d, "x").orderBy("x").collect()] == [1, 1, 1, 1, 2, 2]


def test_k_core_reports_convergence(spark):
    grid = [(f"c{i}", f"d{j}") for i in range(4) for j in range(4)] + [("c9", "d0"), ("c0", "d9"), (None, "d0")]
    core, done, sizes = G.k_core(spark.createDataFrame(grid, "c string, d string"), "c", "d", 3, 3)
    assert core.count() == 16 and done and sizes == [18, 16]
    _, done, _ = G.k_core(spark.createDataFrame([(f"c{i}", f"d{i + k}") for i in range(12) for k in (0, 1)], "c string, d string"), "c", "d", 2, 2, max_rounds=2)
    assert not done


def test_components_long_chain_and_loners(spark):
    chain = [(f"n{i:03d}", f"k{i}") for i in range(40)] + [(f"n{i + 1:03d}", f"k{i}") for i in range(40)] + [("x", None), (None, "k0")]
    got = {r["n"]: (r["component"], r["size"]) for r in G.components(spark.createDataFrame(chain, "n string, k string"), "n", ["k"], "G_").collect()}
    assert got["n040"] == ("G_n000", 41) and got["x"] == ("G_x", 1) and len(got) == 42


def test_rewiring_keeps_degrees():
    from collections import Counter

    edges = [(f"s{i % 6}", f"m{(i * 7) % 31}") for i in range(90)]
    out = G.rewire(edges, 3)
    assert Counter(s for s, _ in out) == Counter(s for s, _ in set(edges)) and Counter(m for _, m in out) == Counter(m for _, m in set(edges))
    assert set(out) != set(edges) and G.rewire(edges, 3) == out
    with pytest.raises(ValueError):
        G.rewire([("s", "a"), ("s", "b")], 1)


def test_complete_collections_are_rigid_and_nearly_complete_ones_rewired(spark, tmp_path):
    from collections import Counter

    from assaymill.plans.entities import g03_rewired_overlap

    full = [(f"s{i}", f"m{j}") for i in range(25) for j in range(300)]
    near = [e for e in full if e not in {("s0", "m0"), ("s1", "m1")}]
    assert G.rigid(full) and G.rigid([("s", "a"), ("s", "b"), ("t", "a")]) and not G.rigid(near) and not G.rigid([("s", "a"), ("t", "b")])
    out = G.rewire(near, 7)
    assert Counter(s for s, _ in out) == Counter(s for s, _ in near) and Counter(m for _, m in out) == Counter(m for _, m in near)
    assert set(full) - set(out) in ({("s0", "m0"), ("s1", "m1")}, {("s0", "m1"), ("s1", "m0")})
    parts = [(b, t, s) for b in ("B1", "B2", "B3") for t in ("X", "Y") for s in range(4)]
    for extra in ([], [(None, "X", 1)]):
        spark.createDataFrame(parts + extra, "p_brand string, p_type string, p_size int").write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
        assert tuple(g03_rewired_overlap(spark, str(tmp_path)).first()) == (24, 24, 1.0)


def test_structure_functions_need_their_toolkit():
    if not chemistry.available():
        with pytest.raises(RuntimeError):
            chemistry.standardise()


def test_neural_models_need_their_toolkit():
    from assaymill.operators import neural

    if not neural.available():
        with pytest.raises(RuntimeError):
            neural.low_rank(2, 2, 1)


def test_pic50():
    assert math.isclose(6 - math.log(10) / math.log(10), 5)
