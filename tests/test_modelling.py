"""Metrics, splits, features, models and the registry against known truths and invariances."""

import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaymill.operators import features as E, metrics as M, models as L, registry as G, splitting as P
from tests.conftest import rows


def b1(spark):
    """Two drugs, four cells; the second drug's prediction is constant."""
    r = [(f"s{d}{i}", f"c{i}", d, float(i), float(i) if d == "D1" else 2.0) for d in ("D1", "D2") for i in range(4)]
    return spark.createDataFrame(r, "sample_id string, cell_id string, compound_id string, y_true double, y_pred double")


def test_macro_metric_of_a_constant_drug(spark):
    m = M.macro(b1(spark), min_cells=3).first()
    assert (m["n_drugs"], m["n_qualified"], m["n_constant"]) == (2, 2, 1) and m["macro_spearman"] == pytest.approx(0.5)
    g = {r["compound_id"]: r for r in M.per_group(b1(spark), ["compound_id"], 3).collect()}
    assert g["D2"]["spearman_raw"] is None and g["D2"]["spearman_selection"] == 0.0 and g["D1"]["spearman_raw"] == pytest.approx(1.0)


def test_metric_violations(spark):
    bad = b1(spark).withColumn("y_pred", F.when(F.col("sample_id") == "sD10", F.lit(float("nan"))).otherwise(F.col("y_pred")))
    assert rows(M.violations(bad)) == [("non_finite", 1)]
    assert rows(M.violations(b1(spark).unionByName(b1(spark).limit(1)))) == [("duplicate_sample_id", 1)]
    assert rows(M.violations(b1(spark))) == []


def test_pair_accuracy_counts_ties_as_wrong(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 3.0, 3.0), ("a", 3.0, 0.0)], "g string, y_true double, y_pred double")
    # pairs with different truth: (1,2) tie wrong; (1,3)x2: right, wrong; (2,3)x2: right, wrong
    assert M.pair_accuracy(d, ["g"]).first()["pair_accuracy"] == pytest.approx(2 / 5)


def test_strata_keep_missing_values(spark):
    d = b1(spark).withColumn("tissue", F.when(F.col("cell_id") != "c0", F.lit("x")))
    got = {r["value"]: r["n_samples"] for r in M.strata(d, ["tissue"], 2).collect()}
    assert got == {"x": 6, "(missing)": 2}


def test_bootstrap_of_equal_predictions_is_zero(spark):
    a = M.align(b1(spark), b1(spark)).withColumn("cell_group", F.col("cell_id"))
    r = M.bootstrap(a, "lco", n_boot=12, min_cells=2).first()
    assert (r["ci_low"], r["ci_high"], r["difference_mean"]) == pytest.approx((0.0, 0.0, 0.0), abs=1e-12)
    worse = M.align(b1(spark), b1(spark).withColumn("y_pred", -F.col("y_true"))).withColumn("chemical_group", F.col("compound_id"))
    assert M.bootstrap(worse, "ldo_so", n_boot=12, min_cells=2).first()["ci_low"] > 0
    with pytest.raises(ValueError):
        M.bootstrap(a, "lpo")


@pytest.mark.parametrize("protocol", ["lco", "ldo_so", "db"])
def test_bootstrap_by_weights_equals_repeated_rows(spark, monkeypatch, protocol):
    import random

    import numpy as np

    rng, nan = random.Random(3), float("nan")
    cells = {f"c{i:02d}": f"g{i % 7}" for i in range(20)}
    drugs = {f"d{i}": f"h{i % 4}" for i in range(6)}
    data = [(d, c, rng.choice([1.0, 2.0, 3.0, None]), rng.choice([0.5, 1.5, None, 2.5, nan]), float(rng.randrange(9)), cells[c], drugs[d]) for d in drugs for c in cells if rng.random() < 0.7]
    data += [("d0", None, 2.0, 1.0, 5.0, "g1", "h0"), ("d1", "c01", 3.0, 2.5, 1.0, None, "h1"), ("d2", "c02", 1.0, 0.5, 1.0, "g2", None), ("d9", "c01", 1.0, 1.0, 1.0, "g1", "h1")]
    names = "compound_id string, cell_id string, y_true double, y_a double, y_b double, cell_group string, chemical_group string"
    drawn = {"lco": [5], "ldo_so": [6], "db": [5, 6]}[protocol]
    there = [r for r in data if all(r[k] is not None for k in drawn)]
    groups = {k: sorted({r[k] for r in there}) for k in drawn}
    repeated = []
    for b in range(20):
        g = np.random.default_rng([42, b])
        draws = {k: g.integers(0, len(v), len(v)) for k, v in groups.items()}
        for d, c, *y, cg, hg in there:
            copies = lambda k, v: [f"#{i}" for i, x in enumerate(draws[k]) if groups[k][x] == v] if k in draws else [""]
            repeated += [(b, d + j, c and c + i, *y) for i in copies(5, cg) for j in copies(6, hg)]
    both = spark.createDataFrame(repeated, "b int, compound_id string, cell_id string, y_true double, y_a double, y_b double")
    mean = {}
    for s in ("y_a", "y_b"):
        per = M.per_group(both.withColumnRenamed(s, "y_pred"), ["b", "compound_id"], 8).filter("qualified").groupBy("b").avg("spearman_selection").collect()
        mean[s] = dict((r[0], r[1]) for r in per)
    effects = [mean["y_a"][b] - mean["y_b"][b] for b in mean["y_a"]]

    def refuse(*_a, **_k):
        raise AssertionError("rows must not be repeated by draws")

    for name, value in (("per_group", refuse), ("CELLS", 90), ("DRAWN", 60), ("PIECE", 5)):  # bounds so small that draws are cut in blocks
        monkeypatch.setattr(M, name, value)
    got = M.bootstrap(spark.createDataFrame(data, names), protocol, 20, 42, 8).first()
    assert effects and got["n_valid"] == len(effects)
    assert tuple(got)[2:] == pytest.approx((np.mean(effects), *np.percentile(effects, [2.5, 97.5])), abs=1e-12)


@pytest.mark.parametrize("protocol", ["lco", "db"])
def test_bootstrap_counts_a_cell_in_each_of_its_drawn_groups(spark, protocol):
    data = [("d0", f"c{i}", float(i), float(i), float(-i), g, "h0") for i in range(4) for g in ("g0", "g1")]
    names = "compound_id string, cell_id string, y_true double, y_a double, y_b double, cell_group string, chemical_group string"
    r = M.bootstrap(spark.createDataFrame(data, names), protocol, n_boot=40, min_cells=4).first()
    assert tuple(r)[1:] == pytest.approx((40, 2.0, 2.0, 2.0))  # a draw of one group twice has all four cells, too


def test_bootstrap_over_compounds_scores_rows_once_and_makes_each_draw_once(spark, monkeypatch):
    rows, drawn, score, rng = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), M.drawn_selection, M.np.random.default_rng
    data = [(f"d{i:02d}", f"c{j}", float(j), float(j), float(-j if i % 3 else j), f"h{i:02d}") for i in range(30) for j in range(4)]
    a = spark.createDataFrame(data, "compound_id string, cell_id string, y_true double, y_a double, y_b double, chemical_group string")
    effects = [(2.0 * (rng([42, b]).integers(0, 30, 30) % 3 > 0)).mean() for b in range(20)]

    def counted(unit, *x):
        rows.add(len(unit))
        return score(unit, *x)

    class Numpy:
        def __getattr__(self, name):
            return self if name == "random" else getattr(np, name)

        def default_rng(self, key):
            drawn.add(1)
            return rng(key)

    monkeypatch.setattr(M, "drawn_selection", counted)
    monkeypatch.setattr(M, "np", Numpy())
    monkeypatch.setattr(M, "DRAWN", 150)  # so that the draws are made in blocks
    r = M.bootstrap(a, "ldo_so", n_boot=20, min_cells=4).first()
    assert tuple(r)[1:] == pytest.approx((20, np.mean(effects), *np.percentile(effects, [2.5, 97.5])))
    assert (rows.value, drawn.value) == (len(data), 20)


def groups(spark, n=60):
    r = [(f"s{i:03d}", f"c{i // 3:02d}", f"g{i // 6:02d}", "AB"[(i // 6) % 2], f"d{i % 4}", float(i % 7)) for i in range(n)]
    return spark.createDataFrame(r, "sample_id string, cell_id string, g string, t string, compound_id string, y double")


def test_hold_out_keeps_groups_whole_and_is_near_its_ratio(spark):
    h = P.hold_out(groups(spark, 240), "g", "t", "cell_id", 0.2)
    assert P.divided(h, "g", "region").count() == 0
    share = h.filter("region = 'hold'").count() / h.count()
    assert 0.1 <= share <= 0.3
    assert rows(h) == rows(P.hold_out(groups(spark, 240).repartition(7), "g", "t", "cell_id", 0.2))


def test_mixed_stratum_holds_a_rounded_share_of_at_least_one(spark):
    d = spark.createDataFrame([("a", "g1", "x"), ("b", "g1", "y"), ("c", "g2", "x"), ("d", "g2", "y")], "cell_id string, g string, t string")
    held = P.hold_out(d, "g", "t", "cell_id", 0.1, 1).filter("region = 'hold'")
    assert held.select("g").distinct().count() <= 1
    assert P.hold_out(d.limit(0), "g", "t", "cell_id").count() == 0


def test_held_members_miss_the_target_by_half_a_group_at_most(spark):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(f"c{i}", f"g{rng.integers(0, 60)}") for i in range(600)], "cell_id string, g string").withColumn("t", F.lit("s"))
    top = d.groupBy("g").count().agg(F.max("count")).first()[0]
    assert abs(P.hold_out(d, "g", "t", "cell_id", 0.2).filter("region = 'hold'").count() - 120) <= top / 2


def test_folds_cover_every_sample_once_as_test(spark):
    f = P.group_folds(groups(spark), "g", "t", n=5)
    assert f.filter("role = 'test'").count() == 60 and f.count() == 300
    assert P.leakage_audit(f, ["g"], ["fold"]).first()["n_violations"] == 0
    assert rows(f) == rows(P.group_folds(groups(spark).withColumn("y", -F.col("y")).repartition(5), "g", "t", n=5))


def test_deal_is_round_robin_over_strata(spark):
    d = spark.createDataFrame([(f"g{i}", "st"[i % 2], 1) for i in range(14)], "g string, s string, c int")
    dealt = P.dealt_folds(d, 3, 0).collect()
    sizes = lambda xs: sorted(sum(r["test_fold"] == f for r in xs) for f in range(3))
    assert sizes(dealt) == [4, 5, 5] and all(sizes([r for r in dealt if r["s"] == s]) == [2, 2, 3] for s in "st")


def test_pair_hold_out_share_and_wholeness(spark):
    d = groups(spark, 200)
    p = P.pair_hold_out(d, ["cell_id", "compound_id"], 0.2)
    n = d.select("cell_id", "compound_id").distinct().count()
    assert p.filter("role = 'test'").select("cell_id", "compound_id").distinct().count() == int(0.2 * n) and p.count() == 200
    assert P.pair_hold_out(d.limit(0), ["cell_id", "compound_id"]).count() == 0


def test_label_permutation_keeps_group_means(spark):
    d = groups(spark)
    a, b = (rows(x.groupBy("compound_id").agg(F.round(F.avg("y"), 9), F.count(F.lit(1)))) for x in (d, P.permute_labels(d, "compound_id", "sample_id", "y")))
    assert a == b


def test_fit_uses_training_rows_only_and_imputes_medians(spark):
    nan = float("nan")
    x = [[1.0, nan, 5.0, nan], [3.0, 2.0, 5.0, nan], [8.0, 4.0, 5.0, 1.0], [nan, 9.0, 5.0, nan]]
    m = E.long_matrix(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "e int, v array<double>"), "e", "v")
    got = {r["pos"]: r for r in E.fit(m, "e").collect()}
    full = np.array([[1, 4, 5], [3, 2, 5], [8, 4, 5], [3, 9, 5]], float)
    assert [got[p]["median"] for p in (0, 1)] == [3.0, 4.0]
    for p in (0, 1):
        assert got[p]["mean"] == pytest.approx(full[:, p].mean()) and got[p]["variance"] == pytest.approx(full[:, p].var(ddof=1))
    assert (got[2]["kept"], got[3]["kept"]) == (False, False)  # constant; too many missing
    z = E.transform(m, E.fit(m.unionByName(m), "e"))  # a repeated entity counts once
    assert z.filter("pos = 0").agg(F.round(F.sum("z"), 9)).first()[0] == 0.0


def test_fits_of_whole_vectors_equal_those_of_elements(spark):
    rng = np.random.default_rng(8)
    data = [(i % 53, i % 3, [None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else float(rng.integers(0, 5)) for _ in range(9 if i % 7 else 5)]) for i in range(53)]
    d = spark.createDataFrame(data + data[:4] + [(99, 0, None), (98, 1, [])], "e int, t int, v array<double>").repartition(4)
    got, far = ({(r["fold"], r["pos"]): r for r in E.fit_matrix(d, "e", "v", "t", 3, top=4, most=m).collect()} for m in (1 << 20, 8))
    assert set(got) == set(far) and len(got) == 27
    for k, r in got.items():
        assert (r["kept"], r["selected"]) == (far[k]["kept"], far[k]["selected"])
        assert all(r[c] == pytest.approx(far[k][c], abs=1e-9) for c in ("missing", "median", "mean", "variance", "sd"))
    assert E.fit_matrix(d.limit(0), "e", "v", "t", 3).count() == 0


def test_top_positions_break_ties_by_position(spark):
    m = E.long_matrix(spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [1.0, 1.0, 2.0])], "e int, v array<double>"), "e", "v")
    assert [r["pos"] for r in E.fit(m, "e", top=2).filter("selected").orderBy("pos").collect()] == [0, 2]


def test_set_scores_and_overlap(spark):
    m = spark.createDataFrame([("e", p, float(p)) for p in range(4)] + [("e", 4, None)], "e string, pos int, z double")
    s = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 4)], "set_name string, member int")
    assert rows(E.set_scores(m, s, ["e"])) == [("e", "a", 0.5), ("e", "b", 1.0)]
    assert rows(E.set_scores(m, s, ["e"], impute=False)) == [("e", "a", 0.5), ("e", "b", None)]
    assert ("a", "b", 1, pytest.approx(1 / 3)) in rows(E.set_overlap(s))


def test_nearest_other_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((70, 100)) < 0.3).astype(int)
    x[3] = x[40]
    got = {r["i"]: (r["nearest"], round(r["tanimoto"], 9)) for r in E.nearest_other(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, b array<int>").repartition(3), "i", "b", block=16).collect()}
    for i in range(70):
        s = [-1.0 if i == j else (x[i] & x[j]).sum() / max(1, (x[i] | x[j]).sum()) for j in range(70)]
        assert got[i] == (int(np.argmax(s)), round(max(s), 9))


def test_neighbour_means_and_pair_counts_over_blocks(spark, monkeypatch):
    from assaymill.operators import blocks as B

    rng = np.random.default_rng(5)
    t = [(f"t{i:03d}", "ab"[i % 2], float(rng.integers(0, 9)), [float(x) for x in rng.integers(0, 4, 2)]) for i in range(120)]
    q = [(f"q{i}", "ab"[i % 2], [1.0, 2.0]) for i in range(6)] + [("lone", "c", [0.0, 0.0])]
    small = lambda f: lambda *a, **k: f(*a, **{**k, "size": 7})
    monkeypatch.setattr(E, "blocks", small(B.blocks))
    monkeypatch.setattr(M, "blocks", small(B.blocks))
    got = dict(rows(E.neighbour_mean(spark.createDataFrame(t, "sample_id string, g string, y double, v array<double>"), spark.createDataFrame(q, "sample_id string, g string, v array<double>"), "g", "v", 4)))
    for s, g, v in q[:6]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, x)), i, y) for i, h, y, x in t if h == g)[:4]
        assert got[s] == pytest.approx(sum(y for *_, y in near) / 4)
    assert "lone" not in got
    p = [(g, y, float(rng.integers(0, 5))) for _, g, y, _ in t]
    acc = dict(rows(M.pair_accuracy(spark.createDataFrame(p, "g string, y_true double, y_pred double"), ["g"])))
    for g in "ab":
        w = [(a, b) for k, a in enumerate(p) for b in p[k + 1 :] if a[0] == b[0] == g and a[1] != b[1]]
        assert acc[g] == pytest.approx(np.mean([np.sign(a[1] - b[1]) == np.sign(a[2] - b[2]) for a, b in w]))


def test_preflight_and_run_record(spark):
    h = "run_key string, data_hash int, split_hash int, code_hash int"
    up = spark.createDataFrame([("a", 1, 1, 1, "failed"), ("b", 1, 1, 1, "smoke"), ("c", 1, None, 1, "succeeded")], h + ", status string")
    want = spark.createDataFrame([("a", 2, 1, 1), ("b", 1, 1, 1), ("c", 1, None, 3), ("d", 1, 1, 1)], h)
    assert rows(G.preflight(up, want)) == [("a", "data_hash"), ("a", "status:failed"), ("c", "code_hash"), ("d", "missing")]
    a, b = (G.run_record("s", {"x": "1"}, {"y": o}, {}) for o in "12")
    assert a["run_key"] == b["run_key"]


def test_elastic_net_matches_normal_equations():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    y = x @ [1.0, -2.0, 0.0, 0.5] + 3
    c, d = x - x.mean(0), y - y.mean()
    assert np.allclose(L.elastic_net(c.T @ c / 60, c.T @ d / 60, 1e-6, 0.5), [1, -2, 0, 0.5], atol=1e-3)
    assert not L.elastic_net(c.T @ c / 60, c.T @ d / 60, 10.0, 1.0).any()


def test_group_models_from_partial_moments_equal_those_of_whole_groups(spark):
    rng = np.random.default_rng(4)
    data = [("ab"[i % 2] if i % 7 else None, float(rng.normal()), [float(v) for v in rng.normal(size=3)]) for i in range(200)] + [("a", None, [0.0] * 3), ("b", 1.0, None)]
    d = spark.createDataFrame(data, "g string, y double, features array<double>").repartition(5)
    got = {r["g"]: r for r in L.group_linear(d, "g", 1.0, None).collect()}
    for g in "ab":
        x, y = (np.array([r[k] for r in data if r[0] == g and None not in r]) for k in (2, 1))
        c = x - x.mean(0)
        w = np.linalg.solve(c.T @ c + np.eye(3), c.T @ (y - y.mean()))
        assert np.allclose(got[g]["coef"], w) and got[g]["n"] == len(y) and got[g]["intercept"] == pytest.approx(y.mean() - x.mean(0) @ w)
    assert set(got) == {"a", "b"} and L.group_linear(d.limit(0), "g", 1.0, None).count() == 0


def test_ridge_parity_with_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, 2.0, -1.0] + rng.normal(size=80) * 0.1 + 5
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(3), xc.T @ yc)
    m = L.linear(spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "features array<double>, y double"), 10.0)
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-6)


def test_additive_model_recovers_a_grid(spark):
    g = [(f"s{i}{j}", f"c{i}", f"d{j}", 2.0 * i + 3.0 * j) for i in range(6) for j in range(4)]
    d = spark.createDataFrame(g, "sample_id string, a string, b string, y double")
    p = L.two_way_additive(d, d.unionByName(spark.createDataFrame([("new", "cx", "dx", 0.0)], d.schema)), "a", "b")
    e = p.filter("sample_id <> 'new'").agg(F.sqrt(F.avg((F.col("y") - F.col("y_pred")) ** 2))).first()[0]
    assert e < 0.1 and p.filter("sample_id = 'new'").first()["y_pred"] == pytest.approx(9.5)


def test_small_or_constant_groups_fall_back_to_means(spark):
    t = spark.createDataFrame([("a", 1.0, [0.0]), ("a", 3.0, [1.0])] + [("b", 2.0, [float(i)]) for i in range(40)], "g string, y double, features array<double>")
    q = spark.createDataFrame([("x", "a", [0.5]), ("y", "b", [9.0]), ("z", "new", [1.0])], "sample_id string, g string, features array<double>")
    got = {r["sample_id"]: r["y_pred"] for r in L.per_group_elastic_net(t, q, "g", 0.01, 0.5).collect()}
    assert (got["x"], got["y"]) == (2.0, 2.0) and got["z"] == pytest.approx(2.0)


def test_group_nets_leave_their_moments_where_the_rows_are(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(40, 5))
    data = [(f"g{i % 23 if i % 3 else 0:02d}", int(rng.integers(40)), float(rng.normal())) for i in range(1500)]
    slim = spark.createDataFrame(data, "g string, v int, y double").repartition(6)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "v int, features array<double>")
    monkeypatch.setattr(L, "SOLVED", 4)
    nets = lambda: {r["g"]: r for r in L.group_linear(slim, "g", 0.01, 0.5, 30, lambda d: d.join(F.broadcast(e), "v")).collect()}
    refuse = lambda *_: (_ for _ in ()).throw(AssertionError("moments must not be shuffled"))
    with monkeypatch.context() as m:
        m.setattr(L, "group_moments", refuse)
        whole = nets()
    monkeypatch.setattr(L, "HOT_ROWS", 200)  # g00 in pieces
    for got in (whole, nets()):
        assert set(got) == {r[0] for r in data}
        for g, r in got.items():
            x, y = np.array([vectors[v] for k, v, _ in data if k == g]), np.array([y for k, _, y in data if k == g])
            w = L.elastic_net((c := x - x.mean(0)).T @ c / len(y), c.T @ (y - y.mean()) / len(y), 0.01, 0.5) if len(y) >= 30 else np.zeros(0)
            assert r["n"] == len(y) and np.allclose(r["coef"], w, atol=1e-9) and r["intercept"] == pytest.approx(y.mean() - (x.mean(0) @ w if len(w) else 0))


def test_factorisation_equals_the_built_in_one_without_storing_features(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import FMRegressor
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(50, 6)))], "v int, features array<double>")
    slim = spark.createDataFrame([(str(i), i * 7 % 50, float(rng.normal())) for i in range(300)], "sample_id string, v int, y double").repartition(3)
    attach = lambda d: d.join(F.broadcast(e), "v")
    model = L.factorisation(slim, 4, 42, 12, attach)
    got = {r["sample_id"]: r["y_pred"] for r in model.predict(attach(slim)).collect()}
    wide = attach(slim).withColumn("features", array_to_vector("features")).withColumnRenamed("y", "label")
    want = FMRegressor(factorSize=4, maxIter=12, stepSize=0.05, seed=42).fit(wide).transform(wide).collect()
    assert len(want) == 300 and all(got[r["sample_id"]] == pytest.approx(r["prediction"], abs=1e-9) for r in want)


def test_grids_and_guarded_selection(spark):
    assert len(L.grid("mlp")) == 8 and L.grid("elasticnet")[1] == {"alpha": 0.01, "l1_ratio": 0.5} and L.grid("drug_mean") == [{}]
    t = spark.createDataFrame([("r", 1, 0.9, 2.0, 1.0), ("r", 2, 0.5, 1.0, 1.0), ("r", 3, None, 0.9, 1.0), ("q", 1, 0.9, 3.0, 1.0), ("q", 2, 0.1, 2.0, 1.0)], "run string, trial_no int, macro double, rmse double, baseline_rmse double")
    assert {r["run"]: r["trial_no"] for r in L.select_trial(t, ["run"]).collect()} == {"r": 2, "q": 2}


def test_event_table_follows_its_transitions(spark, tmp_path):
    root, c = str(tmp_path / "runs"), {"alpha": 1.0}
    key = G.record(spark, root, "ridge", c, "planned")
    with pytest.raises(ValueError):
        G.record(spark, root, "ridge", c, "planned")
    G.record(spark, root, "ridge", c, "running")
    G.record_failure(spark, root, "ridge", c, ZeroDivisionError("loss"))
    for state in ("planned", "running", "succeeded"):
        assert G.record(spark, root, "ridge", c, state) == key
    with pytest.raises(ValueError):  # a finished run is followed by nothing
        G.record(spark, root, "ridge", c, "planned")
    with pytest.raises(ValueError):
        G.record(spark, root, "ridge", {"alpha": 2.0}, "paused")
    G.record(spark, root, "tree", {"d": 3}, "planned")
    log = G.events(spark, root)
    assert rows(G.current(log).select("model", "status", "n_events", "n_failed")) == [("ridge", "succeeded", 6, 1), ("tree", "planned", 1, 0)]
    assert G.transition_violations(log).count() == 0 and G.contested_keys(log).count() == 0
    bad = log.unionByName(log.filter("model = 'tree'").withColumns({"status": F.lit("succeeded"), "seq": F.lit(2).cast("bigint"), "config": F.lit("{}")}))
    assert rows(G.transition_violations(bad).select("from_status", "to_status")) == [("planned", "succeeded")] and G.contested_keys(bad).count() == 1
    assert [G.failure_class(e) for e in (MemoryError(), G.NotConverged("x"), OverflowError(), ValueError("x"))] == ["oom", "non_convergence", "non_finite", "other"]
    assert G.events(spark, str(tmp_path / "nothing")).count() == 0


def test_published_files_are_whole_and_discovered(spark, tmp_path):
    G.publish(spark, f"{tmp_path}/a/config.json", {"run_key": "k", "model": "ridge"})
    G.publish(spark, f"{tmp_path}/a/status.json", {"status": "planned", "at_utc": "t"})
    G.publish(spark, f"{tmp_path}/a/status.json", {"status": "succeeded", "at_utc": "t"})
    assert rows(G.discover(spark, str(tmp_path)).select("model", "status")) == [("ridge", "succeeded")]
    with pytest.raises(ValueError):
        G.publish(spark, f"{tmp_path}/a/x.json", {"y": float("nan")})


def test_plan_budget_and_missing(spark):
    p = G.plan(spark, ["a", "b"], ["lco"], [1, 2, 3], {"a"}, 4)
    assert p.count() == 4
    with pytest.raises(ValueError):
        G.plan(spark, ["a", "b"], ["lco"], [1, 2, 3], set(), 4)
    done = spark.createDataFrame([("b", "lco", 1, "succeeded"), ("b", "lco", 2, "failed")], "model string, protocol string, seed int, status string")
    assert rows(G.missing_entries(p, done).select("model", "seed")) == [("a", 1), ("b", 2), ("b", 3)]
    assert "| a | 1 |" in G.markdown("t", [{"x": "a", "n": 1}], ["x", "n"])


def test_screen_verdicts(spark):
    d = spark.createDataFrame([("m", 0.03, 1.0), ("m", 0.02, 1.0), ("m", 0.01, 1.0), ("n", 0.2, 1.1), ("n", 0.2, 1.1)], "model string, delta_macro double, rmse_ratio double")
    assert {r["model"]: r["verdict"] for r in M.screen(d).collect()} == {"m": "pass", "n": "fail"}
