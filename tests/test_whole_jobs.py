"""Queries over whole vectors, sets and roles against brute force, and models against the equations they must solve."""

import os

import numpy as np
import pytest

from assaymill.functions.ids import loose_id, strict_id
from assaymill.operators import models as L
from assaymill.plans import base as B, evaluation as V, modelling as Q
from assaymill.session import table
from tests.oracle import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def vectors(spark):
    return {r["vec_id"]: np.round(np.array(r["embedding"], np.float64), 6) for r in table(spark, SF, "embeddings").collect()}


def cell_vector(e, cell):
    digits = cell[len(cell.rstrip("0123456789")) :]
    return e.get(int(digits) % len(e)) if digits else None


def test_neighbours_are_those_of_whole_vectors(spark):
    e = vectors(spark)
    assert {len(v) for v in e.values()} == {64}
    known = {r["cell_id"] for r in B.cells(spark, SF).select("cell_id").collect()}  # a cell without a master row has no vector
    pairs = [r for r in B.pairs(spark, SF).collect() if r["cell_id"] in known and cell_vector(e, r["cell_id"]) is not None]
    train = {}
    for r in pairs:
        if r["role"] == "train":
            train.setdefault(r["compound_id"], []).append(r)
    want = {}
    for r in pairs:
        if r["role"] == "test" and r["compound_id"] in train:
            d = sorted((round(float(((cell_vector(e, r["cell_id"]) - cell_vector(e, t["cell_id"])) ** 2).sum()), 9), t["sample_id"], t["y"]) for t in train[r["compound_id"]])[:3]
            want[r["sample_id"]] = sum(y for *_, y in d) / len(d)
    got = {r["sample_id"]: r["prediction"] for r in Q.j14_knn_prediction(spark, SF).collect()}
    assert want and set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-4 for s in want)


def test_models_see_whole_vectors_and_interventions_all_sets(spark):
    assert {r["n"] for r in Q.f15_pair_feature_sums(spark, SF).select("n").distinct().collect()} == {66}
    assert {len(r["features"]) for r in Q.f15_pair_features(spark, SF).limit(20).collect()} == {66}
    sets = {r["set_name"] for r in Q._sets(spark).select("set_name").distinct().collect()}
    assert {r["set_name"] for r in Q.f14_intervention(spark, SF).select("set_name").distinct().collect()} == sets


def test_bootstrap_forest_and_factorisation_run_at_full_size(spark, monkeypatch):
    from inspect import signature

    full = {"bootstrap": {"n_boot": 1000}, "forest": {"trees": 64, "depth": 12}, "factorisation": {"factors": 16, "steps": 100}}
    asked = []

    class Seen(Exception):
        pass

    for module, name in ((V.M, "bootstrap"), (Q.L, "forest"), (Q.L, "factorisation")):
        def record(*a, _f=getattr(module, name), _n=name, **k):
            bound = signature(_f).bind(*a, **k)
            bound.apply_defaults()
            asked.append((_n, {p: bound.arguments[p] for p in full[_n]}))
            raise Seen

        monkeypatch.setattr(module, name, record)
    for query in (V.r11_bootstrap_lco, V.r11_bootstrap_ldo, V.r11_bootstrap_db, Q.m06_forest, Q.m09_factorisation):
        with pytest.raises(Seen):
            query(spark, SF)
    assert len(asked) == 5 and all(v == full[n] for n, v in asked)


def test_bootstrap_over_compounds_scores_each_once_for_all_draws(spark, monkeypatch):
    d = V._against_lineage(spark, SF).select("compound_id", "cell_id", "y_true", "y_a", "y_b").toPandas()
    for c in ("y_true", "y_a", "y_b"):
        d["r_" + c] = d.groupby("compound_id")[c].rank()

    def scores(x):
        q = x.cell_id.nunique() >= 10 and x.y_true.nunique() > 1
        rho = [np.corrcoef(x.r_y_true, x[c])[0, 1] if q and x[c].nunique() > 1 else 0.0 for c in ("r_y_a", "r_y_b")]
        return rho[0] - rho[1], float(q)

    per = np.array([scores(x) for _, x in d.groupby("compound_id")])  # in the order of the compounds
    n = len(per)
    sums = [np.bincount(np.random.default_rng([42, b]).integers(0, n, n), minlength=n) @ per for b in range(1000)]
    effects = [a / q for a, q in sums if q]

    def refuse(*_a, **_k):
        raise AssertionError("rows must not be repeated by draws")

    monkeypatch.setattr(V.M, "per_group", refuse)
    got = V.r11_bootstrap_ldo(spark, SF).first()
    assert effects and tuple(got) == ("ldo_so", len(effects), *[pytest.approx(v, abs=1e-12) for v in (np.mean(effects), *np.percentile(effects, [2.5, 97.5]))])


def test_audits_count_all_three_roles_and_chemical_groups(spark):
    def divided(rows, key):
        roles = {}
        for r in rows:
            if r[key] is not None:
                roles.setdefault(r[key], set()).add(r["role"])
        return sum(len(v) > 1 for v in roles.values())

    recorded = Q._recorded(spark, SF, ("train", "validation", "test")).collect()
    assert {r["role"] for r in recorded} == {"train", "validation", "test"}
    got = {r["check"]: r["n_violations"] for r in Q.q03_leakage_audit(spark, SF).collect()}
    assert got == {f"{k}_isolated": divided(recorded, k) for k in ("sample_id", "pair", "cell_id", "compound_id")}

    groups = {}
    for r in table(spark, SF, "drug_group_assignment").select(strict_id("compound_id").alias("c"), loose_id("chemical_group_id").alias("g")).collect():
        if r["c"] and r["g"]:
            groups.setdefault(r["c"], set()).add(r["g"])
    chemical = Q._chemical(spark, SF, ("train", "validation", "test")).collect()
    in_groups = [{"chemical_group": g, "role": r["role"]} for r in chemical for g in groups.get(r["compound_id"], ())]
    got = {r["check"]: r["n_violations"] for r in Q.q06_chemical_isolation(spark, SF).collect()}
    assert got == {"parent_isolated": divided(chemical, "parent"), "scaffold_isolated": divided(chemical, "scaffold"), "chemical_group_isolated": divided(in_groups, "chemical_group")}
    assert got["chemical_group_isolated"] > 0


def design(spark):
    f = Q.f15_pair_features(spark, SF).select("sample_id", "compound_id", "y", "role", "features").collect()
    side = lambda r: [x for x in f if x["role"] == r]
    return side("train"), side("test")


def test_ridge_and_elastic_net_satisfy_their_optimality_conditions(spark):
    train, test = design(spark)
    x, y = np.array([r["features"] for r in train]), np.array([r["y"] for r in train])
    xm, ym, n = x.mean(0), y.mean(), len(y)
    w = np.linalg.solve((x - xm).T @ (x - xm) + np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    got = {r["sample_id"]: r["y_pred"] for r in Q.m03_ridge(spark, SF).collect()}
    assert set(got) == {r["sample_id"] for r in test}
    for r in test:
        assert got[r["sample_id"]] == pytest.approx(float((np.array(r["features"]) - xm) @ w + ym), abs=2e-4)
    e = L.elastic_net((x - xm).T @ (x - xm) / n, (x - xm).T @ (y - ym) / n, 0.01, 0.5, tol=1e-12)
    g = (x - xm).T @ (y - ym - (x - xm) @ e) / n - 0.005 * e  # the subgradient lies within the absolute penalty, at its edge where a weight is used
    assert np.abs(g).max() <= 0.005 + 1e-8 and np.allclose(g[e != 0], 0.005 * np.sign(e[e != 0]), atol=1e-8)
    got = {r["sample_id"]: r["y_pred"] for r in Q.m04_elastic_net(spark, SF).collect()}
    for r in test:
        assert got[r["sample_id"]] == pytest.approx(float((np.array(r["features"]) - xm) @ e + ym), abs=2e-3)


def test_two_way_additive_solves_its_normal_equations(spark):
    p = B.pairs(spark, SF).select("sample_id", "cell_id", "compound_id", "y", "role").collect()
    train, test = ([r for r in p if r["role"] == k] for k in ("train", "test"))
    keys = {k: i for i, k in enumerate(sorted({("d", r["compound_id"]) for r in train} | {("c", r["cell_id"]) for r in train}))}
    z = np.zeros((len(train), len(keys)))
    for i, r in enumerate(train):
        z[i, keys["d", r["compound_id"]]] = z[i, keys["c", r["cell_id"]]] = 1
    y = np.array([r["y"] for r in train])
    w = np.linalg.solve(z.T @ z + 0.01 * np.eye(len(keys)), z.T @ (y - y.mean()))
    got = {r["sample_id"]: r["y_pred"] for r in Q.m02_two_way_additive(spark, SF).collect()}
    want = {r["sample_id"]: y.mean() + sum(w[keys[k]] for k in (("d", r["compound_id"]), ("c", r["cell_id"])) if k in keys) for r in test}
    assert set(got) == set(want) and max(abs(got[s] - want[s]) for s in want) < 0.05


def test_contributions_sum_to_the_prediction_of_each_compounds_ridge(spark):
    rows = Q.m11_set_contributions(spark, SF).collect()
    per = {}
    for r in rows:
        per.setdefault(r["sample_id"], []).append(r)
    assert per and all(len(v) == 16 for v in per.values())
    known = [v for v in per.values() if v[0]["y_pred"] is not None]
    assert known and all(abs(v[0]["base"] + sum(r["contribution"] for r in v) - v[0]["y_pred"]) < 1e-4 for v in known)
