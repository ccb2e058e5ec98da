"""Overlaps across splits, components, splits, matching: brute force on small tables and the awkward cases."""

import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assaymill.llm import components as C, matching as M, overlap as O, splits as S
from tests.conftest import rows

SEGMENTS = {"cell": "cell_id", "compound": "compound_id", "parent": "normalized_parent_id"}
BLOCKS = [("cell", "compound"), ("cell", "parent")]
FACT = "sample_id string, cell_id string, compound_id string, normalized_parent_id string, release_id string, code string, b string"
FOLD = "sample_id string, role string, sid string"


def facts(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], FACT)


def folds(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], FOLD)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(4)
    data = [(f"s{rng.randrange(60):02d}", rng.choice([f"CL{i}" for i in range(6)] + [None, "unknown"]), rng.choice([f"CMP{i}" for i in range(8)] + ["", None]), rng.choice(["NP1", "np1 ", "NP2", None]), "R") for _ in range(150)]
    f = [(f"s{i:02d}", rng.choice(["train", " Train", "TEST", "validation", "other"])) for i in range(60) for _ in range(1 + (i % 9 == 0))] + [(None, "train")]
    ok = lambda v: (v or "").strip().upper() if (v or "").strip().upper()[:2] in ("CL", "CM", "NP") else None
    roles = defaultdict(set)
    for s, r in f:
        if s and r.strip().lower() in ("train", "test", "validation"):
            roles[s].add(r.strip().lower())
    keys = defaultdict(set)
    for s, c, k, p, _ in data:
        if ok(c):
            keys[s] |= {(ok(c), "k", ok(k))} if ok(k) else set()
            keys[s] |= {(ok(c), "p", ok(p))} if ok(p) else set()
    want = {(a, b) for a in roles for b in roles if "train" in roles[a] and roles[b] - {"train"} and (keys[a] & keys[b] or a == b)}
    got = rows(O.cross_split_pairs(facts(spark, data), folds(spark, f), "sample_id", SEGMENTS, BLOCKS))
    assert set(got) == want and len(got) == len(want)
    rep = O.overlap_report(O.cross_split_pairs(facts(spark, data), folds(spark, f), "sample_id", SEGMENTS, BLOCKS), facts(spark, data), folds(spark, f), "sample_id", "release_id")
    assert sum(r["n_eval"] for r in rep.filter("role = 'test'").collect()) == len({b for _, b in want if "test" in roles[b]})


def test_overlaps_of_a_hot_pair_and_of_empty_tables(spark):
    data = [(f"t{i}", "CL1", "CMP1", None, "R") for i in range(400)] + [("e1", "CL1", "CMP1", "NP9", None)]
    f = [(f"t{i}", "train") for i in range(400)] + [("e1", "test"), ("lone", "train"), ("lone", "test")]
    got = O.cross_split_pairs(facts(spark, data), folds(spark, f), "sample_id", SEGMENTS, BLOCKS)
    assert got.count() == 401 and got.filter("train_id = eval_id").count() == 1
    assert O.cross_split_pairs(facts(spark, []), folds(spark, []), "sample_id", SEGMENTS, BLOCKS).count() == 0


def test_near_records_within_the_radius_are_found_and_verified(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(400)) for _ in range(20_000))
    base = text()
    near = base.split()
    near[1500] = "changed"
    data = [("t1", base), ("e1", base), ("e2", " ".join(near)), ("e3", text()), ("e4", ""), ("e5", None)]
    r = spark.createDataFrame([(*x, "x") for x in data], "sample_id string, body string, code string")
    f = folds(spark, [("t1", "train"), *[(f"e{i}", "test") for i in range(1, 6)]])
    pairs = lambda least: rows(O.cross_split_pairs(r, f, "sample_id", {"body": "body"}, [("body",)], least, 7, lambda c: F.nullif(F.trim(c), F.lit(""))))
    assert pairs(0.8) == [("t1", "e1"), ("t1", "e2")] and pairs(1.0) == [("t1", "e1")]


def test_a_pair_is_met_once_if_any_segment_is_equal(spark):
    import numpy as np
    import pyarrow as pa

    cols = [pa.array(["CL1", "CL1", None, "CL2"]), pa.array(["CMP1", "CMP1", "CMP1", "CMP1"])]
    (rows_, fp), (alone, _) = O.fingerprints(cols, [(0, 1), (1,)], 2, {})
    assert rows_.tolist() == [0, 1, 3] and alone.tolist() == [0, 1, 2, 3] and (fp[0] == fp[1]).all()
    far = sum(int(np.bitwise_count(np.uint64(a) ^ np.uint64(b))) for a, b in zip(fp[0].view(np.uint64), fp[2].view(np.uint64)))
    assert far > 20  # records that share one of two ids lie far apart


def union_find(edges, nodes):
    p = {n: n for n in nodes}

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_contraction_and_hooking_agree_with_union_find(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(150)]
    edges = [tuple(rng.sample(nodes, 2)) for _ in range(110)] + [(nodes[i], nodes[i + 1]) for i in range(30)] + [(nodes[5], nodes[5])]
    want = union_find(edges, nodes)
    d = spark.createDataFrame(edges, "a string, b string")
    got = dict(rows(C.contract(d, seed)))
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    touched = {n for e in edges if e[0] != e[1] for n in e}
    assert groups(got) == {g for g in groups(want) if len(g) > 1} and set(got) == touched
    hook = dict(rows(S.hook_and_shortcut(d.select(F.col("a").alias("v"), F.col("b").alias("u")))))
    assert hook == {n: want[n] for n in touched | {nodes[5]}}


def test_contraction_of_a_star_and_nothing(spark):
    star = spark.createDataFrame([("hub", f"n{i}") for i in range(300)], "a string, b string")
    assert C.contract(star).select("root").distinct().count() == 1
    assert C.contract(star.limit(0)).count() == 0


def test_chemical_groups_cases(spark):
    drugs = spark.createDataFrame(
        [("CMP1", "NP1", "q"), (" cmp2", "np1 ", "q"), ("CMP2", "NP2", "q"), ("CMP3", "NP2", "q"), ("CMP4", "unknown", "q"), ("CMP5", "unknown", "q"), ("CMP6", None, "q"), ("CMP6", None, "q"), ("tbd", "NP1", "q"), (None, "NP1", "q")],
        "compound_id string, normalized_parent_id string, key string",
    )
    samples = spark.createDataFrame([("CMP4", "SC1"), ("CMP6", "sc1\t"), ("CMP9", "SC1"), ("CMP9", "SC2"), ("CMP5", "SC2"), ("CMP5", "-")], "compound_id string, scaffold_id string")
    got = {r["compound_id"]: (r["chemical_group_id"], r["n_members"]) for r in C.chemical_groups(drugs, samples).collect()}
    # CMP9 is no member, so it links neither SC1 with SC2
    assert got == {"CMP1": ("CHEM_CMP1", 3), "CMP2": ("CHEM_CMP1", 3), "CMP3": ("CHEM_CMP1", 3), "CMP4": ("CHEM_CMP4", 2), "CMP6": ("CHEM_CMP4", 2), "CMP5": ("CHEM_CMP5", 1)}
    assert C.chemical_groups(drugs.limit(0), samples.limit(0)).count() == 0


def test_subset_sums_are_the_closest(spark):
    rng = random.Random(0)
    for _ in range(60):
        sizes = {s: rng.randrange(1, 4) for s in rng.sample(range(1, 30), 4)}
        target = rng.uniform(0, sum(s * c for s, c in sizes.items()))
        got = S.choose_counts(sizes, target)
        assert all(got[s] <= sizes[s] for s in got)
        total = sum(s * c for s, c in got.items())
        share = min(1.0, target / sum(s * c for s, c in sizes.items()))
        floor = {s: max(0, int(c * share) - 1) for s, c in sizes.items()}
        reach = {sum(s * c for s, c in floor.items())}
        for s, c in sizes.items():
            reach |= {t + s * k for t in reach for k in range(c - floor[s] + 1)}
        assert abs(total - target) == pytest.approx(min(abs(t - target) for t in reach))
    assert S.choose_counts({}, 5) == {} and S.choose_counts({3: 2}, 0) == {}


def test_subset_sums_of_giants_take_no_time():
    began = time.time()
    for giant in (10**5, 10**7, 10**10):
        sizes = {1: 100_000, 3: 20_000, 17: 900, giant: 1, 2 * giant: 3}
        target = 0.3 * sum(s * c for s, c in sizes.items())
        got = S.choose_counts(sizes, target)
        small = sum(s * c for s, c in sizes.items() if s < giant)
        best = min(max(0, abs(target - g * giant - small / 2) - small / 2) for g in range(8))
        assert abs(sum(s * c for s, c in got.items()) - target) <= best + 1e-6 * target
    assert time.time() - began < 2


def test_splits_keep_groups_and_approach_targets(spark):
    rng = random.Random(3)
    cells = [(f"CL{i:04d}", f"RG{rng.randrange(80)}" if i % 3 else rng.choice([None, "", "n/a"]), rng.choice(["Lung", "Skin ", "skin", None]), "z") for i in range(600)] + [("CL0001", "RG1", "Lung", "z"), ("CL0002", "rg1 ", "Lung", "z"), ("none", "RG1", "Lung", "z")]
    drugs = [(f"CMP{i}", f"CHEM_{i // 4}" if i % 2 else None, "z") for i in range(300)]
    c = spark.createDataFrame(cells, "cell_id string, group_id string, oncotree_lineage string, root string")
    d = spark.createDataFrame(drugs, "compound_id string, chemical_group_id string, size string")
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("test", 0.1)], "split string, target_share double")
    got = S.related_splits(c, d, t)
    r = got.collect()
    assert len(r) == 900 and len({(x["kind"], x["entity_id"]) for x in r}) == 900
    per = defaultdict(set)
    for x in r:
        per[x["component"]].add(x["split"])
    assert all(len(v) == 1 for v in per.values())
    by_group = defaultdict(set)
    split = {x["entity_id"]: x["split"] for x in r}
    for cell, g, *_ in cells:
        if g and g.strip().upper() not in ("", "N/A") and cell.startswith("CL"):
            by_group[g.strip().upper()].add(split[cell])
    assert all(len(v) == 1 for v in by_group.values())
    for kind in ("cell", "compound"):
        n = Counter(x["split"] for x in r if x["kind"] == kind)
        assert abs(n["train"] / sum(n.values()) - 0.8) < 0.05 and abs(n["test"] / sum(n.values()) - 0.1) < 0.05
    assert rows(got) == rows(S.related_splits(c.repartition(5), d, t))
    assert S.related_splits(c.limit(0), d.limit(0), t).count() == 0
    with pytest.raises(ValueError):
        S.related_splits(c, d, t.limit(0))


def test_a_giant_component_stays_whole(spark):
    c = spark.createDataFrame([(f"CL{i}", "RG1" if i < 300 else None, "Lung") for i in range(400)], "cell_id string, group_id string, oncotree_lineage string")
    d = spark.createDataFrame([], "compound_id string, chemical_group_id string")
    t = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split string, target_share double")
    n = Counter(r["split"] for r in S.related_splits(c, d, t).collect())
    assert n == {"train": 320, "test": 80}


LINE = "sanger_model_id string, cell_line_name string, gdsc_cell_line_name string, synonyms string, cosmic_id string, cellosaurus_accession string, oncotree_lineage string, side string"
PASS = "model_id string, model_name string, synonyms string, cosmic_id string, rrid string, tissue string, evidence string"


def test_values_and_evidence():
    assert M.split_name(M.words("Qob-825 (human)"), {"HUMAN"}) == ("QOB825", ["HUMAN"]) and M.split_name(M.words("Live.1594R2"), {"R#"}) == ("LIVE1594", ["R#"]) and M.split_name(M.words("luc"), {"LUC"}) == ("LUC", []) and M.words("unknown") == []
    assert [M.level(*x) for x in ((None, 0.0), (0, 0.1), (0, 0.75), (1, 0.85), (2, 1.0))] == [-1, 0, 3, 7, 9]
    assert M.number_value(" COSMIC:25101934.0") == "25101934" and M.number_value("x") == "" and M.accession_value("RRID:CVCL_00005") == "00005" == M.accession_value("cvcl-00005")
    assert M.edits("SEBI", "SBEI") == 1 and M.edits("ABC", "AC") == 1 and M.edits("ABC", "XYZ") == 3 and M.edits("", "AB") == 2
    assert M.agreement(["AB12"], ["AB12", "X"]) == 2 and M.agreement(["AB12"], ["AB13"]) == 1 and M.agreement(["AB12"], ["ZZ99"]) == 0 and M.agreement([], ["A"]) is None


def test_matching_cases(spark):
    line = [
        ("SIDM1", "BAB_12", "Bab 12", "Zuq77", "700077", "CVCL_0AAAA", "Lung"), ("SIDM1", "BAB_12", None, None, "700077", "CVCL_0AAAA", "Lung"), ("SIDM2", "GEB-283", None, None, "804806.0", "CVCL_97WZ0", "Skin"),
        ("SIDM3", "LIB 554", None, None, None, None, "Bone"), (None, "NOID1", None, None, None, None, None), ("SIDM4", None, None, None, None, None, None),
    ]
    filler = [(f"SIDM{100 + i}", f"X{chr(65 + i % 26)}{chr(65 + i // 26)}-{i * 37 % 1999}", None, None, str(5_000_000 + i * 104729), f"CVCL_F{i:04d}", "Lung") for i in range(120)]
    p = [
        ("P1", "bab12 (human)", None, None, None, "lung"), ("P2", "zuq-77", None, None, "RRID:CVCL_0AAAA", None), ("P3", "GEB 283", None, "COSMIC:999", "CVCL_11111", "Eye"), ("P4", "GEB283 luc", None, None, None, "Skin"),
        ("P5", "EGB 283", None, "804806", None, "Skin"), ("P6", None, None, None, "cvcl_97wz0", None), ("P7", None, None, None, None, None), ("P8", "LIB.554", None, None, None, "Bone"), ("P8", "LIB.554", None, None, None, "Bone"),
        ("P9", "other1", None, "700077", "CVCL_99999", "Eye"), ("", "BAB_12", None, None, None, "Lung"), (None, "BAB_12", None, None, None, "Lung"),
    ]
    # what affixes mean is learned: those of a species stand beside the line's own numbers, those of derived lines beside others
    usual = [(f"Q{i}", f[1].lower() + (" (human)" if i % 2 else ""), None, f[4], f[5], "Lung") for i, f in enumerate(filler[:80])] + [(f"D{i}", f[1] + " luc", None, str(70_000_000 + i * 99_991), f"CVCL_Z{i:04d}", "Lung") for i, f in enumerate(filler[80:])]
    got = M.match(spark.createDataFrame([(*x, "s") for x in line + filler], LINE), spark.createDataFrame([(*x, "e") for x in p + usual], PASS))
    r = [x for x in got.collect() if x["model_id"][0] == "P"]
    assert {(x["model_id"], x["sanger_model_id"]) for x in r} == {("P1", "SIDM1"), ("P2", "SIDM1"), ("P5", "SIDM2"), ("P6", "SIDM2"), ("P8", "SIDM3")}
    assert all(0 < x["confidence"] <= 1 for x in r) and len(r) == 5
    assert {(x["model_id"], x["sanger_model_id"]) for x in got.collect() if x["model_id"][0] != "P"} == {(f"Q{i}", f[0]) for i, f in enumerate(filler[:80])}


def test_affixes_are_learned_from_whole_names(spark):
    lines = [(f"SIDM{i}", f"K{chr(65 + i % 26)}{chr(65 + i // 26)}-{i + 10}", None, None, None, None, "Lung", "s") for i in range(60)]
    asked = [(f"P{i}", x[1] + [" cell line", "R3", "", ""][i % 4], None, None, None, "Lung", "e") for i, x in enumerate(lines)]
    spelled = M.spelled_records(spark.createDataFrame(lines, LINE), "L", F.col("sanger_model_id"), ["cell_line_name"], "cosmic_id", "cellosaurus_accession", "oncotree_lineage").unionByName(
        M.spelled_records(spark.createDataFrame(asked, PASS), "P", F.col("model_id"), ["model_name", "synonyms"], "cosmic_id", "rrid", "tissue"))
    assert M.learned_affixes(spelled) == ["CELL", "LINE", "R#"]


def test_a_name_shared_by_many_lines_pairs_no_group_with_a_group(spark):
    lines = [(f"SIDM{i}", "SAME-1", None, None, str(1_000_000 + i * 7919), None, "Lung", "s") for i in range(150)]
    asked = [(f"P{i}", "same 1", None, str(1_000_000 + i * 7919), None, "Lung", "e") for i in range(150)]
    recs_l, recs_p = spark.createDataFrame(lines, LINE), spark.createDataFrame(asked, PASS)
    got = M.match(recs_l, recs_p)
    assert {(r["model_id"][1:], r["sanger_model_id"][4:]) for r in got.collect()} == {(str(i), str(i)) for i in range(150)}


def test_matching_empty_tables(spark):
    assert M.match(spark.createDataFrame([], LINE), spark.createDataFrame([], PASS)).count() == 0
    assert M.match(spark.createDataFrame([("SIDM1", "AB-1", None, None, None, None, None, "s")], LINE), spark.createDataFrame([], PASS)).count() == 0


def test_large_buckets_of_values_are_met_in_blocks_without_loss(spark, monkeypatch):
    lines, asked = others(90)
    l, p = spark.createDataFrame(lines, LINE), spark.createDataFrame(asked, PASS)
    whole = rows(M.match(l, p).select("model_id", "sanger_model_id"))
    monkeypatch.setattr(M, "BUCKET", 3)
    assert rows(M.match(l, p).select("model_id", "sanger_model_id")) == whole and len(whole) > 60


def others(n):
    """Lines of other names and their records, some with a mistyped number or accession, from which levels are calibrated."""
    lines, asked = [], []
    for i in range(n):
        name, number, accession = f"{'BCDFGHKL'[i % 8]}{'AEIO'[i // 8 % 4]}{'MNPRST'[i // 32 % 6]}-{i * 37 % 1999}", str(5_000_000 + i * 104729), f"CVCL_F{i * 613 % 9973:04d}"
        lines.append((f"SIDM9{i:03d}", name, None, None, number, accession, "Lung" if i % 3 else "Skin", "s"))
        wrong = number[:3] + str((int(number[3]) + 4) % 10) + number[4:] if i % 6 == 1 else number
        asked.append((f"Q{i}", name.lower(), None, wrong if i % 4 else None, accession[:-1] + "Q" if i % 6 == 2 else accession if i % 5 else None, "Lung" if i % 3 else "Skin", "e"))
        if i % 3 == 0:  # another line of the same name
            asked.append((f"N{i}", name, None, str(80_000_000 + i * 7907), f"CVCL_Z{i:04d}", "Bone", "e"))
    return lines, asked


@pytest.mark.parametrize("n", [60, 64, 65, 70, 3000])
def test_a_mistyped_identifier_finds_its_line_among_few_or_many_of_the_name(spark, n):
    number = lambda i: str(1_000_000 + i * 7919)
    lines = [(f"SIDM{i + 100}", "SAME-1", None, None, number(i), f"CVCL_{i * 7919 % 99991:05d}", "Lung", "s") for i in range(n)]
    asked = [("P1", "same 1", None, number(40)[:-1] + str((int(number(40)[-1]) + 5) % 10), None, "Lung", "e"), ("P2", "same 1", None, None, f"CVCL_{50 * 7919 % 99991:05d}"[:-1] + "Z", None, "e")]
    usual, theirs = others(120)
    got = M.match(spark.createDataFrame(lines + usual, LINE), spark.createDataFrame(asked + theirs, PASS))
    assert {(r["model_id"], r["sanger_model_id"]) for r in got.collect() if r["model_id"][0] == "P"} == {("P1", "SIDM140"), ("P2", "SIDM150")}
