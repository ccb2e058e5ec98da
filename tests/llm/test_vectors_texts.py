"""Nearest vectors, leaked passages, mixing and subjects: brute force, exact cases, held-out accuracy."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaymill.llm import leakage as L, mixing as X, neighbours as N, subjects as S
from assaymill.session import tokenizer_dir
from tests.conftest import rows

VEC = "vec_id bigint, expression array<float>, fingerprints array<tinyint>, gid bigint, code string"


def table(spark, ids, expr=None, bits=None):
    return spark.createDataFrame([(i, None if expr is None else expr[k], None if bits is None else bits[k], 0, "c") for k, i in enumerate(ids)], VEC)


def brute(ids, sim, k=5):
    out = {}
    for a, i in enumerate(ids):
        order = sorted((-round(float(sim[a, b]), 6), j) for b, j in enumerate(ids) if j != i)
        out[i] = [j for _, j in order[:k]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r["vec_id"], []).append(r["other"])
    return out


def clusters(rng, n, per, dim, noise):
    c = rng.normal(size=(n, dim))
    return np.concatenate([c[i] + noise * rng.normal(size=(per, dim)) for i in range(n)]).astype(np.float32)


def test_expression_lists_with_copies_scales_and_invalid_rows(spark):
    rng = np.random.default_rng(0)
    x = clusters(rng, 20, 12, 128, 0.3)
    x = np.concatenate([x, np.repeat(x[:1], 15, 0), 4 * x[5:6]]).astype(np.float32)
    ids = [int(i) for i in rng.permutation(len(x)) * 3 + 1]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = brute(ids, u @ u.T)
    bad = [None, [1.0] * 127, [0.0] * 128, [float("nan")] * 128, [float("inf")] + [1.0] * 127, [None] + [1.0] * 127]
    t = table(spark, ids + [900_000 + i for i in range(len(bad))], [v.tolist() for v in x] + bad)
    got = lists(N.neighbour_lists(t, "expression"))
    assert set(got) == set(want)
    hits = sum(len(set(got[i]) & set(want[i])) for i in ids)
    assert hits / sum(len(v) for v in want.values()) > 0.97
    copies = [i for i, v in zip(ids, x) if np.array_equal(v, x[0])]
    assert all(got[i] == want[i] for i in copies)


def test_oversized_buckets_give_the_lists_of_buckets_in_one_piece(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = (rng.normal(size=128) * 1.8 + rng.normal(size=(300, 128))).astype(np.float32)  # cosines of about 0.6 to 0.9
    t = table(spark, list(range(len(x))), [v.tolist() for v in x])
    whole = lists(N.neighbour_lists(t, "expression"))
    monkeypatch.setattr(N, "BUCKET", 40)
    assert lists(N.neighbour_lists(t, "expression")) == whole


def test_fingerprint_lists(spark):
    rng = np.random.default_rng(1)
    base = rng.random((15, 2048)) < 0.03
    x = np.concatenate([b ^ (rng.random((10, 2048)) < 0.004) for b in base]).astype(np.int8)
    both = x.astype(int) @ x.T.astype(int)
    s = x.sum(1)
    want = brute(list(range(150)), both / (s[:, None] + s[None] - both))
    got = lists(N.neighbour_lists(table(spark, list(range(150)), bits=[v.tolist() for v in x]), "fingerprints"))
    assert sum(len(set(got.get(i, [])) & set(want[i])) for i in want) / 750 > 0.9
    exact = lists(N.exact_lists(table(spark, list(range(150)), bits=[v.tolist() for v in x]), "fingerprints", every=10))
    assert exact == {i: want[i] for i in range(0, 150, 10)}


def test_large_buckets_are_split_into_block_pairs_without_loss(spark, monkeypatch):
    """Every vector in one tight ball: all fall into few buckets, and the answer stays exact."""
    rng = np.random.default_rng(2)
    x = (np.ones(128) + 1e-3 * rng.normal(size=(90, 128))).astype(np.float32)
    monkeypatch.setattr(N, "BUCKET", 16)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.rint((u @ u.T) * 1e6) / 1e6
    got = lists(N.neighbour_lists(table(spark, list(range(90)), [v.tolist() for v in x]), "expression"))
    want = brute(list(range(90)), s)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / 450 > 0.9


def test_lone_and_no_vectors(spark):
    assert N.neighbour_lists(table(spark, [1], [[1.0] * 128]), "expression").count() == 0
    assert N.neighbour_lists(table(spark, []), "fingerprints").count() == 0
    two = lists(N.neighbour_lists(table(spark, [7, 3], [[1.0] * 128, [2.0] * 128]), "expression"))
    assert two == {7: [3], 3: [7]}


ITEM = ("Like every appendix of that kind, our mild caption turned into 64 smaller ones after which the secretary sorted in pencil. Under lamp 62, several inner hands repeated the same draft, "
        "or so the regular review claims. If one believes the keeper, two second gap lines contradicted each other.")  # fmt: skip
WORDS = ITEM.split()


def leaked(spark, texts, items=(("E1", ITEM),)):
    d = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, doc_id int")
    return {r["doc_id"] for r in L.leaks(d, e).collect()}


def test_leaks_survive_layout_case_punctuation_and_few_edits(spark):
    host = "The courier arrives at noon and the freezer rack waits. " * 4
    some = WORDS.copy()
    some[5], some[20], some[33] = "plain", "indeed", "now"
    texts = [
        host + ITEM, host + ITEM.upper().replace(",", "").replace(".", " "), "目录" + "\n".join(WORDS) + "配置", " ​".join(WORDS), " ".join(some) + host, host + " ".join(WORDS[: int(0.62 * len(WORDS))]),
        " ".join(WORDS[:25]) + " Item 9 has been split and waits for review. " + " ".join(WORDS[25:]), host + " ".join(WORDS).replace("64", "17").replace("62", "17"),
    ]
    assert leaked(spark, texts) == set(range(8))


def test_quotations_shuffles_and_similar_sentences_are_no_leaks(spark):
    rng = random.Random(1)
    shuffled = WORDS.copy()
    rng.shuffle(shuffled)
    texts = [
        " ".join(WORDS[:12]), " ".join(shuffled), "Like every record of that kind, our old caption came to rest on the archive. Under lamp 9, several keen visitors signed the last folder, or so the plain list claims.", "", None, "a",
        " ".join(WORDS[:14]) + " filler" * 300 + " " + " ".join(WORDS[30:38]),
    ]
    assert leaked(spark, texts) == set()


def test_a_sentence_of_similar_build_hides_no_leak_elsewhere_in_the_document(spark):
    part = WORDS[: int(0.8 * len(WORDS))]
    alike = " ".join(w if i % 9 < 5 else f"other{chr(97 + i % 26)}" for i, w in enumerate(part))  # wider, but fewer words as they stand
    leak = " ".join(WORDS[: int(0.62 * len(WORDS))])
    far = " filler" * 800 + " "
    assert leaked(spark, [alike, leak, alike + far + leak, leak + far + alike, alike + far + alike]) == {1, 2, 3}


def test_leaks_in_long_texts_short_items_and_empty_tables(spark):
    long = "word soup without end " * 60_000
    assert leaked(spark, [long + ITEM + long]) == {0}
    assert leaked(spark, ["we say good morning today", "good day"], (("S", "Good morning"), ("N", None), ("E", ""))) == {0}
    assert leaked(spark, []) == set() and leaked(spark, [ITEM], ()) == set()


def test_slots_must_correspond():
    it, dt = L.canonical("row 1 and row 2 and row 1 again"), L.canonical("row 5 and row 6 and row 7 again")
    pairs = [(i, i) for i in range(len(it[0]))]
    assert L.consistent(*it[:2], *dt[:2], pairs) == len(pairs) - 1
    assert L.canonical("Dose: 5,000.5 nM of CMP0012 in 3 Hours")[0] == ["dose", "<n>", "<u>", "of", "<id>", "in", "<n>", "<u>"]


def test_names_are_placeholders_beside_their_words(spark):
    tokens, _, names = L.canonical("On Monday the nurse met Maria Lopez and gave her the pen. Later it rained on all the sheets and the nurse left for the day with her own pen.")
    assert [t for t, n in zip(tokens, names) if n] == ["monday", "maria", "lopez"]
    assert not any(L.canonical("Der Arzt gab dem Kind das Buch und der Hund sah den Ball im Garten.")[2])  # nouns in capitals mark no names
    item = "when the clerk asked about the missing ledger, Maria Lopez said that Carlos Brandt had taken it to the cellar, and Maria Lopez never saw it again before the old mill was closed"
    other = item.replace("Maria Lopez", "Anna Keller").replace("Carlos Brandt", "Peter Novak")
    mixed = item.replace("Maria Lopez", "Anna Keller", 1).replace("Carlos Brandt", "Anna Keller")
    d = spark.createDataFrame([(0, item), (1, other), (2, mixed), (3, "nothing of the kind " * 20)], "doc_id bigint, text string")
    e = spark.createDataFrame([("E1", item)], "item_id string, text string")
    got = {r["doc_id"]: r for r in L.reparameterised(d, e).collect()}
    assert set(got) >= {1} and 0 not in got and got[1]["renamed"] == pytest.approx(6 / 32, abs=0.02)
    assert 2 not in got or got[2]["renamed"] < got[1]["renamed"]  # a name that stands for two others is no renaming


def test_stock_phrases_of_many_items_are_left_out_but_lose_no_leak(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_ITEMS", 3)
    rng = random.Random(2)
    stock = "as every reader of these pages knows"
    body = lambda: " ".join(f"w{rng.randrange(900)}x".replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")) for _ in range(40))
    items = [(f"E{i}", f"{stock} {body()}") for i in range(8)] + [("H", stock)]
    assert leaked(spark, [t for _, t in items[:2]] + [stock, body()], items) == {0, 1, 2}


def test_quotas_use_the_smallest_source_and_every_token():
    goal = [("big", 0.9, 1), ("tiny", 0.1, 2)]
    for scale in (1, 1000, 10**6):
        supply = {"big": 4_000 * scale, "tiny": 150}
        unit = X.block_size(supply, goal)
        q = X.source_quotas(supply, goal, None, unit)
        used = {s: b * unit for s, b in q.items()}
        assert used["tiny"] > 0.95 * 300 * min(1, supply["big"] / 2700) and abs(used["tiny"] / sum(used.values()) - 0.1) < 0.01
    got = X.shard_quotas([600] * 64, 1, 38_000, 512)
    assert sum(got) == 38_000 and max(got) <= 600
    assert sum(X.shard_quotas([244] * 4096, 3, 4096 * 244 * 3, 512)) == 4096 * 244 * 3 and X.shard_quotas([], 2, 5, 4) == []


def test_probe_codes_differ_in_one_digit_by_the_least_loss():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(50, 128)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    dense = v
    for s in N.signs(128, 3000):
        dense = (dense * s) @ N.hadamard(128)
    assert np.allclose(N.rotate(v, 3000), dense, atol=1e-5)
    own, alt = N.codes(v, [128, 4], 3, 2)
    assert alt.shape == (50, 2) and all(len({o, *a}) == 3 for o, a in zip(own, alt.tolist()))
    y = [N.rotate(v, 3000 + k)[:, :m] for k, m in enumerate((128, 4))]
    for i in range(50):
        gaps = {}
        for k, m in enumerate((128, 4)):
            o = np.argsort(-np.abs(y[k][i]), kind="stable")
            axis = lambda j: 2 * int(o[j]) + int(y[k][i][o[j]] < 0)
            for j in (1, 2):
                gaps[(axis(j) - axis(0)) * (8 if k == 0 else 1) + own[i]] = abs(y[k][i][o[0]]) - abs(y[k][i][o[j]])
        assert sorted(gaps, key=gaps.get)[:2] == alt[i].tolist()


def test_sainte_lague_against_the_plain_procedure():
    rng = random.Random(0)
    for _ in range(80):
        n = rng.randrange(1, 6)
        w, caps, seats = [rng.choice([0.0, rng.random()]) for _ in range(n)], [rng.randrange(0, 30) for _ in range(n)], rng.randrange(0, 60)
        got, want = X.sainte_lague(w, seats, caps), [0] * n
        for _ in range(seats):
            open_ = [i for i in range(n) if w[i] > 0 and want[i] < caps[i]]
            if not open_:
                break
            i = max(open_, key=lambda i: (w[i] / (2 * want[i] + 1), -i))
            want[i] += 1
        assert got == want


needs_tokenizer = pytest.mark.skipif(not os.path.exists(f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"), reason="no tokenizer files here")


@needs_tokenizer
def test_mix_reaches_its_shares_within_the_repeats(spark):
    rng = random.Random(0)
    docs = [(i, rng.choice(["a", "A ", "b-x", "b_x", "c", None]), "some words of text " * rng.randrange(1, 30), 9) for i in range(3000)] + [(9001, "a", None, 1), (9002, "a", "", 1), (9003, "zzz", "unused", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string, repeats int")
    w = spark.createDataFrame([("a", 0.5, 1), ("b_x", 0.2, 3), ("c", 0.2, 4), ("gone", 0.1, 2), ("a", 0.5, 1), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    m = X.mix(d, w, block=64)
    got = {r["source"]: r for r in X.shares(m, w).collect()}
    assert set(got) == {"a", "b_x", "c", "gone"} and got["gone"]["tokens"] == 0
    for s, share in (("a", 0.5 / 0.9), ("b_x", 0.2 / 0.9), ("c", 0.2 / 0.9)):
        assert abs(got[s]["actual_share"] - share) < 0.01 and got[s]["most_repeats"] <= got[s]["max_repeats"]
    assert m.count() == m.select("doc_id").distinct().count() and rows(m) == rows(X.mix(d.repartition(5), w, block=64))
    assert X.mix(d.limit(0), w).count() == 0 and X.mix(d, w.limit(0)).count() == 0


TOPICS = {"cooking": "pan stove butter onion simmer taste salt oven dough knead", "sailing": "mast rudder harbour knot keel wind deck anchor tide crew", "music": "chord violin rhythm tempo melody choir tune concert drum note"}
FILLER = "the item was noted again today and nothing changed since then for now".split()


def sentence(rng, words):
    return " ".join(rng.choice(words.split()) if rng.random() < 0.75 else rng.choice(FILLER) for _ in range(9)).capitalize() + "."


def test_subjects_of_held_out_documents(spark):
    rng = random.Random(7)
    docs, truth = [], {}
    for i in range(400):
        topics = rng.sample(sorted(TOPICS), rng.choice([1, 1, 2, 0]))
        body = [sentence(rng, TOPICS[t]) for t in topics for _ in range(4)] + [" ".join(rng.sample(FILLER, 8)) + "." for _ in range(3)]
        rng.shuffle(body)
        docs.append((i, " ".join(body), "x"))
        truth[i] = set(topics)
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "!!!", "x")]
    labels = [(i, s.upper() + " ") for i in range(80) for s in truth[i]] + [(5, "nonsense"), (77777, "music"), (None, "music")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    a = spark.createDataFrame([(t, w.split()[0]) for t, w in TOPICS.items()] + [(None, "x"), ("music", "chord")], "subject string, description string")
    got = S.subjects(d, a, spark.createDataFrame(labels, "doc_id bigint, subject string"))
    found = {}
    for r in got.collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    held = range(80, 400)
    tp = sum(len(found.get(i, set()) & truth[i]) for i in held)
    assert tp / sum(len(truth[i]) for i in held) > 0.93 and tp / sum(len(found.get(i, ())) for i in held) > 0.93
    assert not {1000, 1001, 1002} & set(found)


def test_subjects_of_nothing(spark):
    d, a, lab = (spark.createDataFrame([], s) for s in ("doc_id bigint, text string", "subject string, description string", "doc_id bigint, subject string"))
    assert S.subjects(d, a, lab).count() == 0
    areas = spark.createDataFrame([("music", "chord tune")], "subject string, description string")
    assert S.subjects(d, areas, lab).count() == 0
    assert S.calibrated([], {}, ["music"]) == {"music": pytest.approx(0.3)}
