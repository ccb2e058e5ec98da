"""Subject areas of documents by subject-specific interpolated n-gram language models.

1. Texts are cut into sentences and canonical tokens (case folded words, CJK characters, placeholders for numbers and identifiers); the
   ids of unigrams and bigrams are hashed to tables of fixed size and kept as a table, so every pass reads numbers, not texts.
2. One model per subject and a background model for what has no subject: P(w | h) interpolates bigram, unigram and uniform estimates,
   normalised within the sentence's language (told by script and function words), so that rare languages compete on equal terms.
   The first models come from the labelled documents (at most ``LABELLED`` of them, by hash) and the subjects' descriptions; the background
   from the whole corpus. Expectation-maximisation over *all* documents then assigns sentences to models, with subject shares per
   document (a labelled document may use its labels and the background, others with a small probability), and recounts.
3. A sentence belongs to the subject whose cross-entropy per token is lowest, if it is below the background's; a subject is accepted when its
   sentences make up at least a calibrated share of the document's subject matter. Each subject's share is the one with the best F1, within ``SHARES``, on a
   quarter of the labels that fits no model. Several subjects may be accepted.

Defined cases: NULL and empty texts and texts without subject matter get no row; unknown subjects in labels are ignored; labels of missing
documents, repeated labels and repeated subjects count once; without any labels the descriptions alone start the models; a document of any length
is read whole; an empty corpus gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from assaymill.functions.ids import trimmed
from assaymill.session import settle

UNI, BI = 1 << 16, 1 << 18
LABELLED = 20_000
HEAT = (0.1, 0.2, 0.4, 0.7, 1.0, 1.0)  #: weight of the evidence in the passes after the first, so that none commits too early
BACKGROUND = 3.0  #: prior weight of the background against a subject
MIX = (0.62, 0.33, 0.05)  #: bigram, unigram, uniform
SHARES = (0.2, 0.4)
LEAST_LABELS = 20  #: labelled documents that set a subject's own limit
CJK = "぀-ヿ㐀-鿿豈-﫿"
TOKEN = re.compile(rf"(?P<id>[^\W\d_{CJK}]+[-_]?\d[^\W_{CJK}]*)|(?P<num>\d+(?:[.,:]\d+)*)|[{CJK}]|(?:(?![{CJK}])[^\W\d_])+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|[\n。!?;]+")
ASIDE = re.compile(r"\([^()]*\)|;\s[^;]*$")  #: a parenthesis or a clause after the last semicolon may have another matter
#: Function words that tell languages written in Latin script.
FUNCTION_WORDS = (
    frozenset("the of and to is was were that for with by from at as it its be are this which but not has had".split()),
    frozenset("der die das und ist nicht ein eine einer wurde mit von für auf zu im dem den des sich bei nach aus als wird sind".split()),
    frozenset("el la los las de del un una se que y en con por para al su es lo fue como tras".split()),
)
LANGUAGES = len(FUNCTION_WORDS) + 2  #: those, CJK and any other
INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))


@lru_cache(maxsize=200_000)
def _id(t: str) -> int:
    return xxhash.xxh32_intdigest(t)


def language(words: list[str]) -> int:
    if 2 * sum(len(w) == 1 and w > "\u3000" for w in words) > len(words):
        return LANGUAGES - 2
    votes = [sum(w in f for w in words) for f in FUNCTION_WORDS]
    return votes.index(max(votes)) if max(votes) else LANGUAGES - 1


def sentences(text: str) -> list[tuple[int, list[int]]]:
    """Language and token hashes per sentence; sentences without a token are left out, an aside is a sentence of its own."""
    text = unicodedata.normalize("NFKC", text.translate(INVISIBLE))
    out = []
    for s in SENTENCE.split(text):
        s = s.casefold()
        for piece in (ASIDE.sub(" ", s), *ASIDE.findall(s)):
            words = [(m.lastgroup, m.group()) for m in TOKEN.finditer(piece)]
            if words:
                out.append((language([w for _, w in words]), [_id("<id>" if k == "id" else "<n>" if k == "num" else w) for k, w in words]))
    # a sentence without any function word speaks the language most of the text does
    told = [x for x, _ in out if x < LANGUAGES - 1]
    most = max(set(told), key=told.count) if told else LANGUAGES - 1
    return [(most if x == LANGUAGES - 1 else x, t) for x, t in out]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, seed, u, g, n, lang = [], [], [], [], [], []
        for i, t, of in zip(*(b.column(k).to_pylist() for k in range(3))):
            ss = sentences(t or "")
            if not ss:
                continue
            h = np.array([x for _, s in ss for x in s], np.uint64)
            sizes = [len(s) for _, s in ss]
            lang.append(np.array([x for x, _ in ss], np.int32))
            before = np.concatenate([[np.uint64(1)], h[:-1]])
            before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = 1  # a sentence starts afresh
            mix = (before * np.uint64(0x9E3779B97F4A7C15) + h) * np.uint64(0xC2B2AE3D27D4EB4F)
            ids.append(i)
            seed.append(of)
            # the unigram and the history share a hash, so that counts of histories are unigram counts
            u.append(((h & np.uint64(UNI - 1)).astype(np.int32), (before & np.uint64(UNI - 1)).astype(np.int32)))
            g.append((mix >> np.uint64(64 - 18)).astype(np.int32))
            n.append(np.array(sizes, np.int32))
        if not ids:
            continue
        cut = lambda xs: pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut(xs), pa.array(np.concatenate(xs))) for xs in ([x for x, _ in u], [x for _, x in u], g, n, lang)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seed, pa.int32()), *lists], ["doc_id", "seed", "u", "h", "g", "n", "l"])


class Models:
    """Hashed counts per class; class 0 is the background."""

    def __init__(self, uni: np.ndarray, bi: np.ndarray, total: np.ndarray):
        self.uni, self.bi = uni.astype(np.float32), bi.astype(np.float32)  # (UNI, k), (BI, k)
        self.total = np.maximum(total, 20.0).astype(np.float32)  # (LANGUAGES, k): tokens of a language; a few at least
        self.words = max(1, int((self.uni.sum(1) > 0).sum()))

    def log_likelihood(self, u: np.ndarray, h: np.ndarray, g: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """(tokens, classes)"""
        a, b, c = MIX
        total = self.total[lang]
        history = np.where(h[:, None] == 1, total, self.uni[h])  # sentence starts: all tokens as history
        p2 = self.bi[g] / np.maximum(history, 1e-6)
        return np.log(a * np.minimum(p2, 1) + b * np.minimum(self.uni[u] / total, 1) + c / self.words)


def _ragged(b: pa.RecordBatch):
    """Token arrays with the language, sentence starts, tokens per sentence and document index per sentence of a batch."""
    n = b.column("n")
    sizes = n.flatten().to_numpy()
    per_doc = np.diff(n.offsets.to_numpy())
    return (*(b.column(c).flatten().to_numpy() for c in ("u", "h", "g")), np.repeat(b.column("l").flatten().to_numpy(), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes, np.repeat(np.arange(b.num_rows), per_doc))


def responsibilities(ll: np.ndarray, doc: np.ndarray, n_docs: int, allowed: np.ndarray | None = None, rounds: int = 4) -> np.ndarray:
    """P(class | sentence) with class shares per document, found by a few inner rounds. ``allowed``: prior weights (docs, classes)."""
    k = ll.shape[1]
    prior = np.ones((n_docs, k)) if allowed is None else allowed.copy()
    prior[:, 0] *= BACKGROUND
    share = prior / prior.sum(1, keepdims=True)
    top = ll.max(1, keepdims=True)
    like = np.exp(ll - top)
    for _ in range(rounds):
        r = like * share[doc]
        r /= r.sum(1, keepdims=True)
        share = np.zeros((n_docs, k))
        np.add.at(share, doc, r)
        share = (share + 0.1) * prior
        share /= share.sum(1, keepdims=True)
    return r


def _count(shared, heat: float):
    """Weighted counts of a partition as rows (slot, counts); unigram slots lie behind the bigram slots, languages' totals last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, labels, k = shared.value
        out = np.zeros((BI + UNI + LANGUAGES, k), np.float64)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                u, h, g, lang, start, sizes, doc = _ragged(part)
                ids, seeds = part.column("doc_id").to_pylist(), part.column("seed").to_pylist()
                prior = np.ones((len(ids), k))
                known = np.zeros(len(ids), bool)
                for i, (x, of) in enumerate(zip(ids, seeds)):
                    if of or x in labels:  # the description of a subject, or a labelled document
                        known[i] = True
                        prior[i] = 0.01
                        prior[i, 0] = 1
                        prior[i, of or labels[x]] = 1
                if models is None:
                    w = np.where(known[:, None], prior >= 1, 0.0)
                    w[:, 1:] /= np.maximum(w[:, 1:].sum(1, keepdims=True), 1)
                    w[:, 0] = np.array([not of for of in seeds])  # descriptions are no background
                    r = w[doc]
                else:
                    ll = np.add.reduceat(models.log_likelihood(u, h, g, lang), start, axis=0)
                    r = responsibilities(heat * ll, doc, len(ids), prior)
                each = np.repeat(r, sizes, axis=0)
                for c in range(k):
                    out[:BI, c] += np.bincount(g, each[:, c], BI)
                    out[BI : BI + UNI, c] += np.bincount(u, each[:, c], UNI)
                    out[BI + UNI :, c] += np.bincount(lang, each[:, c], LANGUAGES)
        slots = np.flatnonzero(out.sum(1) > 1e-9)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(slots) + 1) * k, pa.int32()), pa.array(out[slots].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), lists], ["slot", "w"])

    return run


def _collect(encoded: DataFrame, shared, k: int, heat: float) -> Models:
    """Sum the partitions' counts; at most BI + UNI + LANGUAGES rows reach the driver, whatever the corpus."""
    rows = encoded.mapInArrow(_count(shared, heat), "slot int, w array<double>")
    total = rows.groupBy("slot").agg(*[F.sum(F.col("w")[c]).alias(f"w{c}") for c in range(k)])
    out = np.zeros((BI + UNI + LANGUAGES, k))
    for r in total.toLocalIterator(prefetchPartitions=True):
        out[r[0]] = r[1:]
    return Models(out[BI : BI + UNI], out[:BI], out[BI + UNI :])


def _score(shared):
    """Share of each subject among a document's subject matter: sentences by their tokens, where the subject's model beats the background's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, names = shared.value
        for b in batches:
            docs, subjects, shares_ = [], [], []
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                u, h, g, lang, start, sizes, doc = _ragged(part)
                ll = np.add.reduceat(models.log_likelihood(u, h, g, lang), start, axis=0)
                gain = (ll - ll[:, :1]) / sizes[:, None]  # cross-entropy per token below the background's
                best = gain.argmax(1)
                own = gain[np.arange(len(best)), best]
                weight = np.where((best > 0) & (own > 0), np.sqrt(sizes), 0.0)  # headings and stubs count less than sentences
                mass = np.zeros((part.num_rows, len(names) + 1))
                np.add.at(mass, (doc, best), weight)
                total = mass[:, 1:].sum(1)
                i, c = np.nonzero(mass[:, 1:])
                ids = np.array(part.column("doc_id").to_pylist())
                docs.append(ids[i])
                subjects += [names[x] for x in c]
                shares_.append(mass[i, c + 1] / total[i])
            flat = lambda xs, t: pa.array(np.concatenate(xs) if xs else [], t)
            yield pa.RecordBatch.from_arrays([flat(docs, pa.int64()), pa.array(subjects, pa.string()), flat(shares_, pa.float64())], ["doc_id", "subject", "share"])

    return run


def subject_shares(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, list[str]]]:
    """((doc_id, subject, share), the labels used)."""
    spark = docs.sparkSession
    told = areas.select(F.lower(trimmed("subject")).alias("subject"), F.coalesce("description", F.lit("")).alias("text")).filter("subject IS NOT NULL AND subject <> ''").groupBy("subject").agg(F.min("text").alias("text")).orderBy("subject").collect()
    names = [r["subject"] for r in told]
    index = {s: i + 1 for i, s in enumerate(names)}
    given = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(trimmed("subject")).alias("subject")).filter(F.col("subject").isin(names) & F.col("doc_id").isNotNull())
    per = given.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("s")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    known = {r["doc_id"]: list(r["s"]) for r in per.collect()}
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(0).alias("seed")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    seeds = spark.createDataFrame([(i, f"{r['subject'].replace('_', ' ')}. {r['text']}", i + 1) for i, r in enumerate(told)], "doc_id bigint, text string, seed int")
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    encoded = settle(texts.unionByName(seeds).repartition(width, "doc_id").mapInArrow(_encode, "doc_id bigint, seed int, u array<int>, h array<int>, g array<int>, n array<int>, l array<int>"))
    fitted = {d: ss for d, ss in known.items() if not held_apart(d)}
    marks = {d: [index[s] for s in ss] for d, ss in fitted.items()}
    k = len(names) + 1
    models = None
    for heat in (0.0, *HEAT):
        shared = spark.sparkContext.broadcast((models, marks, k))
        models = _collect(encoded, shared, k, heat)
        shared.unpersist()
    shared = spark.sparkContext.broadcast((models, names))
    return encoded.filter("seed = 0").mapInArrow(_score(shared), "doc_id bigint, subject string, share double"), known


def held_apart(doc_id: int) -> bool:
    """A quarter of the labelled documents, by hash, calibrates and fits no model."""
    return xxhash.xxh32_intdigest(str(doc_id), 3) % 4 == 0


def calibrated(shares: list[tuple[int, str, float]], known: dict[int, list[str]], names: list[str]) -> dict[str, float]:
    """Per subject the acceptance share with the best F1 on labelled documents, within SHARES; the middle of the best range.

    A subject with fewer than LEAST_LABELS labelled documents takes the share that is best for all subjects together.
    """
    at = np.arange(SHARES[0], SHARES[1] + 1e-9, 0.01)
    truth = {(d, s) for d, ss in known.items() for s in ss}
    rows = [(s, v, (d, s) in truth) for d, s, v in shares if d in known]

    def best(of: list, n_true: int) -> float:
        v, y = np.array([r[1] for r in of]), np.array([r[2] for r in of])
        f1 = np.array([2 * (y & (v >= t)).sum() / max(1, (v >= t).sum() + n_true) for t in at])
        return float(np.median(at[f1 >= f1.max() - 1e-9]))

    pooled = best(rows, len(truth)) if rows and truth else float(np.mean(SHARES))
    out = {}
    for s in names:
        own, n = [r for r in rows if r[0] == s], sum(x == s for _, x in truth)
        out[s] = best(own, n) if own and n >= LEAST_LABELS else pooled
    return out


def accepted(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, list[str]]]:
    """((doc_id, subject, share, least, accepted), the labels that fitted no model)."""
    spark = docs.sparkSession
    shares, known = subject_shares(docs, areas, labels)
    shares = settle(shares)
    apart = {d: ss for d, ss in known.items() if held_apart(d)}
    ids = spark.createDataFrame([(d,) for d in apart], "doc_id bigint")
    sample = [(r["doc_id"], r["subject"], r["share"]) for r in shares.join(F.broadcast(ids), "doc_id", "left_semi").collect()]  # at most LABELLED documents
    names = sorted({s for s in [r[0] for r in shares.select("subject").distinct().collect()]})
    limits = spark.createDataFrame(list(calibrated(sample, apart, names).items()), "subject string, least double")
    return shares.join(F.broadcast(limits), "subject").withColumn("accepted", F.col("share") >= F.col("least")), apart


def subjects(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, share) of accepted subjects."""
    return accepted(docs, areas, labels)[0].filter("accepted").select("doc_id", "subject", "share")


def held_out_quality(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject, n_true, n_found, n_both, recall, precision) on labelled documents that neither fitted a model nor set a limit: the half of
    the labels held apart whose limits come from the other half, and the other way round."""
    spark = docs.sparkSession
    shares, known = subject_shares(docs, areas, labels)
    apart = {d: ss for d, ss in known.items() if held_apart(d)}
    ids = spark.createDataFrame([(d,) for d in apart], "doc_id bigint")
    rows = [(r["doc_id"], r["subject"], r["share"]) for r in shares.join(F.broadcast(ids), "doc_id", "left_semi").collect()]  # at most LABELLED documents
    names = sorted({s for ss in apart.values() for s in ss} | {s for _, s, _ in rows})
    count = {s: [0, 0, 0] for s in names}
    for side in (0, 1):
        half = lambda d: xxhash.xxh32_intdigest(str(d), 4) % 2 == side
        limits = calibrated([r for r in rows if not half(r[0])], {d: ss for d, ss in apart.items() if not half(d)}, names)
        truth = {(d, s) for d, ss in apart.items() if half(d) for s in ss}
        found = {(d, s) for d, s, v in rows if half(d) and v >= limits[s]}
        for i, pairs in enumerate((truth, found, truth & found)):
            for _, s in pairs:
                count[s][i] += 1
    out = spark.createDataFrame([(s, *c) for s, c in count.items()], "subject string, n_true bigint, n_found bigint, n_both bigint")
    return out.withColumn("recall", F.try_divide("n_both", "n_true")).withColumn("precision", F.try_divide("n_both", "n_found"))
