"""Same or near-same records across splits, by bit fingerprints whose segments are joined.

1. A record is seen through *views*, choices of its attributes that would make it a repeat. A view's text is the words of its attributes; its tokens are the words, tagged
   with their attribute, and the shingles of five words (of all words where there are fewer). Its fingerprint is a similarity hash: every token
   adds the +1 and -1 bits of its hash by its weight, and the signs of the sums are the bits, so texts with most of their tokens in common differ in few bits.
2. A fingerprint has ``radius + 1`` segments of 64 bits. Fingerprints within the Hamming radius agree in at least one segment (pigeonhole), so an equi-join of
   segments across splits meets every such pair; a pair is kept where its first equal segment met it, and only if its Hamming distance is within the radius.
3. Candidates are verified on the texts themselves: the words in common of all words, 1 for texts that are equal. No hash collision survives and no link within
   the radius is lost. Verified pairs are aggregated by split and source.

Defined cases: a NULL attribute (or one that is no id) takes its views out; a record without any view has no partner;
rows repeated in either table count once; a record of both sides is a case with itself; other roles are ignored;
empty tables give an empty result; texts are read whole. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from assaymill.functions.ids import strict_id, trimmed

RADIUS = 1  #: bits in which fingerprints may differ
SHINGLE = 5
KEPT = 100_000  #: short attribute values whose token sums a task remembers


def split_roles(folds: DataFrame, key: str = "sample_id", role: str = "role") -> DataFrame:
    """(sid, trains, role): one row per sample and evaluation role, or a row without a role for train only."""
    r = folds.select(F.col(key).alias("sid"), F.lower(trimmed(role)).alias("r")).filter(F.col("r").isin("train", "validation", "test") & F.col("sid").isNotNull())
    return r.groupBy("sid").agg(
        F.max(F.col("r") == "train").alias("trains"), F.max(F.col("r") == "validation").alias("validates"), F.max(F.col("r") == "test").alias("tests")
    )


def token_sums(tag: str, text: str, segments: int) -> np.ndarray:
    """Sums of the +1 and -1 bits of an attribute's tokens: its words and its shingles of SHINGLE words, a shingle weighing as much as two words."""
    words = text.split()
    shingles = [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    total = np.zeros(64 * segments, np.int32)
    for weight, tokens in ((1, words), (2, shingles)):
        data = b"".join(xxhash.xxh3_128_digest(f"{weight}:{tag}:{t}", seed) for t in tokens for seed in range((segments + 1) // 2))
        bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(len(tokens), -1)[:, : 64 * segments]
        total += weight * (2 * bits.sum(0, dtype=np.int32) - len(tokens))
    return total


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(columns: list[pa.Array], views: list[tuple[int, ...]], segments: int, known: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per view the rows that have all its attributes, and their fingerprints as int64 segments. Tokens are hashed once per distinct value, rows are sums of arrays."""
    values = []
    for a, col in enumerate(columns):
        coded = col.dictionary_encode()
        rows = []
        for x in coded.dictionary.to_pylist():
            if (a, x) not in known:
                if len(known) >= KEPT:
                    known.clear()
                known[a, x] = token_sums(str(a), x, segments), xxhash.xxh3_64_intdigest(x, a)
            rows.append(known[a, x])
        sums = np.stack([r[0] for r in rows]) if rows else np.zeros((0, 64 * segments), np.int32)
        values.append((coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), sums, np.array([r[1] for r in rows], np.uint64)))
    out = []
    for v in views:
        there = np.flatnonzero(np.all([values[a][0] >= 0 for a in v], axis=0))
        total = np.zeros((len(there), 64 * segments), np.int32)
        joint = np.zeros(len(there), np.uint64)
        for a in v:
            index = values[a][0][there]
            total += values[a][1][index]
            joint = _mixed(joint * np.uint64(3) + values[a][2][index])
        # opposite values leave sums of 0: there the bits of the values' joint hash, which weighs less than any token, decide
        tie = np.stack([_mixed(joint + np.uint64(j + 1)) for j in range(segments)], 1)
        bits = np.unpackbits(tie.astype(">u8").view(np.uint8).reshape(len(there), -1), axis=1)
        total = 2 * total + 2 * bits.astype(np.int32) - 1
        out.append((there, np.packbits(total > 0, axis=1).view(">i8").astype(np.int64)))
    return out


def fingerprint_rows(rows: DataFrame, key: str, attributes: dict[str, str], views: list[tuple[str, ...]], radius: int, clean: Callable[[str], Column]) -> DataFrame:
    """(sid, b, text, fp): a row per record and view whose attributes are all present; ``fp`` is the fingerprint's array of segments."""
    names = list(attributes)
    at = [tuple(names.index(a) for a in v) for v in views]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            cols = [b.column(i + 1) for i in range(len(names))]
            for v, (there, fp) in enumerate(fingerprints(cols, at, radius + 1, known)):
                take = pa.array(there, pa.int64())
                text = pc.binary_join_element_wise(*[cols[a].take(take) for a in at[v]], "\x1f")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1) * (radius + 1), pa.int32()), pa.array(fp.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(np.full(len(there), v), pa.int32()), text, lists], ["sid", "b", "text", "fp"])

    slim = rows.select(F.col(key).cast("string").alias("sid"), *[clean(c).alias(f"a{i}") for i, c in enumerate(attributes.values())]).filter("sid IS NOT NULL").distinct()
    return slim.mapInArrow(run, "sid string, b int, text string, fp array<bigint>")


def cross_split_pairs(
    rows: DataFrame, folds: DataFrame, key: str, attributes: dict[str, str], views: list[tuple[str, ...]], least: float = 1.0, radius: int = RADIUS, clean: Callable[[str], Column] = strict_id
) -> DataFrame:
    """(train_id, eval_id): every train record and evaluation record with a view whose fingerprints lie within the radius and whose texts are similar by at least
    ``least`` (1: equal texts); includes records with themselves.

    Roles reach the fingerprints through one shuffle on the record id. A hot segment is split by the adaptive skew join: its partition of either side is cut and
    met by copies of the other.
    """
    roles = split_roles(folds)
    facts = fingerprint_rows(rows, key, attributes, views, radius, clean).join(roles, "sid").distinct()
    cut = facts.select("sid", "trains", (F.col("validates") | F.col("tests")).alias("evaluates"), "b", "text", "fp", F.posexplode("fp").alias("j", "code"))
    side = lambda c, s: cut.filter(c).select("b", "j", "code", F.col("sid").alias(f"{s}_id"), F.col("text").alias(f"{s}_text"), F.col("fp").alias(f"{s}_fp"))
    met = side("trains", "train").join(side("evaluates", "eval"), ["b", "j", "code"])
    same = F.zip_with("train_fp", "eval_fp", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    within = (F.array_position(same, F.lit(0)) == F.col("j") + 1) & (F.aggregate(same, F.lit(0), lambda a, x: a + x) <= radius)
    words = lambda c: F.array_distinct(F.split(c, r"[\s\x1f]+"))
    x, y = words("train_text"), words("eval_text")
    equal = F.col("train_text") == F.col("eval_text")
    similar = equal if least >= 1 else equal | (F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)) >= least)
    both = roles.filter("trains AND (validates OR tests)").select(F.col("sid").alias("train_id"), F.col("sid").alias("eval_id"))
    return met.filter(within & similar).select("train_id", "eval_id").unionByName(both).distinct()


def overlap_report(pairs: DataFrame, rows: DataFrame, folds: DataFrame, key: str, source: str) -> DataFrame:
    """(role, source, n_eval, n_pairs): overlapping evaluation records and pairs per role and source of the evaluation record's
    rows; a record delivered under two sources counts for both, a missing source is counted as NULL."""
    hits = pairs.groupBy(F.col("eval_id").alias("sid")).agg(F.count(F.lit(1)).alias("n"))
    src = rows.select(F.col(key).alias("sid"), F.nullif(trimmed(source), F.lit("")).alias("source")).join(hits, "sid", "left_semi").distinct()
    r = hits.join(split_roles(folds), "sid").withColumn(
        "role", F.explode(F.array_compact(F.array(F.when(F.col("validates"), "validation"), F.when(F.col("tests"), "test"))))
    )
    return r.join(src, "sid", "left").groupBy("role", "source").agg(F.count(F.lit(1)).alias("n_eval"), F.sum("n").alias("n_pairs"))
