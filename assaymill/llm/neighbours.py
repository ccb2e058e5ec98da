"""The k most similar vectors of every vector, by cross-polytope hashing.

1. Vectors are validated, packed and grouped with their copies (for expression: equal directions, whatever the scale); a group is searched
   once, however many copies it has, and keeps its k + 1 smallest ids: no more can be anyone's neighbour.
2. Each table applies a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) and assigns the vector
   to the nearest signed axis; further digits, as many as the number of vectors asks for, come from further rotations. A vector is stored
   under its own code and also queries the codes in which one digit has a farther axis, by the least loss first (multiprobe).
3. Buckets are scored exactly in float64 (cosine) or by bit counts (Tanimoto). A bucket beyond ``BUCKET`` rows is scored whole
   as pairs of blocks in separate tasks: nothing is capped or dropped, at a cost that grows with the square of its rows.
4. The best k groups of each group over all tables are expanded to ids, ties to the smaller id.

Defined cases: NULL, incomplete, non-finite, wrong-length and all-zero vectors take no part; a lone vector has no pair;
an empty table gives an empty result; fewer than k others give fewer neighbours; NULL ids take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from assaymill.session import discard, settle

BUCKET = 4096  #: rows of a bucket scored in one piece
PER_BUCKET = 32  #: vectors per bucket that the number of digits aims at
HOT_BROADCAST = 100_000  #: large buckets up to which their list is broadcast
BUNDLE = 6000  #: rows scored by one call of the Python function

KINDS = {"expression": (128, 128), "fingerprints": (2048, 256)}  #: full length, hashed length
TABLES = {"expression": 8, "fingerprints": 14}  #: neighbours of fingerprints are farther apart
PROBES = {"expression": 2, "fingerprints": 2}  #: further buckets a vector visits in each table


@lru_cache(maxsize=16)
def hadamard(d: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < d:
        h = np.block([[h, h], [h, -h]])
    return h / np.float32(math.sqrt(d))


def fast_hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of d = a b as two small products (H_d is the Kronecker product of H_a and H_b): d (a + b) instead of d^2 steps a row."""
    n, d = x.shape
    b = 1 << (d.bit_length() // 2)
    return np.matmul(hadamard(d // b), np.matmul(x.reshape(n, d // b, b), hadamard(b))).reshape(n, d)


@lru_cache(maxsize=512)
def signs(d: int, *seed: int) -> np.ndarray:
    return np.random.default_rng([*seed, d]).choice(np.array([-1, 1], np.float32), (3, d))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """The pseudo-rotation of rows: three rounds of random signs and a fast Hadamard transform."""
    for s in signs(x.shape[1], seed):
        x = fast_hadamard(x * s)
    return x


def digit(y: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest signed axes, ``probes`` + 1 of them, and how much farther than the first each is; an axis that is not there is infinitely far."""
    n, m = y.shape
    a = np.abs(y)
    k = min(probes + 1, m)
    near = np.argpartition(-a, k - 1, axis=1)[:, :k] if k < m else np.broadcast_to(np.arange(m), (n, m))
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(a, near, 1), axis=1, kind="stable"), 1)
    size = np.take_along_axis(a, near, 1)
    axes = near * 2 + (np.take_along_axis(y, near, 1) < 0)
    pad = ((0, 0), (0, probes + 1 - k))
    return np.pad(axes, pad), np.pad(size[:, :1] - size, pad, constant_values=np.inf)


def codes(v: np.ndarray, sizes: list[int], table: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Own code of each row in a table, and the ``probes`` next best codes: one digit replaced by a farther axis, the least loss first (-1: there are no more)."""
    n = len(v)
    axes, loss = zip(*(digit(rotate(v, 1000 * table + k)[:, :m], probes) for k, m in enumerate(sizes)))
    weight = np.concatenate([np.cumprod([2 * m for m in sizes[:0:-1]], dtype=np.int64)[::-1], [1]]) if len(sizes) > 1 else np.ones(1, np.int64)
    own = sum(a[:, 0] * w for a, w in zip(axes, weight)).astype(np.int64)
    other = np.stack([(a[:, j] - a[:, 0]) * w for a, w in zip(axes, weight) for j in range(1, probes + 1)], 1)
    lost = np.stack([x[:, j] for x in loss for j in range(1, probes + 1)], 1)
    best = np.argsort(lost, axis=1, kind="stable")[:, :probes]
    alt = own[:, None] + np.take_along_axis(other, best, 1)
    return own, np.where(np.isfinite(np.take_along_axis(lost, best, 1)), alt, -1)


def digit_sizes(n: int, d: int) -> list[int]:
    """Axes per digit, so that there are about n / PER_BUCKET buckets; grows smoothly with n."""
    sizes, want = [d], n / PER_BUCKET / (2 * d)
    while want > 1:
        m = min(d, 1 << max(0, math.ceil(math.log2(want / 2))))
        sizes.append(m)
        want /= 2 * m
    return sizes


def unpack(vecs: list[bytes], kind: str) -> np.ndarray:
    full = KINDS[kind][0]
    if kind == "expression":
        return np.frombuffer(b"".join(vecs), np.float32).reshape(-1, full)
    return np.frombuffer(b"".join(vecs), np.uint64).reshape(-1, full // 64)


def hashed_view(m: np.ndarray, kind: str) -> np.ndarray:
    full, d = KINDS[kind]
    if kind == "expression":
        x = m.astype(np.float64)
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    out = np.empty((len(m), d), np.float32)
    for lo in range(0, len(m), 1024):  # random signs, then d rows of the transform: a Johnson-Lindenstrauss projection
        bits = np.unpackbits(m[lo : lo + 1024].view(np.uint8), axis=1).astype(np.float32)
        out[lo : lo + 1024] = fast_hadamard(bits / np.sqrt(bits.sum(1, keepdims=True)) * signs(full, 5, d)[0])[:, :d]
    return out


def similarities(q: np.ndarray, c: np.ndarray, kind: str) -> np.ndarray:
    """Rounded to 6 decimals, as integers."""
    if kind == "expression":
        q, c = q.astype(np.float64), c.astype(np.float64)
        s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    else:
        both = np.zeros((len(q), len(c)), np.int32)
        for w in range(q.shape[1]):
            both += np.bitwise_count(q[:, w, None] & c[None, :, w])
        s = both / (np.bitwise_count(q).sum(1)[:, None] + np.bitwise_count(c).sum(1)[None, :] - both)
    return np.rint(s * 1e6).astype(np.int64)


def _valid(kind: str, column: str):
    full = KINDS[kind][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arr = b.column(1)
            whole = pc.fill_null(pc.and_(pc.equal(pc.list_value_length(arr), full), pc.is_valid(b.column(0))), False)
            ids = b.column(0).filter(whole).to_numpy(zero_copy_only=False)
            m = arr.filter(whole).flatten().to_numpy(zero_copy_only=False).reshape(-1, full)
            with np.errstate(invalid="ignore"):
                good = (np.isfinite(m).all(1) if m.dtype.kind == "f" else np.ones(len(m), bool)) & (m != 0).any(1)
            ids, m = ids[good], m[good]
            if kind == "expression":
                m = np.ascontiguousarray(m, np.float32)
                wide = m.astype(np.float64)
                unit = np.rint(wide / np.linalg.norm(wide, axis=1, keepdims=True) * 1e5).astype(np.int32)
                keys = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in unit]
                vecs = [v.tobytes() for v in m]
            else:
                vecs = [v.tobytes() for v in np.packbits(m != 0, axis=1)]
                keys = [hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "vec", "gkey"])

    return run


def valid_vectors(vectors: DataFrame, kind: str, column: str | None = None, id_col: str = "vec_id") -> DataFrame:
    """(vec_id, vec, gkey) of the vectors that take part; repeated (id, vector) rows count once later."""
    column = column or kind
    src = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(column).alias("v")).filter(F.size("v") == KINDS[kind][0])
    return src.mapInArrow(_valid(kind, column), "vec_id bigint, vec binary, gkey binary")


def _coder(kind: str, sizes: list[int]):
    d, tables, probes = KINDS[kind][1], TABLES[kind], PROBES[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            v = hashed_view(unpack(b.column("vec").to_pylist(), kind), kind) if n else np.zeros((0, d), np.float32)
            own, alt = np.zeros((n, tables), np.int64), np.zeros((n, tables * probes), np.int64)
            for t in range(tables if n else 0):
                own[:, t], alt[:, t * probes : (t + 1) * probes] = codes(v, sizes, t, probes)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (own, alt)]
            yield pa.RecordBatch.from_arrays([b.column("gid"), b.column("ids"), b.column("vec"), *lists], ["gid", "ids", "vec", "own", "alt"])

    return run


def _scorer(kind: str, k: int):
    def run(table: pa.Table) -> pa.Table:
        b, cell, gid = (table.column(c).to_numpy() for c in ("b", "cell", "gid"))
        cand, query = (table.column(c).to_numpy() for c in ("cand", "query"))
        m = unpack(table.column("vec").to_pylist(), kind)
        order = np.lexsort((gid, cell, b))
        cuts = np.flatnonzero((np.diff(b[order]) != 0) | (np.diff(cell[order]) != 0)) + 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for run_ in np.split(order, cuts):
            cs, qs = run_[cand[run_]], run_[query[run_]]
            if not len(cs):
                continue
            for lo in range(0, len(qs), 512):
                q = qs[lo : lo + 512]
                out.append(best(gid[q], gid[cs], similarities(m[q], m[cs], kind), k))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({"gid": pa.array(cols[0], pa.int64()), "other": pa.array(cols[1], pa.int64()), "sim": pa.array(cols[2], pa.int64())})

    return run


def best(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, ties to the smaller id; candidates come sorted by id."""
    n = len(c)
    key = (s + 2_000_000) * n + (n - 1 - np.arange(n))
    key[q[:, None] == c[None, :]] = -1
    if n > k:
        take = np.argpartition(-key, k - 1, axis=1)[:, :k]
    else:
        take = np.broadcast_to(np.arange(n), (len(q), n))
    rows = np.repeat(np.arange(len(q)), take.shape[1])
    flat = take.ravel()
    keep = key[rows, flat] >= 0
    return q[rows[keep]], c[flat[keep]], s[rows[keep], flat[keep]]


def copy_groups(valid: DataFrame, k: int) -> DataFrame:
    """(gid, ids, vec, gkey): gid is the smallest id of a group, ids its k + 1 smallest."""
    w = Window.partitionBy("gkey").orderBy("vec_id")
    first = valid.dropDuplicates(["gkey", "vec_id"]).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    return first.groupBy("gkey").agg(
        F.min("vec_id").alias("gid"), F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min_by("vec", "vec_id").alias("vec")
    )


def bucket_candidates(groups: DataFrame, kind: str, k: int) -> DataFrame:
    """(gid, other, sim): per group the k best found in each bucket it visits."""
    n = groups.count()
    coded = settle(groups.mapInArrow(_coder(kind, digit_sizes(n, KINDS[kind][1])), "gid bigint, ids array<bigint>, vec binary, own array<bigint>, alt array<bigint>"))
    probes = PROBES[kind]
    own = lambda *cols: coded.select(*cols, F.posexplode("own").alias("t", "code"))
    sizes = own().groupBy("t", "code").agg(F.count(F.lit(1)).alias("m"))
    big = settle(sizes.filter(F.col("m") > BUCKET).withColumn("blocks", F.ceil(F.col("m") / BUCKET).cast("int")))
    n_big, copies = big.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("m") * F.col("blocks") * (2 + probes)), F.lit(0))).first()
    big = big.select("t", "code", "blocks")
    visit = lambda t, code, cand: F.struct(t.cast("int").alias("t"), code.alias("code"), F.lit(cand).alias("cand"))
    visits = F.concat(F.transform("own", lambda c, t: visit(t, c, True)), F.filter(F.transform("alt", lambda c, i: visit(F.floor(i / probes), c, False)), lambda x: x["code"] >= 0))
    rows = coded.select("gid", "vec", F.explode(visits).alias("p")).select("gid", "vec", "p.*")
    if n_big == 0:
        rows = rows.withColumn("blocks", F.lit(None).cast("int"))
    else:  # a large bucket has more than BUCKET rows, so there are at most n x tables / BUCKET of them
        rows = rows.join(F.broadcast(big) if n_big <= HOT_BROADCAST else big, ["t", "code"], "left")
    block = F.pmod(F.xxhash64("gid"), F.col("blocks"))
    piece = lambda cell, cand, query: F.struct(cell.cast("bigint").alias("cell"), cand.alias("cand"), query.alias("query"))
    whole = F.array(piece(F.lit(0), F.col("cand"), F.lit(True)))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_query = F.transform(every, lambda i: piece(block * F.col("blocks") + i, F.lit(False), F.lit(True)))
    as_cand = F.transform(every, lambda j: piece(j * F.col("blocks") + block, F.lit(True), F.lit(False)))
    pieces = F.when(F.col("blocks").isNull(), whole).when(F.col("cand"), F.concat(as_query, as_cand)).otherwise(as_query)
    rows = rows.select("gid", "vec", F.xxhash64("t", "code").alias("b"), F.explode(pieces).alias("p")).select("gid", "vec", "b", "p.*")
    bundles = max(1, (n * TABLES[kind] * (1 + probes) + copies) // BUNDLE)
    scored = rows.groupBy(F.pmod(F.xxhash64("b", "cell"), F.lit(bundles)).alias("bundle")).applyInArrow(_scorer(kind, k), "gid bigint, other bigint, sim bigint")
    return scored


def neighbour_lists(vectors: DataFrame, kind: str, k: int = 5, column: str | None = None, id_col: str = "vec_id") -> DataFrame:
    """(vec_id, rank, other, sim): the k most similar others of every valid vector, sim rounded to 6 decimals."""
    valid = settle(valid_vectors(vectors, kind, column, id_col))
    groups = settle(copy_groups(valid, k))
    found = bucket_candidates(groups, kind, k).groupBy("gid", "other").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("gid").orderBy(F.desc("sim"), "other")
    top = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return expand(valid, groups, top, k)


def expand(valid: DataFrame, groups: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """From neighbours of groups to neighbours of vectors."""
    ids = groups.select(F.col("gid").alias("other"), F.col("ids").alias("oids"))
    near = top.join(ids, "other").select("gid", F.explode("oids").alias("other"), "sim")
    own = groups.filter(F.size("ids") > 1).select("gid", F.explode("ids").alias("other"), F.lit(1_000_000).cast("bigint").alias("sim"))
    lists = near.unionByName(own).groupBy("gid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), F.col("other").alias("o")))), 1, k + 1).alias("l"))
    members = valid.select("vec_id", "gkey").distinct().join(groups.select("gkey", "gid"), "gkey")
    mine = members.join(lists, "gid").select("vec_id", F.slice(F.filter("l", lambda x: x["o"] != F.col("vec_id")), 1, k).alias("l"))
    out = mine.select("vec_id", F.posexplode("l").alias("rank", "x"))
    return out.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("x.o").alias("other"), (-F.col("x.s") / 1e6).alias("sim"))


def exact_lists(vectors: DataFrame, kind: str, k: int = 5, every: int = 50) -> DataFrame:
    """Brute force in blocks for the query set of ids divisible by ``every``, as the measure of recall."""
    valid = settle(valid_vectors(vectors, kind))

    def pack(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, size):
                    s = b.slice(lo, size)
                    yield pa.RecordBatch.from_arrays([pa.array([s.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(s.column("vec").to_pylist())], pa.binary())], ["ids", "vecs"])

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                c = np.array(row["ids"])
                order = np.argsort(c)
                s = similarities(unpack([row["qvecs"]], kind), unpack([row["vecs"]], kind)[order], kind)
                q, o, v = best(np.array(row["qids"]), c[order], s, k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(o), pa.array(v)], ["vec_id", "other", "sim"])

    data = valid.select("vec_id", "vec").mapInArrow(pack(4096), "ids array<bigint>, vecs binary")
    asked = valid.select("vec_id", "vec").filter(F.col("vec_id") % every == 0).mapInArrow(pack(512), "qids array<bigint>, qvecs binary")
    found = data.crossJoin(asked).mapInArrow(score, "vec_id bigint, other bigint, sim bigint")  # a stated query set, in blocks
    w = Window.partitionBy("vec_id").orderBy(F.desc("sim"), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("vec_id", "rank", "other", (F.col("sim") / 1e6).alias("sim"))
