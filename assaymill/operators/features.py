"""Train-only feature statistics in long form, set scores, coverage and overlaps, similarities and nearest others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assaymill.functions.scalars import finite
from assaymill.operators.blocks import blocks
from assaymill.operators.ranks import top_k


BLOCK_BYTES = 1 << 26  #: of a block of columns in one task
SET_ROWS = 200_000  #: set members up to which a collection is broadcast


def small(d: DataFrame, most: int = SET_ROWS) -> DataFrame:
    """The table, broadcast if it is counted to be small."""
    return F.broadcast(d) if d.limit(most + 1).count() <= most else d


def long_matrix(vectors: DataFrame, entity: str, values: str) -> DataFrame:
    """(entity, pos, x): one row per element; NaN and infinities become missing, which is not zero."""
    return vectors.select(entity, F.posexplode(values).alias("pos", "_x")).select(entity, "pos", finite(F.col("_x").cast("double")).alias("x"))


def fit(train: DataFrame, entity: str, by: list[str] | None = None, max_missing: float = 0.5, min_variance: float = 1e-8, top: int | None = None) -> DataFrame:
    """State per (fold and) position: median, mean, sd of the imputed training values, kept and selected flags.

    All folds are fitted in one job with the fold as a key. Entities count once. Missing values are imputed by the median before variance, mean and
    sd; positions with at least ``max_missing`` missing or too little variance are not kept; ``top`` keeps the most variable, ties to the lower position.
    """
    by = by or []
    rows = train.dropDuplicates([*by, entity, "pos"])
    a = rows.groupBy(*by, "pos").agg(F.avg(F.col("x").isNull().cast("double")).alias("missing"), F.median("x").alias("median"), F.count("x").alias("n"), F.count(F.lit(1)).alias("n_all"),
                                     F.avg("x").alias("_m"), F.var_pop("x").alias("_v"))
    # the imputed column's moments follow from those of the present values: k missing values sit at the median
    n, k, all_ = F.col("n").cast("double"), (F.col("n_all") - F.col("n")).cast("double"), F.col("n_all").cast("double")
    mean = (n * F.col("_m") + k * F.col("median")) / all_
    ss = n * (F.col("_v") + (F.col("_m") - mean) ** 2) + k * (F.col("median") - mean) ** 2
    a = a.select(*by, "pos", "missing", "median", mean.alias("mean"), F.when(all_ > 1, ss / F.nullif(all_ - 1, F.lit(0.0))).alias("variance"))
    return _kept(a, by, max_missing, min_variance, top)


def _kept(a: DataFrame, by: list[str], max_missing: float, min_variance: float, top: int | None) -> DataFrame:
    kept = F.coalesce((F.col("missing") < max_missing) & (F.col("variance") > min_variance), F.lit(False))
    a = a.withColumn("kept", kept).withColumn("sd", F.when(F.sqrt("variance") > min_variance, F.sqrt("variance")).otherwise(1.0))
    if top is None:
        return a.withColumn("selected", F.col("kept"))
    w = Window.partitionBy(*by, "kept").orderBy(F.round("variance", 12).desc(), "pos")
    return a.withColumn("selected", F.col("kept") & (F.row_number().over(w) <= top))


def fit_matrix(vectors: DataFrame, entity: str, values: str, test_fold: str, folds: int, max_missing: float = 0.5, min_variance: float = 1e-8, top: int | None = None, most: int = BLOCK_BYTES) -> DataFrame:
    """As ``fit`` for every fold (training rows: those of the other folds), from whole vectors instead of single elements.

    Entities are deduplicated before anything is spread. Vectors are cut into blocks of columns, each column travels once whatever the number of folds, and a block's
    statistics are array operations. The width of a block follows from the counted rows, so that a block stays within ``most`` bytes; tables of so many rows that
    one column does not fit take the element-wise path of ``fit``, whose aggregates are partial.
    """
    rows = vectors.select(entity, F.col(test_fold).cast("int").alias("fold"), F.col(values).cast("array<double>").alias("v")).filter("v IS NOT NULL").dropDuplicates([entity])
    n = rows.count()
    if n * 8 > most:
        long = rows.select(entity, "fold", F.posexplode("v").alias("pos", "_x")).select(entity, F.col("fold").alias("_t"), "pos", finite("_x").alias("x"))
        each = long.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("fold <> _t").drop("_t")
        return fit(each, entity, ["fold"], max_missing, min_variance, top)
    width = max(1, min(256, most // (8 * max(1, n))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            fold = b.column(0).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for size in np.unique(sizes):  # vectors of one length are a matrix
                who = np.flatnonzero(sizes == size)
                m = flat[at[who][:, None] + np.arange(size)]
                m[~np.isfinite(m)] = np.nan
                cols = range(0, int(size), width)
                yield pa.RecordBatch.from_arrays([pa.array([c // width for c in cols], pa.int32()), pa.array([fold[who].astype(np.int32).tobytes()] * len(cols), pa.binary()), pa.array([np.ascontiguousarray(m[:, c : c + width]).tobytes() for c in cols], pa.binary())], ["block", "folds", "m"])

    def stat(t: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        if t.num_rows:
            parts = [(np.frombuffer(f, np.int32), np.frombuffer(x, np.float64)) for f, x in zip(t.column("folds").to_pylist(), t.column("m").to_pylist())]
            wide = max(len(x) // len(f) for f, x in parts)
            m = np.concatenate([np.pad(x.reshape(len(f), -1), ((0, 0), (0, wide - len(x) // len(f))), constant_values=np.nan) for f, x in parts])
            fold = np.concatenate([f for f, _ in parts])
            there = np.concatenate([np.repeat(np.arange(wide)[None, :] < len(x) // len(f), len(f), 0) for f, x in parts])
            for k in range(folds):
                x, has = m[fold != k], there[fold != k]
                total = has.sum(0)
                with np.errstate(all="ignore"):
                    s = np.sort(x, axis=0)  # missing values come last
                    count = (~np.isnan(x)).sum(0)
                    j = np.arange(wide)
                    median = np.where(count > 0, (s[np.maximum((count - 1) // 2, 0), j] + s[np.minimum(count // 2, len(s) - 1), j]) / 2, np.nan) if len(s) else np.full(wide, np.nan)
                    filled = np.where(has & np.isnan(x), median, x)
                    mean = np.nansum(filled, 0) / total
                    variance = np.nansum((filled - mean) ** 2, 0) / (total - 1)
                    missing = (total - count) / total
                ok = total > 0
                for col, v in zip(out, (np.full(wide, k), j + width * t.column("block")[0].as_py(), missing, median, np.where(count > 0, mean, np.nan), np.where((total > 1) & (count > 0), variance, np.nan))):
                    col.append(v[ok])
        kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 4]
        return pa.table({n: pa.array(np.concatenate(c) if c else [], k, from_pandas=True) for n, c, k in zip(("fold", "pos", "missing", "median", "mean", "variance"), out, kinds)})

    blocks_ = rows.select("fold", "v").mapInArrow(cut, "block int, folds binary, m binary")
    a = blocks_.groupBy("block").applyInArrow(stat, "fold int, pos int, missing double, median double, mean double, variance double")
    return _kept(a, ["fold"], max_missing, min_variance, top)


def transform(rows: DataFrame, state: DataFrame, by: list[str] | None = None, scale: bool = True) -> DataFrame:
    """Apply saved training statistics only: impute, then standardise, the selected positions."""
    by = by or []
    s = state.filter("selected").select(*by, "pos", "median", "mean", "sd")
    x = F.coalesce("x", "median")
    met = rows.join(s, [*by, "pos"])
    return met.select(*[c for c in rows.columns if c != "x"], ((x - F.col("mean")) / F.col("sd") if scale else x).alias("z"))


def as_vectors(rows: DataFrame, key: list[str], value: str = "z") -> DataFrame:
    """Long form back to arrays in position order."""
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda s: s[value]).alias("features"))


def set_coverage(sets: DataFrame, measurable: DataFrame, least: int = 10) -> DataFrame:
    """(set_name, n_members, n_effective, usable): members that are measured, counted as listed."""
    m = sets.join(measurable.select(F.col("pos").alias("member")).distinct().withColumn("_h", F.lit(1)), "member", "left")
    return m.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_members"), F.count("_h").alias("n_effective")).withColumn("usable", F.col("n_effective") >= least)


def set_scores(rows: DataFrame, sets: DataFrame, entity: list[str], value: str = "z", impute: bool = True) -> DataFrame:
    """Mean of the members per entity and set; without imputation one missing member makes the score missing."""
    m = rows.join(small(sets.select("set_name", F.col("member").alias("pos"))), "pos")
    score = F.avg(value) if impute else F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))
    return m.groupBy(*entity, "set_name").agg(score.alias("score"))


def set_overlap(sets: DataFrame) -> DataFrame:
    """(set_a, set_b, shared, jaccard) for all pairs of sets, itself included, from shared members."""
    s = sets.select("set_name", "member").distinct()
    size = s.groupBy("set_name").agg(F.count(F.lit(1)).alias("n"))
    shared = s.withColumnRenamed("set_name", "set_a").join(s.withColumnRenamed("set_name", "set_b"), "member").groupBy("set_a", "set_b").agg(F.count(F.lit(1)).alias("shared"))
    a, b = (size.select(F.col("set_name").alias(f"set_{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    every = a.crossJoin(small(b))  # the pairs of sets are the result
    return every.join(shared, ["set_a", "set_b"], "left").select("set_a", "set_b", F.coalesce("shared", F.lit(0)).alias("shared"), (F.coalesce("shared", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("shared", F.lit(0)))).alias("jaccard"))


def nearest_other(vectors: DataFrame, entity: str, bits: str, block: int = 2048) -> DataFrame:
    """(entity, nearest, tanimoto): the most similar other entity by set bits, ties to the smaller id.

    Exact: packed blocks meet packed blocks and are scored by bit counts, so what moves is n / block rows a side, never pairs; an entity whose
    best similarity is 0 is reported with its smallest other. Meant for entity tables; work grows with the square of their rows.
    """
    kind = vectors.schema[entity].dataType.simpleString()
    arrow = to_arrow_type(vectors.schema[entity].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, block):
                ids, rows = (b.column(c).slice(lo, block).to_pylist() for c in (0, 1))
                order = sorted(range(len(ids)), key=ids.__getitem__)
                m = np.zeros((len(ids), -(-max(map(len, rows), default=0) // 64) * 64), bool)
                for i, j in enumerate(order):
                    m[i, : len(rows[j])] = np.array(rows[j]) != 0
                yield pa.RecordBatch.from_arrays([pa.array([[ids[j] for j in order]], pa.list_(arrow)), pa.array([m.shape[1] // 64], pa.int32()), pa.array([np.packbits(m, axis=1).tobytes()], pa.binary())], ["ids", "w", "m"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                w = max(r["w"], r["qw"])
                c, q = (np.pad(np.frombuffer(r[m], np.uint64).reshape(len(r[i]), r[k]), ((0, 0), (0, w - r[k]))) for m, i, k in (("m", "ids", "w"), ("qm", "qids", "qw")))
                both = np.zeros((len(q), len(c)), np.int32)
                for k in range(w):
                    both += np.bitwise_count(q[:, k, None] & c[None, :, k])
                union = np.bitwise_count(q).sum(1, dtype=np.int32)[:, None] + np.bitwise_count(c).sum(1, dtype=np.int32)[None, :] - both
                s = np.where(union > 0, both / np.maximum(union, 1), 0.0)
                s[np.array(r["qids"], object)[:, None] == np.array(r["ids"], object)[None, :]] = -1
                best = s.argmax(1)  # ids are sorted: the first maximum has the smallest id
                yield pa.RecordBatch.from_arrays([pa.array(r["qids"], arrow), pa.array([r["ids"][j] for j in best], arrow), pa.array(s[np.arange(len(q)), best])], [entity, "nearest", "tanimoto"])

    slim = vectors.select(entity, bits).filter(F.col(entity).isNotNull() & F.col(bits).isNotNull())
    blocks = slim.mapInArrow(pack, f"ids array<{kind}>, w int, m binary")
    asked = blocks.select(F.col("ids").alias("qids"), F.col("w").alias("qw"), F.col("m").alias("qm"))
    found = blocks.crossJoin(asked).mapInArrow(score, f"{entity} {kind}, nearest {kind}, tanimoto double")  # blocks, not rows
    return top_k(found.filter("tanimoto >= 0"), [entity], 1, F.col("tanimoto").desc(), F.col("nearest")).drop("rank")


def neighbour_mean(train: DataFrame, query: DataFrame, group: str, vec: str, k: int) -> DataFrame:
    """(sample_id, prediction): mean label of the k nearest training rows of the same group (Euclidean, rounded to 9 decimals), ties to the smaller sample id.

    ``train``: sample_id, group, y, vec; ``query``: sample_id, group, vec. Fewer than k rows are all used. Blocks of a group's queries meet blocks of its
    training rows and keep k candidates each, so a hot group is spread over tasks and no pair of rows is emitted.
    """
    t = blocks(train.withColumn("v", F.col(vec)), [group], ["sample_id"], ["sample_id", "y", "v"])
    q = blocks(query.withColumn("v", F.col(vec)), [group], ["sample_id"], ["sample_id", "v"])
    met = q.select(group, F.col("sample_id").alias("qid"), F.col("v").alias("qv")).join(t.select(group, "sample_id", "y", "v"), group).drop(group)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out = []
            for qid, qv, ids, y, v in zip(*(d[c] for c in ("qid", "qv", "sample_id", "y", "v"))):
                order = np.argsort(np.array(ids, object), kind="stable")
                ids, y, a, b = ids[order], y[order], np.stack(qv), np.stack(v)[order]
                d2 = np.round(sum((a[:, None, j] - b[None, :, j]) ** 2 for j in range(a.shape[1])), 9)
                best = np.argsort(d2, axis=1, kind="stable")[:, :k]
                out += [(qid[i], ids[j], y[j], d2[i, j]) for i in range(len(a)) for j in best[i]]
            yield pd.DataFrame(out, columns=["sample_id", "other", "y", "d"])

    found = met.mapInPandas(near, "sample_id string, other string, y double, d double")
    return top_k(found, ["sample_id"], k, F.col("d"), F.col("other")).groupBy("sample_id").agg(F.avg("y").alias("prediction"))


def pair_features(samples: DataFrame, cells: DataFrame, drugs: DataFrame) -> DataFrame:
    """samples with ``features`` = cell vector followed by drug vector; entity tables are joined late, wide rows are never shuffled by sample."""
    return samples.join(cells, "cell_id").join(drugs, "compound_id").withColumn("features", F.concat("cell_vec", "drug_vec")).drop("cell_vec", "drug_vec")
