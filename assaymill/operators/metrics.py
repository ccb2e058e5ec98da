"""Evaluation of predictions: per-group rank metrics, macro averages, strata, paired comparison and bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assaymill.functions.scalars import finite
from assaymill.operators.blocks import blocks
from assaymill.operators.ranks import dense_order, group_ranks, guarded_corr
from assaymill.operators.relational import duplicates
from assaymill.session import settle


def violations(pred: DataFrame) -> DataFrame:
    """(reason, n): what makes a prediction table unusable; no row means none."""
    checks = [("missing_sample_id", F.col("sample_id").isNull()), ("missing_entity", F.col("cell_id").isNull() | F.col("compound_id").isNull()),
              ("non_finite", finite("y_true").isNull() | finite("y_pred").isNull())]
    one = pred.agg(*[F.count_if(c).alias(n) for n, c in checks]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("n")) for n, _ in checks])).alias("x")).select("x.*")
    dup = duplicates(pred.filter("sample_id IS NOT NULL"), "sample_id").agg(F.lit("duplicate_sample_id").alias("reason"), F.count(F.lit(1)).alias("n"))
    return one.unionByName(dup).filter("n > 0")


def pair_accuracy(pred: DataFrame, by: list[str]) -> DataFrame:
    """(by, pair_accuracy): share of pairs with different truth whose predictions stand in the same order; a predicted tie is wrong.

    Rows are reduced to one per (truth, prediction) level with a count; levels are cut into blocks, and pairs of blocks are counted in arrays, so
    that no pair of rows is ever a row.
    """
    lv = pred.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    b = blocks(lv, by, ["y_true", "y_pred"], ["y_true", "y_pred", "n"])
    met = b.join(b.select(*by, F.col("block").alias("other"), F.col("y_true").alias("u"), F.col("y_pred").alias("q"), F.col("n").alias("m")), by).filter("block <= other")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in b.select(*by).schema)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            right, total = [], []
            for t, p, n, u, q, m, i, j in zip(*(d[c] for c in ("y_true", "y_pred", "n", "u", "q", "m", "block", "other"))):
                truth = np.sign(t[:, None] - u[None, :])
                w = np.where(truth != 0, n[:, None] * m[None, :], 0.0) / (2 if i == j else 1)
                right.append(float((w * (np.sign(p[:, None] - q[None, :]) == truth)).sum()))
                total.append(float(w.sum()))
            yield d[by].assign(right=right, total=total)

    got = met.mapInPandas(count, f"{kinds}, right double, total double").groupBy(*by).agg(F.sum("right").alias("r"), F.sum("total").alias("t"))
    return got.filter("t > 0").select(*by, (F.col("r") / F.col("t")).alias("pair_accuracy"))


def per_group(pred: DataFrame, by: list[str], min_cells: int = 10, hot: bool | None = None) -> DataFrame:
    """One row per group: sizes, variance flags, correlations, the value used for selection, constant predictions."""
    r = group_ranks(pred, by, {"_rt": "y_true", "_rp": "y_pred"}, hot=hot)
    g = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"), F.countDistinct("cell_id").alias("n_cells"), (F.max("y_true") > F.min("y_true")).alias("label_variance"),
        (F.max("y_pred") == F.min("y_pred")).alias("_const"), guarded_corr("_rt", "_rp").alias("_rho"), guarded_corr("y_true", "y_pred").alias("_pcc"),
    )
    q = (F.col("n_cells") >= min_cells) & F.col("label_variance")
    return g.select(
        *by, "n_samples", "n_cells", "label_variance", q.alias("qualified"), F.when(q, F.col("_rho")).alias("spearman_raw"),
        F.when(q, F.coalesce("_rho", F.lit(0.0))).alias("spearman_selection"), F.when(q, F.col("_pcc")).alias("pcc_raw"), (q & F.col("_const")).alias("constant_prediction"),
    )


def error_metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    """RMSE, MAE and R2 (NULL for constant labels)."""
    e = F.col("y_pred") - F.col("y_true")
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.nullif(F.var_pop("y_true"), F.lit(0.0)))).alias("r2"),
    )


def macro(pred: DataFrame, by: list[str] | None = None, min_cells: int = 10) -> DataFrame:
    """Macro averages over the qualified compounds of each stratum (or of all rows), beside the errors."""
    by = by or []
    pred = settle(pred.select(*{c: None for c in [*by, "compound_id", "cell_id", "y_true", "y_pred"]}))
    g = per_group(pred, [*by, "compound_id"], min_cells)
    m = g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_drugs"), F.count_if("qualified").alias("n_qualified"), F.count_if("constant_prediction").alias("n_constant"),
        F.avg("spearman_selection").alias("macro_spearman"), F.avg("pcc_raw").alias("macro_pcc"),
    )
    e = error_metrics(pred, by)
    if not by:
        return m.crossJoin(e)  # one row each
    cond = [m[c].eqNullSafe(e[c]) for c in by]
    return m.join(e, cond).select(*[m[c] for c in by], *[c for c in m.columns if c not in by], "n_samples", "rmse", "mae", "r2")


def strata(pred: DataFrame, dimensions: list[str], min_cells: int = 10) -> DataFrame:
    """(dimension, value, ...): macro metrics of every value of every dimension; a missing value is a stratum."""
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("(missing)")).alias("value")) for d in dimensions]))
    long = pred.withColumn("_x", rows).select("sample_id", "cell_id", "compound_id", "y_true", "y_pred", "_x.*")
    return macro(long, ["dimension", "value"], min_cells)


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two prediction tables of the same samples side by side, as y_a and y_b."""
    r = right.select("sample_id", F.col("y_true").alias("_t"), F.col("y_pred").alias("y_b"))
    return left.withColumnRenamed("y_pred", "y_a").join(r, "sample_id").withColumn("label_differs", ~F.col("y_true").eqNullSafe(F.col("_t"))).drop("_t")


def paired_difference(aligned: DataFrame, min_cells: int = 10) -> DataFrame:
    """Difference of the macro rank metric and ratio of RMSE of a against b, from one scan."""
    two = aligned.select("sample_id", "cell_id", "compound_id", "y_true", F.explode(F.array(*[F.struct(F.lit(m).alias("side"), F.col(f"y_{m}").alias("y_pred")) for m in "ab"])).alias("x")).select("sample_id", "cell_id", "compound_id", "y_true", "x.*")
    m = macro(two, ["side"], min_cells)
    at = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    return m.agg(
        (at("macro_spearman", "a") - at("macro_spearman", "b")).alias("delta_macro"), F.try_divide(at("rmse", "a"), at("rmse", "b")).alias("rmse_ratio"), F.max("n_qualified").alias("n_qualified")
    )


DRAWN = 1 << 27  #: multiplicities (bytes) that a task holds at a time; numbers that a task draws for groups already scored
PIECE = 1 << 16  #: rows of a unit beyond which its draws are shared out over tasks
CELLS = 1 << 18  #: rows x draws scored at a time


def multiplicities(seed: int, first: int, last: int, sizes: list[int]) -> list[np.ndarray]:
    """Per number of groups an array (group, draw) of how often each group is drawn in the draws first to last - 1; every draw has a generator of its own."""
    out = [np.zeros((last - first, n), np.uint8) for n in sizes]
    for b in range(first, last):
        rng = np.random.default_rng([seed, b])
        for m, n in zip(out, sizes):
            m[b - first] = np.bincount(rng.integers(0, n, n), minlength=n)
    return [np.ascontiguousarray(m.T) for m in out]


def drawn_selection(unit: np.ndarray, cell: np.ndarray, y: list[np.ndarray], there: list[np.ndarray], w: np.ndarray, min_cells: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(qualified, selections per prediction), each (unit, draw): what ``per_group`` gives for rows repeated ``w`` (row, draw) times.

    ``unit`` numbers the rows' units in ascending order, ``cell`` the cells (negative: missing), ``y`` is the truth and the predictions, ``there`` where they are no
    NULL. A repeated row takes part in its tie, so a rank is (weight below + weight up to and with the tie + 1) / 2; doubled and centred, ranks are whole numbers.
    """
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    ends = np.r_[starts[1:], len(unit)]
    of = np.repeat(np.arange(len(starts)), ends - starts)
    sums = lambda x: np.add.reduceat(x, starts, axis=0)
    centred, weights = [], []
    for v, ok in zip(y, there):
        wv = w if ok.all() else w * ok[:, None]
        order = np.lexsort((v, unit))
        s = v[order]
        new = np.r_[True, (unit[order][1:] != unit[order][:-1]) | ~((s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1])))]
        low = np.flatnonzero(new)
        tie = np.empty(len(s), np.int64)
        tie[order] = np.cumsum(new) - 1
        c = np.zeros((len(s) + 1, w.shape[1]))
        np.cumsum(wv[order], axis=0, out=c[1:])
        both = c[low] + c[np.r_[low[1:], len(s)]]
        centred.append(both[tie] - (c[starts] + c[ends])[of])
        weights.append(wv)
    _, at = np.unique(np.stack([unit, cell]), axis=1, return_index=True)
    once = np.zeros(len(unit), bool)
    once[at] = True
    cells = sums(w * (once & (cell >= 0))[:, None])
    t, wt = centred[0], weights[0]
    tt = sums(wt * t * t)
    qualified = (cells >= min_cells) & (tt > 0)
    out = []
    for p, wp, ok in zip(centred[1:], weights[1:], there[1:]):
        pp = sums(wp * p * p)
        if there[0].all() and ok.all():
            tp = sums(w * t * p)
        else:  # the covariance is that of the rows with both, the deviations are those of each side
            wb = w * (there[0] & ok)[:, None]
            n, nt, np_ = sums(wb), sums(wt), sums(wp)
            with np.errstate(divide="ignore", invalid="ignore"):
                tp = np.where(n > 0, (sums(wb * t * p) - sums(wb * t) * sums(wb * p) / n) / n, 0.0) * np.sqrt(nt * np_)
        d = np.sqrt(tt) * np.sqrt(pp)
        out.append(np.where(qualified & (d > 0), tp / np.where(d > 0, d, 1.0), 0.0))
    return qualified, out


def members(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of lists of (cell, truth, predictions a and b, ...): their bounds, numbers of the cells (negative: missing), values, where these are no NULL, what else there is."""
    cell, *y = lists.flatten().flatten()
    cell = cell.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    y, more = y[:3], [v.to_numpy() for v in y[3:]]
    return np.r_[0, np.cumsum(lists.value_lengths().to_numpy())], cell, [v.fill_null(0.0).to_numpy() for v in y], [v.is_valid().to_numpy(zero_copy_only=False) for v in y], more


def _drawn_scores(source: DataFrame, by: str, numbered: DataFrame, size: int, n_boot: int, seed: int, min_cells: int) -> DataFrame:
    """(b, a, o, n) per draw of groups of compounds: the sums of the compounds' selections and how many qualify.

    No draw changes a compound's rows, so every compound is scored once, where its rows are. What is drawn are the groups' sums, three numbers each: every drawing
    task gets all of them and makes its share of the draws.
    """
    kind = source.schema[by].dataType.simpleString()
    units = source.groupBy("compound_id", by).agg(F.collect_list(F.struct("cell_id", "y_true", "y_a", "y_b")).alias("r")).filter(F.size("r") > 1)  # one row has no variance

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cell, y, there, _ = members(batch.column(1))
            u = 0
            while u < len(batch):
                end = max(u + 1, int(np.searchsorted(at, at[u] + CELLS, "right")) - 1)
                part = slice(at[u], at[end])
                unit = np.repeat(np.arange(end - u), np.diff(at[u : end + 1]))
                q, (sa, sb) = drawn_selection(unit, cell[part], [v[part] for v in y], [t[part] for t in there], np.ones((len(unit), 1)), min_cells)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(u, end - u), *[pa.array(x[:, 0].astype(np.float64)) for x in (sa, sb, q)]], [by, "a", "o", "n"])
                u = end

    scored = units.select(by, "r").mapInArrow(score, f"{by} {kind}, a double, o double, n double")
    sums = scored.filter("n > 0").groupBy(by).agg(*[F.sum(x).alias(x) for x in "aon"]).join(numbered, by)
    n_tasks = max(1, min(n_boot, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size * n_boot // DRAWN)))

    def draw(key: tuple[pa.Scalar], groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("gd")
        gd, *each = (groups[c].to_numpy() for c in ("gd", "a", "o", "n"))
        each, j = np.stack(each, axis=1), key[0].as_py()
        drawn = range(n_boot * j // n_tasks, n_boot * (j + 1) // n_tasks)
        total = np.zeros((len(drawn), 3))
        for x, b in zip(total, drawn):
            x[:] = np.bincount(np.random.default_rng([seed, b]).integers(0, size, size), minlength=size)[gd] @ each
        some = total[:, 2] > 0
        return pa.table({"b": pa.array(np.array(drawn)[some], pa.int32())} | {c: pa.array(v) for c, v in zip("aon", total[some].T)})

    dealt = sums.select("gd", "a", "o", "n", F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1))).alias("j"))
    return dealt.groupBy("j").applyInArrow(draw, "b int, a double, o double, n double")


def _drawn_rows(rows: DataFrame, sizes: dict[str, int], n_boot: int, seed: int, min_cells: int) -> DataFrame:
    """(b, a, o, n), partial sums per draw of groups of cells (``gc``), and of compounds (``gd``) where ``sizes`` has them: compounds are scored under the weights of the draws."""
    n_tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    least = min(n_boot, max(1, -(-max(sizes.values(), default=0) * n_boot // DRAWN)))
    units = rows.groupBy("compound_id", "gd").agg(F.collect_list(F.struct("cell_id", "y_true", "y_a", "y_b", "gc")).alias("r")).filter(F.size("r") > 1)  # one row has no variance
    k = F.least(F.lit(n_boot), F.greatest(F.lit(least), F.ceil(F.size("r") / PIECE).cast("int")))
    salt = F.hash("compound_id", "gd") if least == 1 else F.pmod(F.hash("compound_id", "gd"), F.lit(4 * -(-n_tasks // least)))  # with many blocks a task should draw for few
    pieces = units.withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("_s", salt).repartition(n_tasks, "k", "i", "_s").sortWithinPartitions("k", "i")
    kinds = list(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, n_boot))
        held, table = None, {}
        for batch in batches:
            gd, ks, blocks_ = (batch.column(c).to_numpy() for c in (0, 2, 3))
            at, cell, y, there, (gc,) = members(batch.column(1))
            cell = np.where(cell < 0, -1, cell * sizes["gc"] + gc)  # a cell counts once in each group that is drawn
            u = 0
            while u < len(gd):
                first, last = n_boot * blocks_[u] // ks[u], n_boot * (blocks_[u] + 1) // ks[u]
                if held != (first, last):
                    table = {}
                    table, held = dict(zip(kinds, multiplicities(seed, first, last, list(sizes.values())))), (first, last)
                wide = last - first
                end = u + 1
                while end < len(gd) and ks[end] == ks[u] and blocks_[end] == blocks_[u] and (at[end + 1] - at[u]) * wide <= CELLS:
                    end += 1
                part = slice(at[u], at[end])
                unit = np.repeat(np.arange(end - u), np.diff(at[u : end + 1]))
                step = max(1, CELLS // len(unit))
                for lo in range(0, wide, step):
                    w = table["gc"][gc[part], lo : lo + step].astype(np.float64)
                    q, (sa, sb) = drawn_selection(unit, cell[part], [v[part] for v in y], [t[part] for t in there], w, min_cells)
                    d = slice(first + lo, min(last, first + lo + step))
                    times = table["gd"][gd[u:end], d.start - first : d.stop - first] if "gd" in table else 1
                    for x, v in zip(total, (sa, sb, q)):
                        x[d] += (v * times).sum(0)
                u = end
        some = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(x[some]) for x in total]], ["b", "a", "o", "n"])

    return pieces.select("gd", "r", "k", "i").mapInArrow(run, "b int, a double, o double, n double")


def bootstrap(aligned: DataFrame, protocol: str, n_boot: int = 200, seed: int = 42, min_cells: int = 10) -> DataFrame:
    """(protocol, n_valid, difference_mean, ci_low, ci_high) of the paired cluster bootstrap.

    ``lco`` draws cell groups, ``ldo_so`` chemical groups, ``db`` both. No row is repeated: a draw is a weight per group, every compound (of a chemical group, where
    these are drawn) is scored under the weights of the drawn cells in arrays (once, where only chemical groups are drawn), and counts as often as its chemical group
    is drawn. Groups are numbered in their order; tasks draw for themselves and return sums per draw. Replicates without a qualified compound are left out.
    """
    cols = {"lco": ["cell_group"], "ldo_so": ["chemical_group"], "db": ["cell_group", "chemical_group"]}
    if protocol not in cols:
        raise ValueError(f"unsupported bootstrap protocol {protocol}")
    present = F.lit(True)
    for c in cols[protocol]:
        present = present & F.col(c).isNotNull()
    source = settle(aligned.filter(present).select("compound_id", "cell_id", *[F.col(y).cast("double").alias(y) for y in ("y_true", "y_a", "y_b")], *cols[protocol]))
    numbered, sizes = {}, {}
    for c, short in (("cell_group", "gc"), ("chemical_group", "gd")):
        if c in cols[protocol]:
            numbered[c] = settle(dense_order(source.select(c).distinct(), c, "_n")).select(c, (F.col("_n") - 1).cast("int").alias(short))
            sizes[short] = numbered[c].count()
    if protocol == "ldo_so":
        got = _drawn_scores(source, "chemical_group", numbered["chemical_group"], sizes["gd"], n_boot, seed, min_cells)
    else:
        rows = source if "gd" in sizes else source.withColumn("gd", F.lit(0))
        for c, n in numbered.items():
            rows = rows.join(n, c)
        got = _drawn_rows(rows, sizes, n_boot, seed, min_cells)
    g = got.groupBy("b").agg(((F.sum("a") - F.sum("o")) / F.sum("n")).alias("effect"))
    ci = F.percentile("effect", F.array(F.lit(0.025), F.lit(0.975)))
    return settle(g).agg(F.lit(protocol).alias("protocol"), F.count(F.lit(1)).alias("n_valid"), F.avg("effect").alias("difference_mean"), ci[0].alias("ci_low"), ci[1].alias("ci_high"))


def coverage_bins(train: DataFrame) -> DataFrame:
    """(compound_id, n_cells, bin): compounds by quartile of their training cells."""
    from assaymill.operators.ranks import quantile_bins

    return quantile_bins(train.groupBy("compound_id").agg(F.countDistinct("cell_id").alias("n_cells")), "n_cells")


def screen(gains: DataFrame, model: str = "model") -> DataFrame:
    """Verdict per model: mean gain at least 0.02, at least two positive seeds, mean RMSE ratio at most 1.02."""
    a = gains.groupBy(model).agg(F.avg("delta_macro").alias("mean_gain"), F.count_if(F.col("delta_macro") > 0).alias("n_positive"), F.avg("rmse_ratio").alias("mean_ratio"), F.stddev_samp("delta_macro").alias("sd_gain"))
    ok = (F.round("mean_gain", 9) >= 0.02) & (F.col("n_positive") >= 2) & (F.round("mean_ratio", 9) <= 1.02)
    return a.withColumn("verdict", F.when(ok, "pass").otherwise("fail"))
