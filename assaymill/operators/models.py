"""Baseline estimators on Spark: means, additive and linear models with stated regularisation, per-group elastic nets, guarded selection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assaymill.operators.ranks import top_k


def mean_baseline(train: DataFrame, query: DataFrame, key: str | None) -> DataFrame:
    """query with y_pred: mean label of the row's key in training, else the global mean."""
    g = F.broadcast(train.agg(F.avg("y").alias("_g")))  # one row
    if key is None:
        return query.crossJoin(g).withColumnRenamed("_g", "y_pred")
    m = train.groupBy(key).agg(F.avg("y").alias("_m"))
    return query.join(m, key, "left").crossJoin(g).withColumn("y_pred", F.coalesce("_m", "_g")).drop("_m", "_g")


def two_way_additive(train: DataFrame, query: DataFrame, a: str, b: str, alpha: float = 0.01, rounds: int = 10, tol: float = 1e-6) -> DataFrame:
    """query with y_pred = mu + effect(a) + effect(b), a ridge fit by alternating closed-form updates; unseen entities have no effect.

    Each update is one aggregation over the rows; entity effects are small tables.
    """
    from assaymill.session import discard, settle

    mu = train.agg(F.avg("y")).first()[0] or 0.0
    rows = train.select(a, b, (F.col("y") - mu).alias("r"))
    ea = settle(rows.groupBy(a).agg((F.sum("r") / (F.count(F.lit(1)) + alpha)).alias("ea")))
    eb, last = None, math.inf
    for _ in range(rounds):
        new_b = settle(rows.join(ea, a).groupBy(b).agg((F.sum(F.col("r") - F.col("ea")) / (F.count(F.lit(1)) + alpha)).alias("eb")))
        new_a = settle(rows.join(new_b, b).groupBy(a).agg((F.sum(F.col("r") - F.col("eb")) / (F.count(F.lit(1)) + alpha)).alias("ea")))
        moved = new_a.join(ea.withColumnRenamed("ea", "_o"), a).agg(F.max(F.abs(F.col("ea") - F.col("_o")))).first()[0] or 0.0
        discard(ea)
        if eb is not None:
            discard(eb)
        ea, eb = new_a, new_b
        if moved < tol or abs(last - moved) < tol:
            break
        last = moved
    out = query.join(ea, a, "left").join(eb, b, "left")
    return out.withColumn("y_pred", F.lit(mu) + F.coalesce("ea", F.lit(0.0)) + F.coalesce("eb", F.lit(0.0))).drop("ea", "eb")


def spark_penalty(alpha: float, l1_ratio: float, n: int, sd_population: float, ridge: bool) -> dict[str, float]:
    """regParam and elasticNetParam at which Spark's LinearRegression solves the scikit-style objective.

    Spark scales the quadratic penalty by the label's deviation: the ridge ``||y - Xw||^2 + alpha ||w||^2`` needs alpha sd / n; the elastic net ``1/2n ||y - Xw||^2 +
    alpha r |w| + alpha (1 - r) / 2 ||w||^2`` needs l1 = alpha r and l2 = alpha (1 - r) sd.
    """
    if ridge:
        return {"regParam": alpha * sd_population / n, "elasticNetParam": 0.0}
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio) * sd_population
    return {"regParam": l1 + l2, "elasticNetParam": l1 / (l1 + l2) if l1 + l2 else 0.0}


def linear(train: DataFrame, alpha: float, l1_ratio: float | None = None):
    """Fitted LinearRegressionModel over ``features`` (array) and ``y``: ridge, or elastic net if a ratio is given."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    rows = train.select(array_to_vector("features").alias("features"), F.col("y").alias("label"))
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("pop"), F.stddev_samp("label").alias("samp")).first()
    sd = s["pop"] if l1_ratio is None else s["samp"]
    p = spark_penalty(alpha, l1_ratio or 0.0, s["n"], sd or 1.0, l1_ratio is None)
    return LinearRegression(standardization=False, solver="normal" if l1_ratio is None else "l-bfgs", tol=1e-10, maxIter=500, **p).fit(rows)


def linear_predict(model, query: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return model.setPredictionCol("y_pred").transform(query.withColumn("_f", F.col("features")).withColumn("features", array_to_vector("features"))).drop("features").withColumnRenamed("_f", "features")


def forest(train: DataFrame, trees: int = 64, depth: int = 12, share: float = 0.3, seed: int = 42):
    """Random forest over ``features`` and ``y`` (split thresholds are searched, not drawn at random)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    rows = train.select(array_to_vector("features").alias("features"), F.col("y").alias("label"))
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, featureSubsetStrategy=str(share), seed=seed).fit(rows)


class Factorisation:
    """A fitted factorisation machine: intercept, linear weights, and a row of factors per feature."""

    def __init__(self, intercept: float, linear: np.ndarray, factors: np.ndarray):
        self.intercept, self.linear, self.factors = intercept, linear, factors

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predictions of the rows of ``x``, and their sums of factors."""
        s = x @ self.factors
        return self.intercept + x @ self.linear + 0.5 * ((s * s).sum(1) - (x * x) @ (self.factors * self.factors).sum(1)), s

    def predict(self, query: DataFrame) -> DataFrame:
        """(sample_id, y_pred) of rows with features."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(self.score(_matrix(b.column(1)))[0])], ["sample_id", "y_pred"])

        return query.select("sample_id", F.col("features").cast("array<double>")).mapInArrow(run, f"sample_id {query.schema['sample_id'].dataType.simpleString()}, y_pred double")


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def factorisation(train: DataFrame, factors: int = 16, seed: int = 42, steps: int = 100, attach: Late | None = None, rate: float = 0.05) -> Factorisation:
    """Factorisation machine fitted by full gradients of the squared error and AdamW, as Spark's FMRegressor does from the same start; every step is one scan whose
    tasks return sums of gradients, computed on whole batches. ``attach`` as in ``group_linear``: features need not be stored."""
    rows = (attach or (lambda d: d))(train).select(F.col("features").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))
    width = len(rows.first()["x"])
    random = train.sparkSession._jvm.java.util.Random(seed)
    v = np.array([random.nextGaussian() * 0.01 for _ in range(width * factors)])
    theta = np.concatenate([v, np.zeros(width + 1)])
    unpack = lambda t: Factorisation(t[-1], t[width * factors : -1], t[: width * factors].reshape(width, factors))

    def gradients(now: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, total, n = unpack(now), np.zeros(len(now)), 0
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column(0))
                p, s = model.score(x)
                e = 2 * (p - b.column(1).to_numpy(zero_copy_only=False))
                total += np.concatenate([(x.T @ (e[:, None] * s) - (e @ (x * x))[:, None] * model.factors).ravel(), e @ x, [e.sum()]])
                n += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "g"])

        return run

    m, u = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, steps + 1):
        parts = rows.mapInArrow(gradients(theta), "n bigint, g binary").collect()  # one row a task
        g = sum(np.frombuffer(r["g"], np.float64) for r in parts) / sum(r["n"] for r in parts)
        m, u = 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g * g
        before, theta = theta, theta - rate * (m / (1 - 0.9**i)) / (np.sqrt(u / (1 - 0.999**i)) + 1e-8)
        if np.linalg.norm(theta - before) < 1e-6 * max(np.linalg.norm(theta), 1.0):
            break
    return unpack(theta)


def elastic_net(gram: np.ndarray, xy: np.ndarray, alpha: float, l1_ratio: float, rounds: int = 3000, tol: float = 1e-8) -> np.ndarray:
    """Coordinate descent on the moments of centred data: ``gram`` = X'X / n, ``xy`` = X'y / n."""
    w = np.zeros(len(xy))
    sq = np.diag(gram)
    for _ in range(rounds):
        biggest = 0.0
        for j in np.flatnonzero(sq > 1e-15):
            rho = xy[j] - gram[j] @ w + sq[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (sq[j] + alpha * (1 - l1_ratio))
            biggest = max(biggest, abs(new - w[j]))
            w[j] = new
        if biggest < tol:
            break
    return w


def elastic_nets(grams: np.ndarray, xys: np.ndarray, alpha: float, l1_ratio: float, rounds: int = 3000, tol: float = 1e-8) -> np.ndarray:
    """``elastic_net`` of many groups at once, one per row: the same updates in the same order; a group that has converged is left alone."""
    out = np.zeros_like(xys)
    sq = np.einsum("kjj->kj", grams).copy()
    live, w = np.arange(len(xys)), out.copy()
    g, xy = np.ascontiguousarray(grams.transpose(1, 0, 2)), xys
    for _ in range(rounds):
        biggest = np.zeros(len(live))
        for j in np.flatnonzero((sq > 1e-15).any(0)):
            rho = xy[:, j] - np.einsum("kd,kd->k", g[j], w) + sq[:, j] * w[:, j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - alpha * l1_ratio, 0) / (sq[:, j] + alpha * (1 - l1_ratio) + (sq[:, j] <= 1e-15))
            new = np.where(sq[:, j] > 1e-15, new, 0.0)
            np.maximum(biggest, np.abs(new - w[:, j]), out=biggest)
            w[:, j] = new
        going = biggest >= tol
        out[live] = w
        if not going.any():
            break
        if not going.all():
            live, w, g, xy, sq = live[going], w[going], np.ascontiguousarray(g[:, going]), xy[going], sq[going]
    return out


def group_moments(rows: DataFrame, group: str, features: str = "features", y: str = "y", held: int = 500) -> DataFrame:
    """(group, n, m): sums of the outer products of (1, features, y) per group, as the bytes of a float64 matrix, in several partial rows.

    Each partition adds up what it sees and passes on at most ``held`` groups at a time: rows of a hot group are never gathered. Rows with a missing
    group, label or vector are left out; vectors of one group have one length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            r = pa.RecordBatch.from_arrays([pa.array(list(sums), arrow), pa.array([int(round(m[0, 0])) for m in sums.values()], pa.int64()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], [group, "n", "m"])
            sums.clear()
            return r

        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(0).dictionary_encode()
            lists, label = b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            which, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            order = np.argsort(which, kind="stable")
            for rows_ in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
                x = np.stack([flat[at[i] : at[i + 1]] for i in rows_])
                z = np.concatenate([np.ones((len(x), 1)), x, label[rows_, None]], 1)
                g = names[which[rows_[0]]]
                sums[g] = sums[g] + z.T @ z if g in sums else z.T @ z
            if len(sums) >= held:
                yield out()
        if sums:
            yield out()

    arrow = to_arrow_type(rows.schema[group].dataType)
    src = rows.select(group, F.col(features).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y")).filter(F.col(group).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    return src.mapInArrow(run, f"{group} {rows.schema[group].dataType.simpleString()}, n bigint, m binary")


HOT_ROWS = 100_000  #: rows of a group beyond which its moments are added up in the partitions where its rows lie
SOLVED = 256  #: groups solved together

Late = Callable[[DataFrame], DataFrame]


def group_linear(train: DataFrame, group: str, alpha: float, l1_ratio: float | None, least: int = 30, attach: Late | None = None) -> DataFrame:
    """(group, n, coef, intercept): a linear model per group, solved from its moments; ridge (``l1_ratio`` None) or elastic net.

    A group with fewer than ``least`` rows or a constant label has no coefficients and its mean as intercept. Rows are brought together by group and read in
    that order, so a group's moments (a square of the vector's length) stay in its task; only those of groups beyond HOT_ROWS are added up in pieces.
    ``attach`` adds ``features`` to rows that lack them and must leave rows where they are (a broadcast join): then wide rows are never shuffled.
    """
    kind, arrow = train.schema[group].dataType.simpleString(), to_arrow_type(train.schema[group].dataType)
    schema = f"{group} {kind}, n bigint, coef array<double>, intercept double"

    def solve(names: list, ms: list[np.ndarray]) -> pa.Table:
        coefs, intercepts, nets = [[] for _ in ms], [float(m[0, -1] / m[0, 0]) for m in ms], []
        for i, m in enumerate(ms):
            n, mean = m[0, 0], m[0] / m[0, 0]
            cov = m / n - np.outer(mean, mean)
            if n < least or cov[-1, -1] <= 1e-12 * max(1.0, mean[-1] ** 2):
                continue
            g, xy = cov[1:-1, 1:-1], cov[1:-1, -1]
            if l1_ratio is None:
                nets.append((i, mean, None, None, np.linalg.solve(g + alpha / n * np.eye(len(xy)), xy)))
            else:
                nets.append((i, mean, g, xy, None))
        for d in {len(x[1]) for x in nets}:
            same = [x for x in nets if len(x[1]) == d]
            ws = [x[4] for x in same] if l1_ratio is None else elastic_nets(np.stack([x[2] for x in same]), np.stack([x[3] for x in same]), alpha, l1_ratio)
            for (i, mean, *_), w in zip(same, ws):
                coefs[i], intercepts[i] = w.tolist(), float(mean[-1] - mean[1:-1] @ w)
        return pa.table({group: pa.array(names, arrow), "n": pa.array([int(round(m[0, 0])) for m in ms], pa.int64()), "coef": pa.array(coefs, pa.list_(pa.float64())), "intercept": pa.array(intercepts, pa.float64())})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ms, done = [], [], []  # groups read whole; groups without a net among them wait as well, as models
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(0).dictionary_encode()
            lists, label = b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            which, known = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(which)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                z = np.concatenate([np.ones((hi - lo, 1)), flat[at[lo] : at[hi]].reshape(hi - lo, -1), label[lo:hi, None]], 1)
                g = known[which[lo]]
                if names and names[-1] == g:
                    ms[-1] = ms[-1] + z.T @ z
                    continue
                if len(names) >= SOLVED:
                    yield from solve(names, ms).to_batches()
                    names, ms = [], []
                elif ms and ms[-1][0, 0] < least:  # the last group is whole and small
                    done.append((names.pop(), ms.pop()[[0]][:, [0, -1]]))
                    if len(done) >= 10 * SOLVED:
                        yield from solve(*map(list, zip(*done))).to_batches()
                        done = []
                names.append(g)
                ms.append(z.T @ z)
        for n, m in ((names, ms), tuple(map(list, zip(*done))) or ([], [])):
            if n:
                yield from solve(n, m).to_batches()

    def pieces(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        d = math.isqrt(len(t.column("m")[0].as_py()) // 8)
        return solve([key[0].as_py()], [sum(np.frombuffer(x, np.float64).reshape(d, d) for x in t.column("m").to_pylist())])

    add = attach or (lambda d: d)
    usable = train.filter(F.col(group).isNotNull() & F.col("y").isNotNull())
    hot = [r[0] for r in usable.groupBy(group).count().filter(F.col("count") > HOT_ROWS).select(group).collect()]  # at most one per HOT_ROWS rows
    cold = usable.filter(~F.col(group).isin(hot)) if hot else usable
    placed = add(cold.repartition(group)).sortWithinPartitions(group)  # sorted last: an order below a join would be dropped
    src = placed.select(group, F.col("features").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")).filter(F.col("x").isNotNull())
    out = src.mapInArrow(whole, schema)
    if hot:
        out = out.unionByName(group_moments(add(usable.filter(F.col(group).isin(hot))), group).groupBy(group).applyInArrow(pieces, schema))
    return out


def group_predict(model: DataFrame, query: DataFrame, group: str, contributions: bool = False, attach: Late | None = None) -> DataFrame:
    """query with y_pred (and ``base`` and the signed ``contributions`` of its features, which sum to it); NULL for a group without a model. ``attach`` adds features to rows without."""
    met = query.join(model.select(group, "coef", "intercept"), group, "left")
    met = attach(met) if attach else met
    parts = F.when(F.size("coef") > 0, F.zip_with(F.col("features").cast("array<double>"), "coef", lambda x, w: x * w)).otherwise(F.transform("features", lambda x: F.lit(0.0)))
    out = met.withColumn("contributions", parts).withColumn("y_pred", F.col("intercept") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x))
    return out.withColumnRenamed("intercept", "base").drop("coef") if contributions else out.drop("coef", "intercept", "contributions")


def per_group_elastic_net(train: DataFrame, query: DataFrame, group: str, alpha: float, l1_ratio: float, least: int = 30, attach: Late | None = None) -> DataFrame:
    """query with y_pred: an elastic net per group; groups with fewer than ``least`` rows or a constant label use their mean, unknown groups the global mean."""
    g = F.broadcast(train.agg(F.avg("y").alias("_g")))  # one row
    p = group_predict(group_linear(train, group, alpha, l1_ratio, least, attach), query, group, attach=attach)
    return p.crossJoin(g).withColumn("y_pred", F.coalesce("y_pred", "_g")).drop("_g")


def pathway_additive(train: DataFrame, query: DataFrame, group: str, alpha: float = 1.0) -> DataFrame:
    """query with base, contributions and y_pred: a compound's main effect plus, per set score of the cell, the compound's own coefficient times the score.

    The additive model of set scores with signed contributions, its coefficients fitted in closed form per compound (ridge) instead of by gradient
    descent through an encoder of the structure: a compound that was not trained has no row of coefficients and a NULL prediction.
    """
    return group_predict(group_linear(train, group, alpha, None, least=2), query, group, contributions=True)


#: The parameter grids of the model families.
GRIDS = {
    "global_mean": {}, "drug_mean": {}, "cell_mean": {}, "two_way_additive": {},
    "structure_only_ridge": {"alpha": [0.1, 1.0, 10.0]}, "expression_only_ridge": {"alpha": [0.1, 1.0, 10.0]}, "ridge": {"alpha": [0.1, 1.0, 10.0]},
    "elasticnet": {"alpha": [0.01, 0.1], "l1_ratio": [0.1, 0.5]}, "per_drug_elasticnet": {"alpha": [0.01, 0.1], "l1_ratio": [0.1, 0.5]},
    "tree": {"max_features": [0.1, 0.3], "max_depth": [12, 20]}, "neighbor": {"k": [1, 3, 5]},
    "mlp": {"lr": [3e-4, 1e-3], "weight_decay": [1e-4, 1e-3], "dropout": [0.1, 0.2]},
}


def grid(name: str) -> list[dict]:
    """All parameter combinations of a family, the last parameter varying fastest."""
    space = GRIDS[name]
    return [dict(zip(space, values)) for values in product(*space.values())]


def select_trial(trials: DataFrame, by: list[str], guard: float = 1.02) -> DataFrame:
    """One trial per run: among those with RMSE within ``guard`` of the mean baseline the best macro metric, then RMSE, then trial number; if none is, the least RMSE.

    Columns: by, trial_no, macro (nullable), rmse, baseline_rmse.
    """
    ok = F.col("rmse") <= F.col("baseline_rmse") * guard
    t = trials.withColumn("eligible", ok)
    order = [F.col("eligible").desc(), F.when(F.col("eligible"), F.col("macro")).desc_nulls_last(), F.col("rmse"), F.col("trial_no")]
    return top_k(t, by, 1, *order).drop("rank")


def contribution_mismatch(pred: DataFrame, parts: list[str], total: str = "y_pred", atol: float = 1e-6) -> DataFrame:
    """Rows whose components do not sum to the prediction."""
    s = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return pred.filter(F.abs(s - F.col(total)) > atol)
