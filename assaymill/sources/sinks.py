"""Sinks: delimited text, Parquet, pivoted contributions, JSON, append-only logs, content-addressed feature folders, model round trips."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` for small reports only."""
    (df.coalesce(1) if single else df).write.csv(path, header=True, mode="errorifexists", emptyValue="", nullValue="")


def csv_report(df: DataFrame, path: Path, limit: int = 100_000) -> int:
    """One local file with a header even for no rows; refuses results beyond a report's size."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    import csv as text

    with path.open("w", newline="", encoding="utf-8") as f:
        w = text.writer(f)
        w.writerow(df.columns)
        w.writerows(["" if v is None else v for v in r] for r in rows)
    return len(rows)


def parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    (df.write.partitionBy(*by) if by else df.write).mode(mode).parquet(path)


def wide_contributions(df: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One column per set; the names are given, so no extra pass finds them."""
    return df.groupBy(key).pivot(name, names).agg(F.first(value))


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def feature_dir(root: str, *parts: object) -> str:
    """A folder named by the chained hashes of its inputs and policies: another configuration is another folder."""
    chain, names = "", []
    for p in parts:
        chain = hashlib.sha256((chain + json.dumps(p, sort_keys=True)).encode()).hexdigest()
        names.append(chain[:16])
    return "/".join([root.rstrip("/"), *names])


def cached_features(df: DataFrame, root: str, *parts: object) -> DataFrame:
    """Write once to the content-addressed folder, then read; an unfinished folder (without its success mark) is replaced."""
    spark: SparkSession = df.sparkSession
    path = feature_dir(root, *parts)
    jvm = spark._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def reload_changes(model, data: DataFrame, path: str, key: str, column: str = "y_pred") -> DataFrame:
    """Rows whose prediction changes when the model is saved and loaded again; no row means an exact round trip."""
    model.write().overwrite().save(path)
    again = type(model).load(path)
    a, b = (m.setPredictionCol(column).transform(data).select(key, column) for m in (model, again))
    return a.exceptAll(b)


def publish(folder: Path, target: Path) -> None:
    """Swap a finished folder into place."""
    old = target.with_name(target.name + ".old")
    if target.exists():
        os.replace(target, old)
    os.replace(folder, target)
    shutil.rmtree(old, ignore_errors=True)
