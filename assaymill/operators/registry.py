"""Run registry, plans and reports: one append-only event table; states, conflicts and reports are queries over it."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

FINAL = ("succeeded", "smoke")
#: Which state may follow which; "" is the state before the first event. A final state is followed by nothing.
TRANSITIONS = (("", "planned"), ("planned", "running"), ("planned", "incomplete"), ("running", "succeeded"), ("running", "smoke"), ("running", "failed"), ("running", "incomplete"), ("failed", "planned"), ("incomplete", "planned"))
EVENT = "run_key string, model string, config string, status string, at_utc timestamp, seq bigint, detail string"


class NotConverged(RuntimeError):
    """An iteration that ended before it settled."""


#: Failure classes by type of error, the first that fits.
FAILURES = ((MemoryError, "oom"), (NotConverged, "non_convergence"), (ArithmeticError, "non_finite"))


def failure_class(error: BaseException) -> str:
    return next((name for kind, name in FAILURES if isinstance(error, kind)), "other")


def canonical_json(value: object) -> str:
    """Sorted keys, two blanks, UTF-8, no NaN."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False)


def content_key(value: object) -> str:
    """The name of a configuration: the digest of its canonical text."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def publish(spark: SparkSession, path: str, value: object) -> None:
    """Canonical JSON at ``path`` on any file system Spark reaches: written beside it, then renamed, so that a reader sees a whole file only."""
    text = canonical_json(value)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    target, draft = path_of(path), path_of(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"cannot rename to {path}")


def events(spark: SparkSession, root: str) -> DataFrame:
    """The append-only event table of all runs; empty where nothing has been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(EVENT).json(root) if there else spark.createDataFrame([], EVENT)


def record(spark: SparkSession, root: str, model: str, config: dict, status: str, detail: str = "") -> str:
    """Append an event for the run of this configuration and return the run's key.

    The only rule is the table of transitions: a new run starts as planned, a failed or incomplete one may be planned again, a finished one is
    never touched. An event it does not declare raises and is not written.
    """
    key = content_key({"model": model, "config": config})
    now = current(events(spark, root).filter(F.col("run_key") == key)).first()
    before = now["status"] if now else ""
    if (before, status) not in TRANSITIONS:
        raise ValueError(f"run {key[:12]} cannot go from {before or 'nothing'} to {status}")
    row = (key, model, canonical_json(config), status, datetime.now(timezone.utc).replace(tzinfo=None), (now["seq"] if now else 0) + 1, detail)
    spark.createDataFrame([row], EVENT).coalesce(1).write.mode("append").json(root)
    return key


def record_failure(spark: SparkSession, root: str, model: str, config: dict, error: BaseException) -> str:
    return record(spark, root, model, config, "failed", f"{failure_class(error)}: {error}")


def current(log: DataFrame) -> DataFrame:
    """(run_key, model, config, status, seq, at_utc, n_events, n_failed): a row per run, its last event."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    return log.groupBy("run_key").agg(last("model"), last("config"), last("status"), F.max("seq").alias("seq"), last("at_utc"), F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("status") == "failed").alias("n_failed"))


def transition_violations(log: DataFrame, run: str = "run_key", status: str = "status", order: tuple[str, ...] = ("seq",), allowed: Iterable[tuple[str, str]] = TRANSITIONS) -> DataFrame:
    """(run, from_status, to_status, n): steps of any run that the table of transitions does not declare; no row means a sound log."""
    w = Window.partitionBy(run).orderBy(*order)
    steps = log.select(run, F.coalesce(F.lag(status).over(w), F.lit("")).alias("from_status"), F.col(status).alias("to_status"))
    declared = F.broadcast(log.sparkSession.createDataFrame(list(allowed), "from_status string, to_status string"))  # a handful of rows
    return steps.join(declared, ["from_status", "to_status"], "left_anti").groupBy(run, "from_status", "to_status").agg(F.count(F.lit(1)).alias("n"))


def contested_keys(log: DataFrame) -> DataFrame:
    """(run_key, n_configs): keys under which several models or configurations were written; no row means keys are unique."""
    return log.groupBy("run_key").agg(F.countDistinct("model", "config").alias("n_configs")).filter("n_configs > 1")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir, model, run_key, status, at_utc): configuration files below a folder joined with the status files beside them, one row per run."""
    folder = F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]+$", 1)
    read = lambda name, schema: spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root).withColumn("run_dir", folder)
    c = read("config.json", "run_key string, model string")
    s = read("status.json", "run_key string, status string, at_utc string").drop("run_key")
    return c.join(s, "run_dir", "left")


def latest_status(events: DataFrame, entity: str, state: str, at: str, tie: str, bad: Iterable[str] = ("failed", "incomplete")) -> DataFrame:
    """(entity, status, n_events, n_bad): the last state of each entity and how often it failed."""
    return events.groupBy(entity).agg(
        F.max_by(state, F.struct(at, tie)).alias("status"), F.count(F.lit(1)).alias("n_events"), F.count_if(F.col(state).isin(*bad)).alias("n_bad")
    )


def plan(spark: SparkSession, models: list[str], protocols: list[str], seeds: list[int], deterministic: Iterable[str], limit: int) -> DataFrame:
    """(model, protocol, seed): the entries of a study, a cross product of its three short lists; a model without randomness runs with the first seed only.

    More than ``limit`` entries are refused.
    """
    once = list(deterministic)
    lists = [spark.createDataFrame([(x,) for x in values], f"{name} {kind}") for name, kind, values in (("model", "string", models), ("protocol", "string", protocols), ("seed", "int", seeds))]
    entries = lists[0].crossJoin(F.broadcast(lists[1])).crossJoin(F.broadcast(lists[2])).filter(~F.col("model").isin(once) | (F.col("seed") == seeds[0]))
    if (n := entries.count()) > limit:
        raise ValueError(f"{n} entries exceed the budget of {limit}")
    return entries


def missing_entries(entries: DataFrame, done: DataFrame) -> DataFrame:
    """Planned entries without a finished run."""
    return entries.join(done.filter(F.col("status").isin(*FINAL)), ["model", "protocol", "seed"], "left_anti")


def pair_controls(runs: DataFrame, controls: DataFrame) -> DataFrame:
    """Runs beside the run of their control model; ambiguous runs (several of one model, protocol and seed) are left out."""
    key = ["model", "protocol", "seed"]
    single = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("macro").alias("macro")).filter("n = 1").drop("n")
    c = single.select(F.col("model").alias("control"), "protocol", "seed", F.col("macro").alias("control_macro"))
    return single.join(controls, "model").join(c, ["control", "protocol", "seed"]).withColumn("gain", F.col("macro") - F.col("control_macro"))


def learning_curve(runs: DataFrame) -> DataFrame:
    """(model, n_train, macro): mean over seeds, for models seen at two training sizes or more."""
    pts = runs.groupBy("model", "n_train").agg(F.avg("macro").alias("macro"), F.count(F.lit(1)).alias("n_runs"))
    many = pts.groupBy("model").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("model")
    return pts.join(many, "model", "left_semi")


def markdown(title: str, rows: list[dict], columns: list[str]) -> str:
    """A small result as a Markdown section."""
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def preflight(upstream: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("data_hash", "split_hash", "code_hash")) -> DataFrame:
    """(run_key, problem): what keeps a run from building on the run it names: it is missing, not finished, or one of its hashes differs.

    ``expected``: run_key and the hashes wanted; ``upstream``: run_key, status and the hashes written.
    """
    have = upstream.select("run_key", F.col("status"), F.lit(1).alias("_there"), *[F.col(k).alias(f"_{k}") for k in keys])
    met = expected.join(have, "run_key", "left")
    there = F.col("_there").isNotNull()
    checks = [F.when(~there, F.lit("missing")), F.when(there & ~F.coalesce(F.col("status").isin(*FINAL), F.lit(False)), F.concat(F.lit("status:"), F.coalesce("status", F.lit("none"))))]
    checks += [F.when(there & ~F.col(k).eqNullSafe(F.col(f"_{k}")), F.lit(k)) for k in keys]
    return met.select("run_key", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def run_record(stage: str, inputs: dict[str, str], outputs: dict[str, str], policy: dict) -> dict:
    """Resolved configuration of a stage with the digests of what it read and wrote."""
    body = {"stage": stage, "inputs": inputs, "policy": policy}
    return {**body, "run_key": content_key(body), "outputs": outputs, "at_utc": datetime.now(timezone.utc).isoformat()}
