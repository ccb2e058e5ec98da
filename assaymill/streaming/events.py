"""Structured Streaming over event files: an extension beyond the reference, which has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TIME = "timestamp"


def open_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files that match ``path``; the schema comes from them once, event time becomes a zoned timestamp."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    src = spark.readStream.schema(schema)
    flat = src.option("pathGlobFilter", name).parquet(folder) if not _is_folder(spark, path) else src.parquet(path)
    return flat.withColumn("ts", F.col("ts").cast(TIME))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed(spark: SparkSession, path: str, out: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(hour_start, event_type, n, total): tumbling windows; every batch's changed windows are appended to files, the last value of a window counts.

    Update mode with an idempotent batch sink: a repeated batch rewrites its own folder. The run ends when the available files are read.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/rows/batch={epoch}")

    agg = (
        open_stream(spark, path).withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("hour_start"), "event_type", "n", "total")
    )
    q = agg.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.groupBy("hour_start", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("x"))
    return last.select(F.col("hour_start").cast("timestamp_ntz").alias("hour_start"), "event_type", "x.n", F.round("x.total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, started, n): session windows; also usable on a stream with a watermark."""
    e = events.withColumn("ts", F.col("ts").cast(TIME))
    s = e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")
