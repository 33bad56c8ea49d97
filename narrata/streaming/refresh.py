"""Streaming forms of the weekly refresh: late articles within a buffer, repeats dropped, weeks counted, upserts by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PARAMS
from ..sources.jsonl import EXCLUDED


def article_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fresh_articles(stream: DataFrame, time: str, key: str, lateness_days: int = PARAMS.buffer_days) -> DataFrame:
    """The first of each key; state is dropped once the watermark has passed, so it doesn't grow with the corpus."""
    return stream.withWatermark(time, f"{lateness_days} days").dropDuplicatesWithinWatermark([key])


def without_excluded(stream: DataFrame, source: str = "source_id") -> DataFrame:
    return stream.where(~F.lower(source).isin(*EXCLUDED))


def weekly_counts(stream: DataFrame, time: str, key: str, lateness_days: int = PARAMS.buffer_days) -> DataFrame:
    """Rows by Monday week and key; a week is given out once it can't change."""
    window = F.window(time, "7 days", "7 days", "4 days")  # the epoch began on a Thursday
    return stream.withWatermark(time, f"{lateness_days} days").groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("week"), key, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str, lateness: str) -> DataFrame:
    """Runs of a key's rows with no longer gap than `gap`."""
    return stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def upsert(root: str, key: str, order: str):
    """A foreachBatch function that keeps the latest row of each key: a batch is written as a version of its own, so that one
    that runs again after a failure overwrites itself; `latest` reads over all versions."""

    def run(batch: DataFrame, number: int) -> None:
        best = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        best.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return run


def latest(spark: SparkSession, root: str, key: str, order: str) -> DataFrame:
    rows = spark.read.parquet(root)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order, "batch")).alias("r")).select("r.*").drop("batch")


def run_now(stream: DataFrame, checkpoint: str, sink, mode: str = "append"):
    """Processes what is there and ends. sink: a foreachBatch function."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
