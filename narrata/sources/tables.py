"""Parquet tables and the adapter views that give them the engine's record types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, where a scan gives fewer partitions than there are cores (one small file with one row group):
    texts cost far more to process than to move then. A scan of many files stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles; dates are spread by id, as documents have none."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("article_id"),
        F.col("source").alias("source_id"),
        F.lit("").alias("title"),
        F.coalesce("text", F.lit("")).alias("body"),
        F.date_add(F.lit("2010-01-01").cast("date"), (F.col("doc_id") * 37 % 5475).cast("int")).alias("day"),
        F.col("lang").alias("language"),
    )


ARTICLES_SQL = """art AS (SELECT CAST(doc_id AS VARCHAR) AS article_id, source AS source_id, '' AS title, coalesce(text, '') AS body,
  CAST(DATE '2010-01-01' + CAST(doc_id * 37 % 5475 AS INTEGER) AS DATE) AS day, lang AS language FROM documents)"""


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as (article, topic, source, day); topic -1 is noise."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("article_id"),
        (F.col("o_custkey") % 40 - 1).cast("int").alias("topic"),
        F.col("o_orderpriority").alias("source_id"),
        F.col("o_orderdate").cast("date").alias("day"),
    )


VOLUME_SQL = """vol AS (SELECT o_orderkey AS article_id, CAST(o_custkey % 40 - 1 AS INTEGER) AS topic, o_orderpriority AS source_id,
  CAST(o_orderdate AS DATE) AS day FROM orders)"""


def event_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("article_id"), F.col("event_type").alias("topic"), F.col("user_id"), F.col("value"), F.col("ts").cast("date").alias("day")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("topic"), "embedding")


def press(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a daily external series by query: counts, totals and their ratio."""
    daily = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("query"), F.col("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("story_count"))
    total = daily.groupBy("day").agg(F.sum("story_count").alias("total_count"))
    return daily.join(total, "day").withColumn("ratio", F.col("story_count") / F.col("total_count"))


PRESS_SQL = """press AS (SELECT query, day, story_count, CAST(sum(story_count) OVER (PARTITION BY day) AS BIGINT) AS total_count,
  story_count / sum(story_count) OVER (PARTITION BY day) AS ratio FROM (SELECT l_returnflag AS query, CAST(l_shipdate AS DATE) AS day,
  count(*) AS story_count FROM lineitem GROUP BY 1, 2))"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily level series."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.avg("l_extendedprice").alias("value"))
