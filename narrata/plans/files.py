"""Queries that write files of each kind and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import jsonl as J
from ..sources import tables as T
from ..sources.shared import folder
from .registry import query
from .text import ART

OUT = ", ".join(f"'{x}'" for x in J.EXCLUDED)


def _articles(spark, d):
    """Articles as JSON lines, every tenth without a title, every seventh of an excluded source."""
    n = F.col("article_id").cast("long")
    rows = T.articles(spark, d).withColumn("title", F.when(n % 10 != 0, F.col("title"))).withColumn("source_id", F.when(n % 7 == 0, "Reuters").otherwise(F.col("source_id")))
    rows = rows.withColumns({"url": F.concat(F.lit("https://example.org/"), "article_id"), "published_at": F.lit("2020-01-01T00:00:00Z")})
    path = folder(spark, "articles")
    J.write_jsonl(rows, path)
    return J.scan(spark, path)


@query(f"{ART} SELECT article_id, source_id FROM art WHERE CAST(article_id AS BIGINT) % 10 <> 0 AND CAST(article_id AS BIGINT) % 7 <> 0 AND lower(source_id) NOT IN ({OUT})")
def jsonl_articles(spark, d):
    """Articles written as JSON lines and scanned: those with all they need, less excluded sources."""
    return J.well_formed(_articles(spark, d)).select("article_id", "source_id")


@query(f"{ART} SELECT count(*) AS n_records, count(*) FILTER (CAST(article_id AS BIGINT) % 10 = 0) AS n_malformed FROM art WHERE CAST(article_id AS BIGINT) % 7 <> 0 AND lower(source_id) NOT IN ({OUT})")
def jsonl_malformed(spark, d):
    """How many scanned records lack what all must have."""
    return J.malformed(_articles(spark, d))


@query("SELECT o_orderstatus, o_orderkey FROM orders")
def parquet_partitions(spark, d):
    """Orders written by status and read back, the status from the folders' names."""
    path = folder(spark, "orders")
    J.write_parquet(T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return spark.read.parquet(path).select(F.col("o_orderstatus").cast("string").alias("o_orderstatus"), "o_orderkey")


@query("SELECT s_suppkey, s_name FROM supplier")
def csv_report(spark, d):
    """Suppliers written as CSV with a header and read back."""
    rows = T.table(spark, d, "supplier").select("s_suppkey", "s_name")
    path = folder(spark, "suppliers")
    J.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def current_version(spark, d):
    """The version that is current after two were written."""
    rows, root = T.table(spark, d, "orders"), folder(spark, "versions")
    J.write_version(rows.where("o_orderstatus = 'O'").select("o_orderkey"), root, "1")
    J.write_version(rows.where("o_orderstatus = 'F'").select("o_orderkey"), root, "2")
    return J.read_current(spark, root)
