"""Reading and writing article files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schema import ARTICLE

# Fixed value: sources left out before encoding.
EXCLUDED = ("ap_news", "apnews", "marketwatch", "reuters", "arxiv", "jackson_hole")


def scan(spark: SparkSession, path: str, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Articles of a file or folder of JSON lines. Blank lines are skipped, unknown keys dropped; a record whose source is
    excluded (in any case) is left out; malformed ones stay with _corrupt set, see `well_formed` and `malformed`."""
    schema = StructType([*ARTICLE.fields, StructField("_corrupt", StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path, pathGlobFilter="*.json*")
    rows = rows.withColumn("source_id", F.coalesce("source_id", "source")).drop("source")
    return rows.where(F.col("source_id").isNull() | ~F.lower("source_id").isin(*exclude))


def well_formed(rows: DataFrame) -> DataFrame:
    """Records that parse and have the keys that all must have."""
    needed = ("article_id", "source_id", "url", "published_at", "title")
    return rows.where(F.col("_corrupt").isNull() & F.coalesce(*(F.col(c) for c in needed)).isNotNull() & F.expr(" and ".join(f"{c} is not null" for c in needed))).drop("_corrupt")


def malformed(rows: DataFrame) -> DataFrame:
    """One row: how many records don't."""
    needed = ("article_id", "source_id", "url", "published_at", "title")
    bad = F.col("_corrupt").isNotNull() | F.expr(" or ".join(f"{c} is null" for c in needed))
    return rows.agg(F.count("*").alias("n_records"), F.count_if(bad).alias("n_malformed"))


def choose(explicit: str | None, corpus_file: str | None, raw_dir: str) -> tuple[str, bool]:
    """The input by precedence, and whether excluded sources must still be filtered from it."""
    return (explicit, False) if explicit else (corpus_file, False) if corpus_file else (raw_dir, True)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line; nulls left out."""
    rows.write.mode("overwrite").json(path)


def write_parquet(rows: DataFrame, path: str, *by: str) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_documents(rows: DataFrame, path: str, column: str = "json") -> None:
    """One JSON document a line."""
    rows.select(column).write.mode("overwrite").text(path)


def write_version(rows: DataFrame, root: str, version: str) -> str:
    """A new version beside the old ones; `current` names the one to read, and is written last. A failed write leaves the
    old one current."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{root}/v={version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return f"{root}/v={version}"


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{root}/current").first()[0]
    return spark.read.parquet(f"{root}/v={version}")
