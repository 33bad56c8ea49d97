"""The corpus pipeline: a quality filter, near-dedup, substring dedup, secret removal, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents; further
columns of docs stay. Each row counts as a document of its own, whether or not its id repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm import chunks, minhash, packing, quality, secrets
from narrata.llm.common import durable

#: A column for a row's number or mark, as ids may repeat.
ROW = "__pipeline_row"


def quality_filter(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the co-trained classifier finds bad. Null and empty texts are scored as empty, repeated rows alike;
    where there are no labels, or of one kind only, all stay; an empty table gives no rows."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, machine, "__pipeline_").where(F.col("__pipeline_quality") >= quality.REJECT).select(*docs.columns)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id (of equal ids the first, null last) of each group of near duplicates
    (five-word shingles, similarity 0.8). Of a repeated row one stays, of two texts with one id both, unless they are near. Null,
    empty and wordless texts all stay; an empty table gives no rows."""
    rows = durable(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline_rows")  # written: the numbers stay
    groups = minhash.near_duplicates(rows, k=5, percent=80, key=ROW).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("__pipeline_group"))
    groups = durable(groups.join(rows.select(ROW, "doc_id"), ROW), "pipeline_groups")
    first = groups.groupBy("__pipeline_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first"), F.count("*").alias("n"))
    gone = groups.join(first.where("n > 1"), "__pipeline_group").where(F.col(ROW) != F.col(f"first.{ROW}")).select(ROW)
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def substring_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that an earlier document has; the document stays, whatever is left of it. Earlier is by id, of equal ids
    by the order of the input. Null and empty texts stay as they are, and so do rows without an id, which are compared
    with nothing; an empty table gives no rows."""
    rest = [c for c in docs.columns if c != "text"]
    # Ids may repeat, so each row carries its columns along; rows without an id are not compared.
    found = chunks.repeated_spans(docs.withColumn(ROW, F.col("text").isNull()), keep_text=True, keep=(*rest, ROW))
    found = found.select(*(F.col("kept")[c].alias(c) for c in rest), F.when(~F.col("kept")[ROW], F.col("text")).alias("text"))
    out = found.unionByName(docs.where(F.col("doc_id").cast("long").isNull()))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def secret_removal(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in each secret's place. Null texts stay null; repeated rows are treated alike; an empty table gives no rows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1024. Null and empty texts are one token; repeated rows and null ids are packed
    each; an empty table gives no rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secrets", secret_removal),
    ("packing", pack),
]
#: SQL can express none of the classifier, the gear chunks or the packing.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs, f"pipeline_{name}")
    return docs
