"""Rendezvous hashing of stable record keys over weighted shards. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (index into weights) that wins `key`: the largest weight / -ln(u), u being a hash of key and
    shard in (0, 1). Adding a shard moves rows only into it; a null key has a hash of its own; on equal
    scores (never seen, as u has 52 bits) the larger index wins. Weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def score(i: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit("shard"), F.lit(i), key), 12)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))
        return F.struct((F.lit(float(weight)) / -F.log(u)).alias("score"), F.lit(i).alias("shard"))

    return F.greatest(*[score(i, w) for i, w in enumerate(weights)])["shard"] if len(weights) > 1 else F.lit(0)


def shard(df: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """df with the column `name`: the shard of each row. Rows with equal keys share a shard."""
    return df.withColumn(name, rendezvous(F.col(key), weights))


def slots(df: DataFrame, key: str, order: Sequence[str], name: str = "slot", spread: int | None = None) -> DataFrame:
    """df with gapless positions from 0 within each value of `key`.

    A shard is dealt over `spread` buckets (as many as shuffle partitions, 64 at least) of a hash of the first column of
    `order`, so no shard lands in one task; a bucket's start is the count of the buckets before it, joined by the
    keys that the rows are dealt by already. Repeated rows get slots of their own; an empty table gives no rows."""
    spread = spread or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucketed = df.withColumn("__bucket", F.pmod(F.xxhash64(F.lit("slot"), F.col(order[0])), F.lit(spread)).cast("int"))
    sizes = bucketed.groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(key).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(F.col(key).alias("__key"), F.col("__bucket").alias("__at"), F.coalesce(before, F.lit(0)).alias("__start"))
    placed = bucketed.withColumn("__row", F.row_number().over(W.partitionBy(key, "__bucket").orderBy(*order)) - 1)
    joined = placed.join(starts, placed[key].eqNullSafe(starts["__key"]) & (placed["__bucket"] == starts["__at"]))
    return joined.withColumn(name, (F.col("__start") + F.col("__row")).cast("long")).drop(
        "__bucket", "__key", "__at", "__start", "__row", "__n"
    )


def op9_rendezvous_shards(spark, sf_dir: str, shards: int = 8) -> DataFrame:
    """All documents in equal-weight shards by doc_id. A null text has size 1 and the checksum of no bytes; null ids share a
    shard; rows that share an id share its shard, each with a slot of its own; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = shard(rows, "doc_id", [1.0] * shards)
    rows = shard(rows, "doc_id", [1.0] * (shards + 1), "grown_shard")
    return slots(rows, "shard", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
