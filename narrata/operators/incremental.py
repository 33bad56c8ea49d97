"""What a weekly refresh needs: windows, plans, merges and the gate before a commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as X
from ..schema import PARAMS
from .similar import centroids


def delta_windows(articles: DataFrame, members: DataFrame, today: str, full_start: str, buffer: int = PARAMS.buffer_days) -> DataFrame:
    """(source, start, end): each source from its own last date less the buffer; a composite from its laggiest member; one
    without articles from the full start. members: (source, member)."""
    last = articles.where("day is not null").groupBy(F.col("source_id").alias("member")).agg(F.max("day").alias("last"))
    low = members.join(last, "member", "left").groupBy("source").agg(F.min("last").alias("last"))
    start = F.coalesce(F.date_sub("last", buffer), F.lit(full_start).cast("date"))
    return low.select("source", start.alias("start"), F.lit(today).cast("date").alias("end"))


def embed_plan(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks (chunk_id, text_sha1) with reuse: whether the cache (chunk_id, text_sha1) holds a vector for this very text."""
    known = cache.select("chunk_id", "text_sha1").distinct().withColumn("__hit", F.lit(True))
    return chunks.join(known, ["chunk_id", "text_sha1"], "left").withColumn("reuse", F.coalesce("__hit", F.lit(False))).drop("__hit")


def assembled(chunks: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Each chunk's vector: the cache's for its very text (the first, if it has several), else the fresh one; raises if one
    has neither."""
    one = cache.groupBy("chunk_id", "text_sha1").agg(F.min("embedding").alias("__c"))
    out = chunks.join(one, ["chunk_id", "text_sha1"], "left").join(fresh.select("chunk_id", F.col("embedding").alias("__f")), "chunk_id", "left")
    vector = F.coalesce("__c", "__f")
    checked = F.when(vector.isNull(), F.raise_error(F.concat(F.lit("no vector for "), "chunk_id")).cast("array<float>")).otherwise(vector)
    return out.withColumn("embedding", checked).drop("__c", "__f")


def missing(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't known."""
    return rows.join(known.select(*keys), list(keys), "left_anti")


def merge_by_date(cached: DataFrame, fresh: DataFrame, *keys: str) -> DataFrame:
    """Both series by date; where both have one, the fresh row."""
    both = cached.withColumn("__f", F.lit(0)).unionByName(fresh.withColumn("__f", F.lit(1)))
    best = F.row_number().over(W.partitionBy(*keys, "day").orderBy(F.desc("__f")))
    return both.withColumn("__r", best).where("__r = 1").drop("__f", "__r")


def fetch_ranges(first: str | None, last: str | None, start: str, end: str, refetch: int, today: str) -> list[tuple[str, str]]:
    """Ranges of a request that a cache from first to last lacks: what lies before it, and a recent window that is still
    subject to change or not reached. Inclusive."""
    from datetime import date, timedelta

    if first is None:
        return [(start, end)]
    day, step = date.fromisoformat, timedelta
    out = []
    if day(start) < day(first):
        out.append((start, (day(first) - step(1)).isoformat()))
    if day(last) < day(end) or day(end) >= day(today) - step(refetch):
        a = max(day(start), min(day(last), day(end)) - step(refetch))
        if a <= day(end):
            out.append((a.isoformat(), end))
    return out


def merge_week(base: DataFrame, new: DataFrame, width: int, similarity: float = PARAMS.merge_similarity) -> DataFrame:
    """(topic, merged, similarity, appended) for each topic of the new week: the base topic with the nearest centroid if near
    enough, else a number after the base's last, in the order of the new topics. Base numbers never change."""
    old = centroids(base.where("topic >= 0"), width).select(F.col("topic").alias("base_topic"), F.col("centroid").alias("b"))
    own = centroids(new.where("topic >= 0"), width).select("topic", F.col("centroid").alias("a"))
    near = own.crossJoin(F.broadcast(old)).select("topic", "base_topic", X.cosine("a", "b").alias("similarity"))  # topics x topics
    best = near.withColumn("r", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("similarity"), "base_topic"))).where("r = 1")
    best = best.withColumn("appended", F.col("similarity") < similarity)
    place = F.row_number().over(W.partitionBy("appended").orderBy("topic"))
    top = base.agg(F.max("topic").alias("top"))
    out = best.withColumn("place", place).crossJoin(F.broadcast(top))
    return out.select("topic", F.when(F.col("appended"), F.col("top") + F.col("place")).otherwise(F.col("base_topic")).cast("int").alias("merged"), "similarity", "appended")


def merged_assignment(chunks: DataFrame, old: DataFrame, delta: DataFrame) -> DataFrame:
    """Each chunk's old topic, else its new one; raises if it has neither."""
    out = chunks.join(old.select("chunk_id", F.col("topic").alias("__o")), "chunk_id", "left").join(delta.select("chunk_id", F.col("topic").alias("__n")), "chunk_id", "left")
    topic = F.coalesce("__o", "__n")
    checked = F.when(topic.isNull(), F.raise_error(F.concat(F.lit("no topic for "), F.col("chunk_id").cast("string"))).cast("int")).otherwise(topic)
    return out.withColumn("topic", checked).drop("__o", "__n")


def lost_ids(base: DataFrame, merged: DataFrame) -> DataFrame:
    """Base topics that a merge lost: must be empty before anything is written."""
    return missing(base.where("topic >= 0").select("topic").distinct(), merged, "topic")


def carry_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """(topic, name): new names, else old ones."""
    return old.select("topic", F.col("name").alias("__o")).join(new.select("topic", F.col("name").alias("__n")), "topic", "full").select("topic", F.coalesce("__n", "__o").alias("name"))


def merge_shards(shards: DataFrame, key: str, shard: str, *place: str) -> DataFrame:
    """One row a key: the first shard's, of several the first by place; rows without a shard come last."""
    best = F.row_number().over(W.partitionBy(key).orderBy(F.asc_nulls_last(shard), *place))
    return shards.withColumn("__r", best).where("__r = 1").drop("__r")
