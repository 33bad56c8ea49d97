"""Story cards: what a cluster's articles say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def source_mix(rows: DataFrame, top: int = 8) -> DataFrame:
    """A topic's most frequent sources by articles; ties to the smaller name."""
    by = rows.groupBy("topic", "source_id").agg(F.countDistinct("article_id").alias("n"))
    best = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("n"), "source_id"))
    return by.withColumn("rank", best).where(F.col("rank") <= top)


def date_facts(rows: DataFrame) -> DataFrame:
    """First, last and most frequent day (the earliest, on ties) of a topic, and its articles."""
    daily = rows.where("day is not null").groupBy("topic", "day").agg(F.countDistinct("article_id").alias("n"))
    return daily.groupBy("topic").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.max_by("day", F.struct("n", (-F.unix_date("day")).alias("d"))).alias("peak_day"), F.sum("n").alias("article_days"))


def term_hits(text: Column, terms: Column) -> Column:
    """How often the terms occur in a text, in any case."""
    low = F.lower(text)
    return F.aggregate(terms, F.lit(0), lambda s, t: s + ((F.length(low) - F.length(F.replace(low, F.lower(t), F.lit("")))) / F.length(t)).cast("int"))


def panels(rows: DataFrame, terms: DataFrame, each: int = 3, excerpt: int = 200) -> DataFrame:
    """(topic, panel, rank, article_id, excerpt, hits): central articles (most term hits, longest, newest), then the earliest
    and the newest of the others; none twice. One ranking over a topic's articles gives all three: an article's place by
    date among those that aren't central follows by counting, so there is no self-join."""
    w = W.partitionBy("topic")
    scored = rows.join(F.broadcast(terms), "topic").withColumn("hits", term_hits(F.col("body"), F.col("terms")))  # one row a topic
    scored = scored.withColumn("c", F.row_number().over(w.orderBy(F.desc("hits"), F.desc(F.length("body")), F.desc("day"), "article_id")))
    rest = F.when((F.col("c") > each) & F.col("day").isNotNull(), 1)
    scored = scored.withColumn("rest", rest)
    scored = scored.withColumn("e", F.when(F.col("rest") == 1, F.row_number().over(W.partitionBy("topic", "rest").orderBy("day", "article_id"))))
    later = F.when(F.col("e") > each, 1)
    scored = scored.withColumn("later", later)
    scored = scored.withColumn("l", F.when(F.col("later") == 1, F.row_number().over(W.partitionBy("topic", "later").orderBy(F.desc("day"), "article_id"))))
    panel = F.when(F.col("c") <= each, "central").when(F.col("e") <= each, "earliest").when(F.col("l") <= each, "newest")
    rank = F.when(F.col("c") <= each, F.col("c")).when(F.col("e") <= each, F.col("e")).otherwise(F.col("l"))
    return scored.withColumn("panel", panel).where("panel is not null").select("topic", "panel", rank.alias("rank"), "article_id", X.excerpt(F.col("body"), excerpt).alias("excerpt"), "hits")


def median_words(articles: DataFrame) -> DataFrame:
    """The median article's words, halves to the even number."""
    return articles.agg(F.bround(F.median(X.word_count(F.col("body"))), 0).cast("long").alias("median_words"))


def signature(terms: Column, excerpts: Column, sources: Column, model: str, version: str) -> Column:
    """The key under which a cluster's name is kept: dates and newest articles don't change it."""
    return F.sha1(F.to_json(F.struct(terms.alias("terms"), excerpts.alias("excerpts"), sources.alias("sources"), F.lit(model).alias("model"), F.lit(version).alias("version"))))
