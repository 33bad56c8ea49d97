"""Sentences that recur across documents, and their removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import PARAMS


def sentence_rows(articles: DataFrame) -> DataFrame:
    """(article_id, pos, sentence, key, eligible) of each body's sentences."""
    rows = articles.select("article_id", F.posexplode(X.sentences(F.col("body"))).alias("pos", "sentence"))
    return rows.withColumn("key", X.match_key(F.col("sentence"))).withColumn("eligible", X.word_count(F.col("sentence")) >= PARAMS.boilerplate_sentence_words)


def templates(rows: DataFrame, least: int = PARAMS.boilerplate_df) -> DataFrame:
    """(key, df): eligible sentences found in at least `least` distinct documents. Distinct pairs are counted once per
    task before the shuffle, so a sentence that all documents share is no hot key."""
    return rows.where("eligible").groupBy("key").agg(F.countDistinct("article_id").alias("df")).where(F.col("df") >= least)


def strip_boilerplate(articles: DataFrame, least: int = PARAMS.boilerplate_df, content: int = PARAMS.boilerplate_content_words) -> DataFrame:
    """articles with body, removed (instances) and dropped: bodies that lost a template are joined anew with single spaces;
    those left with fewer than `content` words are dropped; others stay as they are."""
    rows = sentence_rows(articles)
    marked = rows.join(templates(rows, least).select("key", F.lit(True).alias("hit")), "key", "left")
    gone = F.col("hit").isNotNull() & F.col("eligible")
    kept = marked.groupBy("article_id").agg(
        F.count_if(gone).alias("removed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~gone, F.struct("pos", "sentence")))), lambda s: s["sentence"]), " ").alias("rest"),
    )
    out = articles.join(kept.where("removed > 0"), "article_id", "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    out = out.withColumn("body", F.when(F.col("removed") > 0, F.col("rest")).otherwise(F.col("body"))).drop("rest")
    return out.withColumn("dropped", (F.col("removed") > 0) & (X.word_count(F.col("body")) < content))
