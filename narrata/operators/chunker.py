"""Windows of tokens over long bodies. White-space words stand for the tokens of a model that isn't here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import PARAMS


def chunks(articles: DataFrame, size: int = PARAMS.chunk_tokens, overlap: int = PARAMS.chunk_overlap) -> DataFrame:
    """articles as chunks: chunk_id ({article_id}_c000), chunk_index, chunk_total, is_chunked, body, word_count. A body of at
    most `size` tokens stays as it is; else windows of `size` start every size - overlap, and the last one ends at the end."""
    step = size - overlap
    rows = articles.withColumn("__w", X.words(F.col("body")))
    n = F.size("__w")
    total = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")
    rows = rows.withColumn("chunk_total", total).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("chunk_total") - 1)))
    body = F.when(F.col("chunk_total") == 1, F.col("body")).otherwise(F.array_join(F.slice("__w", F.col("chunk_index") * step + 1, F.lit(size)), " "))
    rows = rows.withColumn("body", body).withColumn("is_chunked", F.col("chunk_total") > 1)
    name = F.concat_ws("_c", "article_id", F.lpad(F.col("chunk_index").cast("string"), 3, "0"))
    return rows.withColumn("chunk_id", name).withColumn("word_count", X.word_count(F.col("body"))).drop("__w")


def representatives(chunked: DataFrame) -> DataFrame:
    """Each article's first chunk."""
    return chunked.where("chunk_index = 0")


def fold(chunked: DataFrame, *keys: str) -> DataFrame:
    """Articles again: bodies joined by a space in chunk order, other columns from the first chunk."""
    others = [c for c in chunked.columns if c not in {*keys, "body", "chunk_index", "chunk_id"}]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "body"))), lambda x: x["body"]), " ")
    return chunked.groupBy(*keys).agg(body.alias("body"), *(F.min_by(c, "chunk_index").alias(c) for c in others))
