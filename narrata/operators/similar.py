"""Clusters' centroids and their nearest neighbours by meaning, words and shape. Clusters are few against articles: pair
work is over clusters, after the floor; vectors are averaged before any pair is formed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as X
from ..schema import PARAMS
from ..sources.shared import written

#: Public names of the taxonomy's letters; those of macro-finance scope.
CODES = "ABCDEFGHIJKLMNOPQRYZ"
SCOPE = ("E", "F", "G", "H", "J")


def centroids(rows: DataFrame, width: int, key: str = "topic", vector: str = "embedding") -> DataFrame:
    """(key, centroid, n): the mean of a cluster's chunk vectors, summed map-side."""
    return rows.groupBy(key).agg(X.mean_vector(vector, width).alias("centroid"), F.count("*").alias("n"))


def ranked(pairs: DataFrame, score: str, k: int) -> DataFrame:
    """The k best partners of each src; equal scores go to the smaller id."""
    best = F.row_number().over(W.partitionBy("src").orderBy(F.desc(score), "dst"))
    return pairs.withColumn("rank", best).where(F.col("rank") <= k)


def nearest_by(rows: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(src, dst, score, rank): the k nearest of each topic by the dot product of its vector `u`, all of one length; equal scores (to
    nine places) go to the smaller id. Topics are dealt to blocks of bounded size; a pair of blocks is a matrix product
    that leaves k rows a topic."""
    rows = written(rows.select("topic", "u"), "vectors")
    n = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64("topic"), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = dealt.withColumn("j", every).select(F.col("slot").alias("i"), "j", F.lit(0).alias("side"), "topic", "u")
    right = dealt.withColumn("i", every).select("i", F.col("slot").alias("j"), F.lit(1), "topic", "u")

    def product(table: pa.Table) -> pa.Table:
        side, topic = (table.column(c).to_numpy() for c in ("side", "topic"))
        u = np.array(table.column("u").to_pylist(), np.float64).reshape(len(side), -1)
        src, dst = topic[side == 0], topic[side == 1]
        if not len(src) or not len(dst):
            return pa.table({"src": topic[:0], "dst": topic[:0], "score": np.zeros(0)})
        score = u[side == 0] @ u[side == 1].T
        score[src[:, None] == dst[None]] = -np.inf
        order = np.lexsort((np.broadcast_to(dst, score.shape), -np.round(score, 9)), axis=1)[:, :k]
        best = np.take_along_axis(score, order, 1)
        row, col = np.nonzero(np.isfinite(best))
        return pa.table({"src": src[row], "dst": dst[order[row, col]], "score": best[row, col]})

    kind = dict(rows.dtypes)["topic"]
    found = left.union(right).groupBy("i", "j").applyInArrow(product, f"src {kind}, dst {kind}, score double")
    return ranked(found.withColumn("__by", F.round("score", 9)), "__by", k).drop("__by")


def semantic(cents: DataFrame, k: int = PARAMS.panel_k) -> DataFrame:
    """Nearest centroids by cosine, which is also the weight of the map's edges; a zero centroid scores 0."""
    return nearest_by(cents.select("topic", X.unit("centroid").alias("u")), k)


def lexical(terms: DataFrame, k: int = PARAMS.panel_k) -> DataFrame:
    """Nearest by the Jaccard similarity of term sets, through an inverted index: only clusters that share a term meet.
    terms: (topic, terms). Pairs without a shared term score 0 and aren't given."""
    sets = terms.select("topic", F.array_distinct("terms").alias("terms"))
    long = sets.select("topic", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    other = long.select(F.col("topic").alias("dst"), F.col("n").alias("m"), "term")
    both = long.join(other, "term").where("topic <> dst").groupBy(F.col("topic").alias("src"), "dst").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    return ranked(both.select("src", "dst", (F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("score")), "score", k)


def aligned(series: DataFrame, key: str = "topic") -> DataFrame:
    """(key, y): each series by date, nulls as 0, leading zeros off, padded by zeros to the longest."""
    packed = series.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("day", F.coalesce("y", F.lit(0.0)).alias("y")))), lambda s: s["y"]).alias("y"))
    first = F.array_position(F.transform("y", lambda v: v != 0), True)
    packed = packed.select(key, F.when(first > 0, F.slice("y", first.cast("int"), F.size("y"))).otherwise(F.array().cast("array<double>")).alias("y"))
    longest = packed.agg(F.max(F.size("y")).alias("longest"))
    return packed.crossJoin(F.broadcast(longest)).select(key, F.concat("y", F.array_repeat(F.lit(0.0), F.col("longest") - F.size("y"))).alias("y"))


def morphological(series: DataFrame, k: int = PARAMS.panel_k) -> DataFrame:
    """Nearest by Pearson's correlation of the aligned curves; a flat curve scores 0."""
    rows = aligned(series)
    mean = F.aggregate("y", F.lit(0.0), lambda s, v: s + v) / F.size("y")
    centred = X.bound(mean, lambda m: F.transform("y", lambda v: v - m))
    rows = rows.select("topic", X.bound(centred, X.unit).alias("u"))
    return nearest_by(rows, k)


def assign_codes(cents: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Each cluster's nearest prototype, the runner-up, the gap between them, and whether the code is in scope.
    prototypes: (code, vector), one a code of the taxonomy: a fixed number of rows."""
    scored = cents.crossJoin(F.broadcast(prototypes)).select("topic", "code", X.cosine("centroid", "vector").alias("similarity"))
    best = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("similarity"), "code"))
    two = scored.withColumn("r", best).where("r <= 2").groupBy("topic").agg(
        F.max(F.when(F.col("r") == 1, F.col("code"))).alias("primary_code"),
        F.max(F.when(F.col("r") == 1, F.col("similarity"))).alias("similarity"),
        F.max(F.when(F.col("r") == 2, F.col("code"))).alias("runner_up"),
        F.max(F.when(F.col("r") == 2, F.col("similarity"))).alias("s2"),
    )
    return two.select("topic", "primary_code", "similarity", "runner_up", (F.col("similarity") - F.col("s2")).alias("runner_up_gap"), F.substring("primary_code", 1, 1).isin(*SCOPE).alias("in_scope"))


def stance(rows: DataFrame, pole_a: Column, pole_b: Column, width: int, vector: str = "embedding") -> DataFrame:
    """rows with their place on the axis from the mean of pole a to that of pole b, less the corpus's mean place."""
    poles = rows.agg(*(F.array(*(F.avg(F.when(p, F.col(vector)[i].cast("double"))) for i in range(width))).alias(n) for n, p in (("a", pole_a), ("b", pole_b))))
    axis = poles.select(X.unit(F.zip_with("b", "a", lambda x, y: x - y)).alias("axis"))
    placed = rows.crossJoin(F.broadcast(axis)).withColumn("raw", X.dot(vector, "axis"))
    return placed.crossJoin(F.broadcast(placed.agg(F.avg("raw").alias("__m")))).withColumn("stance", F.col("raw") - F.col("__m")).drop("axis", "raw", "__m")
