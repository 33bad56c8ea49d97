"""A clustering in Spark: nearest seeds refined by means, small clusters as noise; and a plane for maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PARAMS
from .similar import centroids

#: Rows of the sample that seeds are drawn from, by hash order.
SEED_ROWS = 4096


def _nearest(rows: DataFrame, seeds: np.ndarray, vector: str) -> DataFrame:
    """rows with topic: the seed with the largest dot product. Seeds are a fixed number, so they travel with the plan."""
    units = seeds / np.maximum(np.linalg.norm(seeds, axis=1, keepdims=True), 1e-12)

    def run(frames):
        for frame in frames:
            x = np.stack(frame[vector].to_numpy()).astype(float) if len(frame) else np.zeros((0, units.shape[1]))
            yield frame.assign(topic=(x @ units.T).argmax(1).astype("int32") if len(frame) else 0)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, topic int")


def cluster(rows: DataFrame, k: int, least: int = 10, rounds: int = 5, seed: int = PARAMS.seed, vector: str = "embedding") -> DataFrame:
    """rows (chunk_id, vector) with topic from 0 by size, -1 where a cluster has fewer than `least` rows. Seeds are far points
    of a bounded sample; rounds of means run over all rows and bring k means to the driver."""
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "chunk_id"), "chunk_id").limit(SEED_ROWS).select(vector).collect()
    x = np.array([r[0] for r in sample], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    chosen = [0]
    far = 1 - x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    seeds, width = x[chosen], x.shape[1]
    for _ in range(rounds):
        means = centroids(_nearest(rows, seeds, vector), width, vector=vector).collect()
        for r in means:
            seeds[r.topic] = r.centroid
    placed = _nearest(rows, seeds, vector)
    sizes = sorted(((-r["count"], r.topic) for r in placed.groupBy("topic").count().collect()))
    names = {t: (i if -n >= least else -1) for i, (n, t) in enumerate(sizes)}
    rename = F.create_map(*(F.lit(v) for t, i in names.items() for v in (t, i)))
    return placed.withColumn("topic", F.element_at(rename, F.col("topic")).cast("int"))


def layout(cents: DataFrame, dims: int = 3) -> DataFrame:
    """(topic, place array): centroids on their principal directions; three clusters or fewer lie on a line. Centroids are as
    many as clusters, and come to the driver."""
    spark, got = cents.sparkSession, sorted((r.topic, r.centroid) for r in cents.select("topic", "centroid").collect())
    ids, x = [t for t, _ in got], np.array([c for _, c in got], float)
    if len(ids) <= 3:
        places = [[float(i)] + [0.0] * (dims - 1) for i in range(len(ids))]
    else:
        x = x - x.mean(0)
        v = np.linalg.svd(x, full_matrices=False)[2][:dims]
        v *= np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
        places = (x @ v.T).tolist()
    return spark.createDataFrame(list(zip(ids, places, strict=True)), "topic int, place array<double>")


def stability(rows: DataFrame, k: int, seeds: tuple[int, ...]) -> DataFrame:
    """(seed, nmi, ari) of clusterings with other seeds against the first one's."""
    from .qa import agreement

    base = cluster(rows, k, seed=seeds[0]).select("chunk_id", F.col("topic").alias("a"))
    out = None
    for s in seeds[1:]:
        pairs = base.join(cluster(rows, k, seed=s).select("chunk_id", F.col("topic").alias("b")), "chunk_id")
        one = agreement(pairs, "a", "b").select(F.lit(s).alias("seed"), "nmi", "ari")
        out = one if out is None else out.unionAll(one)
    return out


def two_modes(values: DataFrame, value: str) -> DataFrame:
    """One row: Sarle's coefficient of bimodality (over 5/9 suggests two modes), with the moments it's made of."""
    m = values.agg(F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"), F.count(value).alias("n"))
    n = F.col("n")
    scale = 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    return m.select("n", "skewness", "kurtosis", ((F.col("skewness") ** 2 + 1) / (F.col("kurtosis") + scale)).alias("bimodality"))


def encode(rows: DataFrame, text: str = "text", width: int = 64, seed: int = PARAMS.seed) -> DataFrame:
    """rows with embedding: signed counts of hashed character 3- to 5-grams, unit length: a stand-in where no model is."""
    import zlib

    def run(frames):
        for frame in frames:
            out = []
            for t in frame[text].fillna(""):
                v = np.zeros(width)
                low = f" {t.lower()} "
                for n in (3, 4, 5):
                    for i in range(len(low) - n + 1):
                        h = zlib.crc32(low[i : i + n].encode(), seed)
                        v[h % width] += 1 if h >> 16 & 1 else -1
                norm = np.linalg.norm(v)
                out.append((v / norm if norm else v).astype("float32"))
            yield frame.assign(embedding=out)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, embedding array<float>")


