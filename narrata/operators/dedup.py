"""Near-duplicate removal that keeps the first: bands of MinHash over character 5-grams propose, and an article goes only
if an earlier one that stays shares a band with it."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schema import PARAMS
from ..sources.shared import written

BANDS, ROWS = 8, 16


def flat_text(title, body):
    """Lower case, single spaces, bare ends."""
    return F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", title, body)), X.SPACES, " "))


def _hashed(rows: DataFrame, seed: int = PARAMS.seed) -> DataFrame:
    """rows' columns but the text, and keys (one a band) of each text of five characters or more."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    b = rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
    rest = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*(rows.schema[c] for c in rest), T.StructField("keys", T.ArrayType(T.LongType()))])

    def keyed(kept, at, grams):
        values, first = np.concatenate(grams), np.cumsum([0, *map(len, grams[:-1])])
        low, held = np.empty((BANDS * ROWS, len(grams)), np.uint32), np.empty_like(values)  # modulo 2**32
        for i in range(BANDS * ROWS):
            np.multiply(values, a[i], out=held)
            np.add(held, b[i], out=held)
            np.minimum.reduceat(held, first, out=low[i])
        digests = b"".join(hashlib.blake2b(row, digest_size=8).digest() for row in np.ascontiguousarray(low.T).astype(np.uint64).reshape(-1, ROWS))
        keys = pa.ListArray.from_arrays(np.arange(0, BANDS * len(at) + 1, BANDS, dtype=np.int32), pa.array(np.frombuffer(digests, "<i8")))
        own = kept.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*own.columns, keys], names=[*rest, "keys"])

    def run(batches):
        step = np.array([1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint64)
        for batch in batches:
            kept = batch.select(rest)
            at, held, size = [], [], 0
            for i, text in enumerate(batch.column("text")):
                codes = np.frombuffer((text.as_py() or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
                if len(codes) < 5:
                    continue
                grams = sum(codes[k : len(codes) - 4 + k] * step[k] * step[(k + 1) % 5] for k in range(5))
                at.append(i)
                held.append(((grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32))
                size += len(held[-1])
                if size > 1 << 15:  # stays in the cache
                    yield keyed(kept, at, held)
                    at, held, size = [], [], 0
            if at:
                yield keyed(kept, at, held)

    return rows.select(*rest, "text").mapInArrow(run, schema)


def band_keys(rows: DataFrame, seed: int = PARAMS.seed) -> DataFrame:
    """(article_id, band, key) of each text of five characters or more."""
    return _hashed(rows.select("article_id", "text"), seed).select("article_id", F.posexplode("keys").alias("band", "key"))


def keep_first(articles: DataFrame, order: str = "day", window_days: int = 36500) -> DataFrame:
    """(article_id, is_duplicate, duplicate_of): articles in the order of (order, article_id); one that shares a band with
    an earlier one that stays, within the window, goes, as a duplicate of the earliest such. Rows of one id are one article; one
    without a date or an id stays and holds for none. Articles that buckets connect are gone through in order, in one stream
    each: it holds the last kept one of each bucket, those before lie outside the window. Articles of one date and the
    same buckets are one row of it, so copies add as many rows as there are dates."""
    rows = articles.select("article_id", F.col(order).alias("at"), flat_text(F.col("title"), F.col("body")).alias("text"))
    hashed = _hashed(rows.where("article_id is not null and at is not null")).withColumn("keys", F.transform("keys", lambda key, band: F.xxhash64(band, key)))
    whole = hashed.groupBy("article_id").agg(F.min("at").alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))
    nodes = written(whole.withColumn("class", F.xxhash64("keys")), "band_keys")
    points = written(nodes.join(_connected(nodes), "class").drop("class"), "connected")
    firsts = points.groupBy("group", "at", "keys").agg(F.min("article_id").alias("first"))
    in_order = firsts.withColumn("day", F.date_diff("at", F.lit("1970-01-01"))).repartition("group").sortWithinPartitions("group", "at", "first")
    columns = ["at", "keys", "first"]
    schema = T.StructType([*(firsts.schema[c] for c in columns), T.StructField("of", T.StringType())])

    def run(batches):
        group, place = None, 0
        last: dict[int, tuple[int, int, str]] = {}  # of a bucket: place, day and id of its last kept article
        for batch in batches:
            of = []
            for g, day, name, keys in zip(*(batch.column(c).to_pylist() for c in ("group", "day", "first", "keys")), strict=True):
                if g != group:
                    group, place, last = g, 0, {}
                near = min((k for key in keys if (k := last.get(key)) and day - k[1] <= window_days), default=None)
                of.append(near and near[2])
                if near is None:
                    last |= dict.fromkeys(keys, (place, day, name))
                place += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(of, pa.string())], names=[*columns, "of"])

    verdict = in_order.mapInArrow(run, schema)
    of = F.when(F.col("article_id") == F.col("first"), F.col("of")).otherwise(F.coalesce("of", "first"))
    gone = points.join(verdict, ["at", "keys"]).select("article_id", of.alias("of")).where("of is not null")
    return articles.select("article_id").join(gone, "article_id", "left").select("article_id", F.col("of").isNotNull().alias("is_duplicate"), F.col("of").alias("duplicate_of"))


def _connected(nodes: DataFrame) -> DataFrame:
    """(class, group) of the classes of nodes (class, keys) that share a key with another node: groups are what keys connect.
    A round takes each class to the smallest group of its keys' classes, and on to that one's group."""
    links = nodes.select("class", F.explode("keys").alias("key")).groupBy("class", "key").agg(F.count("*").alias("n"))
    shared = links.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    links = written(links.join(shared, "key", "left_semi").select("class", "key"), "links")
    groups, at = links.withColumn("group", F.col("class")), None
    while True:
        low = links.join(groups.groupBy("key").agg(F.min("group").alias("group")), "key").groupBy("class").agg(F.min("group").alias("group"))
        old = low.withColumn("was", F.col("class")) if at is None else low.join(at.select("class", F.col("group").alias("was")), "class")
        on = low.select(F.col("class").alias("group"), F.col("group").alias("on"))
        at = written(old.join(on, "group").select("class", F.least("group", "on").alias("group"), "was"), "groups")
        if at.where("group <> was").isEmpty():
            return at.select("class", "group")
        groups = links.join(at, "class")


def exact(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, first, n): texts that occur more than once, and their smallest id."""
    return rows.groupBy(F.sha1(text).alias("digest")).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")


def exact_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity, docs_a, docs_b) of sets (id, w: distinct words): pairs with a Jaccard similarity of at least the
    threshold, between the smallest ids of equal sets, with how many rows each stands for. Only each set's rarest words
    lead to candidates (as many as a similar set can't all miss), so frequent words pair nothing; full sets decide."""
    classes = sets.where(F.size("w") > 0).groupBy("w").agg(F.min("id").alias("id"), F.count("*").alias("n_docs"))
    df = classes.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    long = classes.select("id", F.explode("w").alias("word")).join(df, "word")
    ordered = long.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("rare"))
    head = (F.size("rare") - F.ceil(F.size("rare") * F.lit(threshold) - 1e-9) + 1).cast("int")
    keys = ordered.select("id", F.size("rare").alias("n"), F.explode(F.slice("rare", 1, head)).alias("word"))
    other = keys.select(F.col("id").alias("b"), F.col("n").alias("m"), "word")
    likely = keys.join(other, "word").where((F.col("id") < F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-9))
    likely = likely.select(F.col("id").alias("a"), "b").distinct()
    x = classes.select(F.col("id").alias("a"), F.col("w").alias("wa"), F.col("n_docs").alias("docs_a"))
    y = classes.select(F.col("id").alias("b"), F.col("w").alias("wb"), F.col("n_docs").alias("docs_b"))
    both = likely.join(x, "a").join(y, "b").withColumn("c", F.size(F.array_intersect("wa", "wb")))
    score = F.col("c") / (F.size("wa") + F.size("wb") - F.col("c"))
    return both.where(score >= threshold).select("a", "b", F.round(score, 6).alias("similarity"), "docs_a", "docs_b")
