"""Near duplicates by MinHash bands with sequential Bayesian verification.

Rows with the same shingle set are one class, which its smallest id stands for. Classes that share a band
are candidates; their signatures are compared batch by batch and a pair is dropped once the posterior
probability that it is similar falls under the miss probability; survivors are compared on full sets.
No group is expanded into all its pairs: first each member meets its bucket's ends; after components are
known, only members of different components are compared, in blocks of a bucket, and of the pairs that pass
the test only a spanning forest leaves a block. In its groups, rows outside the largest component meet all
rows on full sets, block by block."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bipartite_groups, durable, star_components, text_slices
from .words import mix, shingles

BANDS, ROWS, BATCH = 32, 5, 32
_RNG = np.random.Generator(np.random.PCG64(5))
_A = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit values for each set that isn't empty."""
    sets = [s for s in sets if len(s)]
    out = np.zeros((len(sets), BANDS * ROWS), np.uint16)
    if sets:
        values, first = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        for i in range(BANDS * ROWS):
            low = np.minimum.reduceat(mix_fast(values, i), first)
            out[:, i] = (low * _A[i - 1] >> np.uint64(48)).astype(np.uint16)
    return out


def mix_fast(values: np.ndarray, i: int) -> np.ndarray:
    x = values * _A[i] + _B[i]
    return x ^ (x >> np.uint64(32))


@functools.cache
def least_matches(threshold: float, miss: float) -> list[int]:
    """Matches that a pair needs after each batch: with fewer, P(similarity >= threshold) < miss under a uniform prior."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total = 0.0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                out.append(m)
                break
    return out


def _survivors(batches, threshold: float, miss: float):
    need = least_matches(threshold, miss)
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for c in ("sig_a", "sig_b"))
        n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
        left = np.flatnonzero(np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9)
        matches = np.zeros(len(x), np.int64)
        for i, least in enumerate(need):
            cut = slice(i * BATCH, (i + 1) * BATCH)
            matches[left] += (x[left, cut] == y[left, cut]).sum(1)
            left = left[matches[left] >= least]
        yield batch.select(["a", "b"]).take(pa.array(left))


def _exact(batches, k: int, percent: int):
    for batch in batches:
        for lo, hi in text_slices(batch, "text_b"):
            part = batch.slice(lo, hi - lo)
            a, keep = part.column("a").to_pylist(), []
            own = sorted({x: i for i, x in enumerate(a)}.items())  # one text for each a
            left = dict(zip((x for x, _ in own), shingles(part.column("text_a").take(pa.array([i for _, i in own])), k), strict=True))
            for i, (x, right) in enumerate(zip(a, shingles(part.column("text_b"), k), strict=True)):
                both = len(np.intersect1d(left[x], right, assume_unique=True))
                if both and 100 * both >= percent * (len(left[x]) + len(right) - both):
                    keep.append(i)
            yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _sign(batches, k: int):
    for batch in batches:
        for lo, hi in text_slices(batch, "text"):
            part = batch.slice(lo, hi - lo)
            sets = shingles(part.column(1), k)
            sig = iter(signatures(sets))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "sig"],
            )


def _band_keys(sig: np.ndarray) -> np.ndarray:
    sig = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(sig.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) + sig[:, :, r])
    return key.view(np.int64)


def _bands(batches):
    for batch in batches:
        key = _band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2"))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(ids, BANDS))], names=["band", "rep"])


def _across(key: tuple, table: pa.Table, threshold: float, miss: float) -> pa.Table:
    """Of a bucket's two blocks (or one with itself): links that span the groups of its pairs of different components
    that pass the sequential test."""
    need = least_matches(threshold, miss)
    _, first, second = (k.as_py() for k in key)
    table = table.combine_chunks()
    rep, comp, n, slot = (table.column(c).to_numpy() for c in ("rep", "comp", "n", "slot"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, BANDS * ROWS)
    left, right = np.flatnonzero(slot == first), np.flatnonzero(slot == second)
    near = np.zeros((len(left), len(right)), bool)
    for at in range(0, len(left), 32):
        x = left[at : at + 32]
        smaller, larger = np.minimum(n[x][:, None], n[right][None]), np.maximum(n[x][:, None], n[right][None])
        i, j = np.nonzero((comp[x][:, None] != comp[right][None]) & (smaller >= threshold * larger - 1e-9))
        matches = np.zeros(len(i), np.int64)
        for b, least in enumerate(need):
            cut = slice(b * BATCH, (b + 1) * BATCH)
            matches += (sig[x[i], cut] == sig[right[j], cut]).sum(1)
            on = matches >= least
            i, j, matches = i[on], j[on], matches[on]
        near[at + i, j] = True
    return _forest(near, rep[left], rep[right])


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Table:
    if not near.any():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    rows, columns = bipartite_groups(near)
    i, j = np.flatnonzero(rows < len(left)), np.flatnonzero(columns < len(left))
    return pa.table({"a": np.concatenate([left[i], right[j]]), "b": np.concatenate([left[rows[i]], left[columns[j]]])})


def _exact_blocks(table: pa.Table, k: int, percent: int) -> pa.Table:
    """Rows with left = true against the others, on full sets: links that span the groups of different components."""
    table = table.combine_chunks()
    sets: list[np.ndarray] = []
    text = table.column("text").combine_chunks()
    batch = pa.RecordBatch.from_arrays([text], names=["text"])
    for lo, hi in text_slices(batch, "text"):
        sets += shingles(text.slice(lo, hi - lo), k)
    rep, comp, side = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "comp", "left"))
    order = np.argsort(~side, kind="stable")
    rep, comp, sets, n = rep[order], comp[order], [sets[i] for i in order], int(side.sum())
    size = np.array([len(s) for s in sets], np.int64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(sets)), size), count[column] > 1
    row, column = row[often], (np.cumsum(count > 1) - 1)[column[often]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    both = np.zeros((n, len(sets) - n), np.float64)
    width = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        own = slice(*np.searchsorted(column, [at, at + width]))
        has = np.zeros((len(sets), width), np.float32)
        has[row[own], column[own] - at] = 1
        both += has[:n] @ has[n:].T
    near = (both > 0) & (100 * both >= percent * (size[:n, None] + size[None, n:] - both)) & (comp[:n, None] != comp[None, n:])
    return _forest(near, rep[:n], rep[n:])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", miss: float = 1e-6, bucket_rows: int = 1024) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs: documents linked when 100 * intersection >=
    percent * union of their k-word shingle sets (a shorter text is one shingle). Texts that are null, empty or
    without words link with nothing. Buckets meet in blocks of about `bucket_rows`. Ids should be distinct and not null; rows that share an id share its group.
    An empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = durable(rows.mapInArrow(lambda b: _sign(b, k), "doc_id long, n_shingles long, digest binary, sig binary"), "signatures")
    classes = durable(signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    own = signed.select("doc_id", "digest", "n_shingles", "sig").join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    own = durable(own.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sig"), "class_signatures")
    bands = own.select("rep", "sig").mapInArrow(_bands, "band long, rep long")
    ends = bands.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    shared = durable(bands.join(ends, "band"), "buckets")
    texts = rows.join(shared.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = durable(texts, "candidate_texts")

    def exact(pairs: DataFrame) -> DataFrame:
        """Those pairs (a < b) that are links."""
        a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return durable(pairs.join(b, "b").join(a, "a").mapInArrow(lambda x: _exact(x, k, percent), "a long, b long"), "links")

    def ordered(x: str, y: str) -> DataFrame:
        return shared.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a < b")

    a = own.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    b = own.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    stars = ordered("low", "rep").union(ordered("high", "rep")).distinct()
    first = exact(stars.join(b, "b").join(a, "a").mapInArrow(lambda x: _survivors(x, percent / 100, miss), "a long, b long"))
    first = durable(star_components(first), "star_components")
    placed = shared.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    sizes = placed.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size"))
    placed = placed.join(sizes.where("c0 < c1 and size > 2").select("band", F.ceil(F.col("size") / bucket_rows).cast("int").alias("slots")), "band")
    placed = placed.withColumn("slot", F.pmod(F.xxhash64("rep"), F.col("slots")).cast("int")).join(own, "rep")

    def every(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    blocks = placed.withColumn("other", every(F.col("slots")))
    blocks = blocks.select("band", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "rep", "comp", "n", "sig", "slot")
    near = blocks.groupBy("band", "i", "j").applyInArrow(lambda key, t: _across(key, t, percent / 100, miss), "a long, b long")
    # Groups of near misses: the rows outside a group's largest component meet all its rows on full sets.
    groups = star_components(durable(near.distinct(), "near_links")).withColumnRenamed("component", "group")
    groups = groups.join(first, "node", "left").select(F.col("node").alias("doc_id"), "group", F.coalesce("component", "node").alias("comp"))
    counts = groups.groupBy("group", "comp").agg(F.count("*").alias("m"))
    counts = counts.groupBy("group").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("top"), F.count("*").alias("comps"))
    groups = groups.join(counts.where("comps > 1"), "group").join(texts, "doc_id")
    groups = groups.withColumn("few", F.ceil((F.col("all") - F.col("top")) / (bucket_rows // 2)).cast("int")).withColumn("many", F.ceil(F.col("all") / (bucket_rows // 2)).cast("int"))
    columns = ["group", "i", "j", F.col("doc_id").alias("rep"), "comp", "text"]
    left = groups.where("comp <> main").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("few")).cast("int")).withColumn("j", every(F.col("many")))
    right = groups.withColumn("j", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("many")).cast("int")).withColumn("i", every(F.col("few")))
    dealt = left.select(*columns, F.lit(True).alias("left")).union(right.select(*columns, F.lit(False).alias("left")))
    more = dealt.groupBy("group", "i", "j").applyInArrow(lambda t: _exact_blocks(t, k, percent), "a long, b long")
    more = durable(more, "more_links")
    as_first = first.select(F.col("node"), F.col("component"))
    for side in ("a", "b"):
        more = more.join(as_first.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    second = star_components(more.select("a", "b"))
    joined = classes.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    joined = joined.join(second.withColumnRenamed("node", "c"), "c", "left").select("digest", F.coalesce("component", "c").alias("group"))
    out = signed.select("doc_id", "n_shingles", "digest").join(joined, "digest", "left")
    group = F.coalesce("group", "doc_id")
    kept = F.coalesce(F.col("doc_id") == group, F.lit(True))
    return out.select("doc_id", "n_shingles", group.alias("component_id"), kept.alias("kept"))


def op6_bayes_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents over 2-word shingles. Null, empty and wordless texts have no shingles and stay; equal
    texts are one class, kept at its smallest id; an empty table gives no rows."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
