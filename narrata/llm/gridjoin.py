"""Embedding near-dedup by an epsilon grid order join.

Distinct unit vectors are sorted by their grid cells (as wide as the link distance) on the leading principal
directions, which a bounded sample fits; they steer the search only and lose no link. The sequence is cut
into parts of bounded size. Intervals of parts are joined recursively, as tables: pairs of intervals whose
boxes are near are replaced by the pairs of their sixteenths, down to single parts. Within a pair of parts,
intervals of the sequence are halved and skipped by their boxes until they are small enough to compare. A
comparison gives counts and a spanning forest, never its pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bipartite_groups, durable, star_components
from .graph import dimension, matrix, own_kind, unit, usable

SAMPLE, DIRECTIONS, CELLS, SMALL, FAN = 4096, 16, 6, 256, 16


def directions(vectors: np.ndarray, n: int) -> np.ndarray:
    """The n leading principal directions (columns, orthonormal)."""
    return np.linalg.svd(vectors - vectors.mean(0), full_matrices=False)[2][:n].T


class _Sets:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def join_parts(x: np.ndarray, y: np.ndarray | None, weight_x: np.ndarray, weight_y: np.ndarray, basis: np.ndarray, least: float):
    """Of the sequences x and y (None: x with itself), unit vectors: the weights linked to each row, and links that
    span the linked rows' groups (rows of y counted after x)."""
    same = y is None
    y, weight_y = (x, weight_x) if same else (y, weight_y)
    n = len(x)
    far = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    at_x = x @ basis
    at_y = at_x if same else y @ basis
    count_x, count_y = np.zeros(n, np.int64), np.zeros(len(y), np.int64)
    sets = _Sets(n + (0 if same else len(y)))
    boxes: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(side: int, a: int, b: int):
        if (side, a, b) not in boxes:
            part = (at_y if side else at_x)[a:b]
            boxes[side, a, b] = part.min(0), part.max(0)
        return boxes[side, a, b]

    stack = [(0, n, 0, len(y))] if n and len(y) else []
    while stack:
        a, b, c, d = stack.pop()
        if same and c < a:
            continue
        (lo_x, hi_x), (lo_y, hi_y) = box(0, a, b), box(0 if same else 1, c, d)
        gap = np.maximum(0, np.maximum(lo_x - hi_y, lo_y - hi_x))
        if gap @ gap > far * far:
            continue
        if b - a > SMALL or d - c > SMALL:
            halves_x = [(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > SMALL else [(a, b)]
            halves_y = [(c, (c + d) // 2), ((c + d) // 2, d)] if d - c > SMALL else [(c, d)]
            stack += [(*p, *q) for p in halves_x for q in halves_y]
            continue
        near = x[a:b] @ y[c:d].T
        mask = near >= least
        for i, j in np.argwhere(np.abs(near - least) < 1e-12):  # rounding decides: sum the products exactly
            mask[i, j] = math.fsum(x[a + i] * y[c + j]) >= least
        if same and a == c:
            np.fill_diagonal(mask, False)
        if not mask.any():
            continue
        count_x[a:b] += mask @ weight_y[c:d]
        if not (same and a == c):
            count_y[c:d] += weight_x[a:b] @ mask
        rows, columns = bipartite_groups(mask)
        for i in np.flatnonzero(rows < len(rows)):
            sets.join(a + int(i), a + int(rows[i]))
        for j in np.flatnonzero(columns < len(rows)):
            sets.join((0 if same else n) + c + int(j), a + int(columns[j]))
    counts = count_x + count_y if same else np.concatenate([count_x, count_y])
    roots = np.array([sets.root(i) for i in range(len(sets.up))], np.int64)
    return counts, roots


def _join_pair(table: pa.Table, basis: np.ndarray, least: float) -> pa.Table:
    table = table.sort_by([("side", "ascending"), ("place", "ascending")]).combine_chunks()
    side, rep, weight = (table.column(c).to_numpy() for c in ("side", "rep", "n"))
    vectors = unit(matrix(table.column("vector").combine_chunks()))
    n = int((side == 0).sum())
    y = None if n == len(side) else vectors[n:]
    counts, roots = join_parts(vectors[:n], y, weight[:n], weight[n:], basis, least)
    on = np.flatnonzero(counts)
    return pa.table({"rep": pa.array(rep[on]), "links": pa.array(counts[on]), "root": pa.array(rep[roots[on]])})


def _near(width: float) -> Column:
    """Whether the boxes (low_a, high_a) and (low_b, high_b) come as near as `width`."""
    gaps = F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) <= (width + 1e-9) ** 2


def near_parts(boxes: DataFrame, width: float, size: int) -> DataFrame:
    """Pairs (a, b), a <= b, of parts whose boxes (part, low, high) are near. Intervals of FAN, FAN ** 2, ... parts come first;
    the pairs of each level are a table, whatever their number. `size`: components of a box."""
    levels, count = [boxes], int(boxes.agg(F.max("part")).first()[0] or 0) + 1
    while count > FAN:
        low, high = (F.array(*(f(F.col(c)[i]) for i in range(size))).alias(c) for f, c in ((F.min, "low"), (F.max, "high")))
        levels.append(durable(levels[-1].groupBy(F.floor(F.col("part") / FAN).alias("part")).agg(low, high), "boxes"))
        count = -(-count // FAN)

    def met(pairs: DataFrame, level: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(level.select(F.col("part").alias(side), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}")), side)
        return pairs.where(_near(width)).select("a", "b")

    pairs = met(levels[-1].select(F.col("part").alias("a"), F.explode(F.sequence("part", F.lit(count - 1).cast("long"))).alias("b")), levels[-1])
    for level in levels[-2::-1]:
        pairs = durable(pairs, "near_boxes")
        for side in ("a", "b"):
            pairs = pairs.withColumn(side, F.explode(F.sequence(F.col(side) * FAN, F.col(side) * FAN + FAN - 1)))
        pairs = met(pairs.where("a <= b"), level)
    return pairs


def near_vectors(table: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", part_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links are pairs with cosine >= least. Vectors that are null, zero,
    hold null or non-finite components, or differ in length from the usable one with the smallest id link with
    nothing. Rows with equal vectors link with each other. Ids should be distinct and not null. An empty table
    gives no rows; other columns are ignored."""
    spark = table.sparkSession
    element, length = own_kind(table, vector), dimension(table, key, vector)
    good = F.when(usable(vector) & (F.size(vector) == length), F.col(vector).cast(element))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), good.alias("vector")).withColumn("hash", F.xxhash64("vector"))
    classes = rows.where("vector is not null").groupBy("hash", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = durable(classes, "vector_classes")
    sample = np.array([r[0] for r in classes.orderBy("hash").limit(SAMPLE).select("vector").collect()], np.float64)
    if not len(sample):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    basis = directions(unit(sample), min(DIRECTIONS, sample.shape[1], max(1, len(sample) - 1)))
    width, used = math.sqrt(max(1e-6, 2 - 2 * least)), min(CELLS, basis.shape[1])

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                at = np.floor(unit(matrix(batch.column("vector"))) @ basis[:, :used] / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(at[:, i]) for i in range(used))], names=[*batch.schema.names, *(f"c{i}" for i in range(used))])

    order = [f"c{i}" for i in range(used)] + ["hash", "rep"]

    def number(batches):
        from pyspark import TaskContext

        piece, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rep", "n", "vector")] + [pa.array(np.full(n, piece, np.int32)), pa.array(np.arange(done, done + n))], names=["rep", "n", "vector", "piece", "row"])
            done += n

    kinds = f"rep long, n long, vector {element}"
    placed = classes.select("rep", "n", "vector", "hash").mapInArrow(cells, f"{kinds}, hash long, " + ", ".join(f"c{i} int" for i in range(used)))
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    placed = durable(placed.mapInArrow(number, f"{kinds}, piece int, row long"), "vector_sequence")
    starts, total = [], 0
    for piece, n in sorted(tuple(r) for r in placed.groupBy("piece").count().collect()):  # as many as shuffle partitions
        starts.append((piece, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(starts, "piece int, start long"))
    placed = placed.join(starts, "piece").select("rep", "n", "vector", (F.col("start") + F.col("row")).alias("place"))
    placed = placed.withColumn("part", F.floor(F.col("place") / part_rows))

    def bounds(batches):
        for batch in batches:
            if batch.num_rows:
                parts, at = batch.column(0).to_numpy(), unit(matrix(batch.column(1))) @ basis
                own = [(p, at[parts == p]) for p in np.unique(parts).tolist()]
                box = [pa.array([f(x, 0).tolist() for _, x in own], pa.list_(pa.float64())) for f in (np.min, np.max)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.int64()), *box], names=["part", "low", "high"])

    spread = range(basis.shape[1])
    boxes = placed.select("part", "vector").mapInArrow(bounds, "part long, low array<double>, high array<double>")
    boxes = boxes.groupBy("part").agg(F.array(*(F.min(F.col("low")[i]) for i in spread)).alias("low"), F.array(*(F.max(F.col("high")[i]) for i in spread)).alias("high"))
    meet = durable(near_parts(durable(boxes, "boxes"), width, basis.shape[1]), "near_parts")
    sides = meet.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("part")).union(meet.where("a < b").select("a", "b", F.lit(1), "b"))
    dealt = placed.join(sides, "part").select("a", "b", "side", "place", "rep", "n", "vector")
    found = dealt.groupBy("a", "b").applyInArrow(lambda t: _join_pair(t, basis, least), "rep long, links long, root long")
    found = durable(found, "vector_links")
    groups = star_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("hash", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(known, ["hash", "vector"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op4_grid_order_join(spark, sf_dir: str) -> DataFrame:
    """All vectors with cosine 0.9 or more, whatever their labels. Null, zero and unusable vectors give rows without links;
    equal vectors link; a component goes by its smallest id; an empty table gives no rows."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
