"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

A shard holds a bounded number of distinct vectors, whatever the table's size. Its graph starts as random
links; greedy searches for each vector propose neighbours and relaxed distance pruning keeps diverse
ones; what the start then doesn't reach is linked to its nearest node that it does. Queries are dealt to
every shard, stream past its graph and beam-search it. The whole beam is ranked by exact cosine in the
shard, so that only k rows a query and shard leave it. Equal vectors are one row that carries its
smallest ids, parallel ones are one node."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEGREE, BEAM, BUILD_BEAM, RELAX, BLOCK = 32, 128, 48, 1.5, 256


def usable(column: str) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & whole & F.exists(column, lambda x: x != 0), F.lit(False))


def own_kind(table: DataFrame, vector: str) -> str:
    """The SQL type that holds the column's values as they are: float stays, all else becomes double."""
    return "array<float>" if dict(table.dtypes)[vector] == "array<float>" else "array<double>"


def dimension(table: DataFrame, key: str, vector: str) -> int:
    """The length of the usable vector with the smallest id; vectors of other lengths can't be compared with it."""
    return table.where(usable(vector)).agg(F.min_by(F.size(vector), F.struct(F.col(key).cast("long"), F.size(vector)))).first()[0] or 0


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first, so that very large or small components don't overflow."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


class Graph:
    """links[i] holds i's neighbours (-1: none) over unit vectors; nearness is the dot product."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 1):
        self.vectors = vectors
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.start = int(np.argmax(self.vectors @ self.vectors.mean(0))) if n else 0
        self.links = np.full((n, degree), -1, np.int64)
        if n > 1:
            first = rng.integers(0, n - 1, (n, min(degree, n - 1)))
            self.links[:, : first.shape[1]] = first + (first >= np.arange(n)[:, None])
            for ease in (1.0, relax):
                order = rng.permutation(n)
                for at in range(0, n, BLOCK):
                    self._insert(order[at : at + BLOCK], beam, ease)
            self._reach_all(beam)

    def reached(self) -> np.ndarray:
        """Which nodes a walk from the start comes to."""
        seen = np.zeros(len(self.vectors), bool)
        edge = np.array([self.start])
        while len(edge):
            seen[edge] = True
            edge = np.unique(self.links[edge])
            edge = edge[edge >= 0]
            edge = edge[~seen[edge]]
        return seen

    def _reach_all(self, beam: int) -> None:
        """Links each node that isn't reached behind the nearest found one that is: two more places a node, the first for the
        head of such a chain, the second for the next in it."""
        lost = np.flatnonzero(~self.reached())
        if not len(lost):
            return
        home, near = (np.concatenate(x) for x in zip(*((found[:, 0], score[:, 0]) for found, score in (self.search(self.vectors[lost[at : at + BLOCK]], beam) for at in range(0, len(lost), BLOCK))), strict=True))
        more = np.full((len(self.vectors), 2), -1, np.int64)
        order = np.lexsort((-near, home))
        lost, home = lost[order], home[order]
        head = np.concatenate([[True], home[1:] != home[:-1]])
        more[home[head], 0] = lost[head]
        more[lost[:-1][~head[1:]], 1] = lost[1:][~head[1:]]
        self.links = np.concatenate([self.links, more], 1)

    def search(self, queries: np.ndarray, beam: int, visited: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search for many queries at once: ids (-1: none) and nearness, best first. With `visited`, all
        nodes seen on the way are kept too (unordered, after the beam)."""
        q, rows = len(queries), np.arange(len(queries))
        ids = np.full((q, beam), -1, np.int64)
        near = np.full((q, beam), -np.inf)
        done = np.ones((q, beam), bool)
        ids[:, 0], near[:, 0], done[:, 0] = self.start, queries @ self.vectors[self.start], False
        seen = np.zeros((q, len(self.vectors)), bool)
        seen[:, self.start] = True
        path = []
        active = rows
        while len(active):
            pick = np.argmin(done[active], 1)  # the best one not yet expanded
            open_ = ~done[active, pick]
            active, pick = active[open_], pick[open_]
            if not len(active):
                break
            done[active, pick] = True
            if visited:
                at = np.full(q, -1, np.int64)
                at[active] = ids[active, pick]
                path.append(at)
            next_ = self.links[ids[active, pick]]
            fresh = (next_ >= 0) & ~seen[active[:, None], next_]
            who, where = np.nonzero(fresh)
            seen[active[who], next_[who, where]] = True
            gain = np.full(next_.shape, -np.inf)
            gain[who, where] = np.einsum("rd,rd->r", queries[active[who]], self.vectors[next_[who, where]])
            all_near = np.concatenate([near[active], gain], 1)
            all_ids = np.concatenate([ids[active], np.where(fresh, next_, -1)], 1)
            all_done = np.concatenate([done[active], ~fresh], 1)
            best = np.argsort(-all_near, 1, kind="stable")[:, :beam]
            near[active], ids[active], done[active] = (np.take_along_axis(x, best, 1) for x in (all_near, all_ids, all_done))
        if visited and path:
            ids = np.concatenate([ids, np.stack(path, 1)], 1)
        return ids, near

    def _insert(self, block: np.ndarray, beam: int, ease: float) -> None:
        found, _ = self.search(self.vectors[block], beam, visited=True)
        self.links[block] = self._prune(block, np.concatenate([found, self.links[block]], 1), ease)
        source = np.repeat(block, self.links.shape[1])
        target = self.links[block].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first = np.unique(target, return_index=True)
        counts = np.diff(np.append(first, len(target)))
        width = int(counts.max()) if len(counts) else 0
        back = np.full((len(nodes), width), -1, np.int64)
        back[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        both = np.concatenate([self.links[nodes], back], 1)
        for at in range(0, len(nodes), 4 * BLOCK):
            part = slice(at, at + 4 * BLOCK)
            self.links[nodes[part]] = self._prune(nodes[part], both[part], ease)

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray, ease: float) -> np.ndarray:
        """Of each row's candidates, nearest first, those that no kept one is nearer to by the factor `ease`."""
        degree = self.links.shape[1]
        candidates = np.sort(candidates, 1)
        again = np.concatenate([np.zeros((len(nodes), 1), bool), candidates[:, 1:] == candidates[:, :-1]], 1)
        gone = again | (candidates < 0) | (candidates == nodes[:, None])
        own = self.vectors[nodes]
        away = np.full(candidates.shape, np.inf)
        who, where = np.nonzero(~gone)
        away[who, where] = 2 - 2 * np.einsum("rd,rd->r", own[who], self.vectors[candidates[who, where]])
        order = np.argsort(away, 1, kind="stable")[:, : 2 * degree]
        candidates, away = np.take_along_axis(candidates, order, 1), np.sqrt(np.maximum(0, np.take_along_axis(away, order, 1)))
        out = np.full((len(nodes), degree), -1, np.int64)
        rows = np.arange(len(nodes))
        vectors = self.vectors[candidates]
        apart = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))))
        for slot in range(degree):
            pick = np.argmin(away, 1)
            good = np.isfinite(away[rows, pick])
            if not good.any():
                break
            kept = candidates[rows, pick]
            out[good, slot] = kept[good]
            away[(ease * apart[rows, pick] < away) | ~good[:, None]] = np.inf
            away[rows, pick] = np.inf
        return out


def exact_cosines(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The cosine of x with each row, all sums left to right."""

    def dot(a, b):
        return np.add.accumulate(a * b, axis=1)[:, -1]

    return dot(x[None], rows) / (np.sqrt(dot(x[None], x[None])) * np.sqrt(dot(rows, rows)))


class Shard:
    """The vectors of a shard, a graph of their directions, and the ids of each."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        self.ids = table.column("ids").to_pylist()
        self.vectors = matrix(table.column("vector").combine_chunks())
        directions = unit(self.vectors)
        # Parallel vectors are one node.
        _, first, node = np.unique(np.round(directions, 10), axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)  # nodes by their first row, as the rows came
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        self.graph = Graph(directions[first[order]])
        node = place[node.ravel()]
        by = np.argsort(node, kind="stable")
        cut = np.searchsorted(node[by], np.arange(len(first) + 1))
        self.members = [by[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def nearest(self, ids: np.ndarray, vectors: np.ndarray, k: int, beam: int):
        """(query, id, cosine): the k best rows of each query's beam by exact cosine, ties to the smaller id, without its own."""
        found, _ = self.graph.search(unit(vectors), max(beam, k + 1))
        for own, vector, nodes in zip(ids.tolist(), vectors, found, strict=True):
            rows = np.concatenate([self.members[i] for i in nodes[nodes >= 0].tolist()])
            score = exact_cosines(vector, self.vectors[rows])
            best = []
            for i in self._top(score, k + 1):
                best += [(-score[i], x) for x in self.ids[rows[i]] if x != own]
            for s, x in sorted(best)[:k]:
                yield own, x, -s

    @staticmethod
    def _top(score: np.ndarray, k: int) -> list[int]:
        """Places of the k largest scores and of all that tie with the last."""
        least = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
        return np.flatnonzero(score >= least).tolist()


def _search_shards(batches, k: int, beam: int):
    """Rows sorted by shard, then vectors before queries: builds a shard's graph, then streams its queries past it."""
    shard, held, own = None, [], None
    names = ["query_id", "vec_id", "score"]
    for batch in batches:
        shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero(np.diff(shards) | np.diff(kinds)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(shards)], strict=True):
            if a == b:
                continue
            if shards[a] != shard:
                shard, held, own = shards[a], [], None
            part = batch.slice(a, b - a)
            if kinds[a] == 0:
                held.append(part)
                continue
            if own is None and held:
                own, held = Shard(held), []
            if own is None:
                continue
            ids, vectors = part.column("id").to_numpy(), matrix(part.column("vector"))
            for at in range(0, len(ids), BLOCK):
                rows = list(own.nearest(ids[at : at + BLOCK], vectors[at : at + BLOCK], k, beam))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=names)


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 8192, beam: int = BEAM) -> DataFrame:
    """For each row of `queries` the k nearest rows of `table` found, without its own id: query_id, rank, vec_id, score
    (cosine). Ties go to the smaller id; where fewer than k others are, all are given. Vectors that are null, zero,
    hold null or non-finite components, or differ in length from the usable one with the smallest id take no
    part on either side, nor do null ids. Rows that share an id and a vector count once. An empty table gives no
    rows; other columns are ignored."""
    kind, length = own_kind(table, vector), dimension(table, key, vector)

    def good(df: DataFrame) -> DataFrame:
        df = df.where(usable(vector) & (F.size(vector) == length))
        return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector")).where("id is not null")

    rows = good(table).withColumn("hash", F.xxhash64("vector"))
    # Equal vectors keep their k + 1 smallest ids; that many rows of a group survive before the shuffle.
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("hash", "vector").orderBy("id"))).where(F.col("r") <= k + 1)
    nodes = ranked.groupBy("hash", "vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    shards = max(1, -(-table.count() // shard_rows))
    side = nodes.select(F.pmod("hash", F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("ids")[0].alias("id"), "ids", "vector")
    asked = good(queries).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", F.array().cast("array<long>").alias("ids"), "vector")
    dealt = side.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "id")
    found = dealt.mapInArrow(lambda b: _search_shards(b, k, beam), "query_id long, vec_id long, score double")
    # An id may stand on several vectors: its best counts.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_pruned_graph(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector. Null, zero and unusable vectors ask nothing and answer nothing; repeated rows
    count once, equal vectors of different ids each; ties go to the smaller id; an empty table gives no rows."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, table.where("vec_id % 50 = 0"))
