"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

Only the histogram (a number for each length up to the limit) reaches the driver. Lengths are placed
longest first into the pattern with the least in it, whole counts at a time; pieces find their place in
the patterns by their rank among the pieces of their length."""

from __future__ import annotations

import functools
import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import encoder
from .common import durable

#: Texts of other characters, or with a special token's string, go to the tokenizers library itself.
OTHER = re.compile("[^\x00-\u024f]")


@functools.cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(texts: list[str], path: str, rank_path: str | None, pattern: str | None) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers, as the tokenizers library gives them. With the same
    vocabulary as ranks, common characters are encoded by ranks: the same ids, several times as fast."""
    own = encoder(rank_path, pattern) if rank_path else None
    special = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    out = []
    for text in texts:
        if own is None or (not text.isascii() and OTHER.search(text)) or any(t in text for t in special):
            found = tokenizer(path).encode(text, add_special_tokens=False).ids
        else:
            found = own.encode_ordinary(text)
        out.append(np.array(found, "<u4").tobytes())
    return out


def pieces(docs: DataFrame, path: str, rank_path: str | None = None, pattern: str | None = None, limit: int = 1024, end: int = 0, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Documents as token ids with `end` behind each, cut after every `limit` ids: doc_id, start, length, ids_crc32,
    doc_tokens (and ids, if asked for). A null text counts as empty; a row of docs gives at least one piece."""
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), 256):
                out = []
                for k, raw in zip(keys[at : at + 256], token_ids([x or "" for x in texts[at : at + 256]], path, rank_path, pattern), strict=True):
                    raw += last
                    for start in range(0, len(raw), 4 * limit):
                        part = raw[start : start + 4 * limit]
                        out.append((k, start // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4, part))
                columns = [pa.array(x) for x in zip(*out, strict=True)]
                columns[0] = columns[0].cast(pa.int64())
                yield pa.RecordBatch.from_arrays(columns[: 5 + ids], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + ids])

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, kind)


def patterns(histogram: dict[int, int], limit: int) -> list[tuple[int, list[int]]]:
    """(count, lengths): how many sequences hold just these lengths, in this order. Longest first; each goes to the
    pattern with the least in it, and where it doesn't fit there, it fits nowhere and opens new sequences."""
    open_: list[tuple[int, int, int, list[int]]] = []  # filled, number (ties to the older), count, lengths
    number = 0
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        if not 0 < length <= limit:
            raise ValueError("lengths must be from 1 to the limit")
        while n:
            if open_ and open_[0][0] + length <= limit:
                filled, _, count, held = heapq.heappop(open_)
                take = min(n, count)
                if take < count:
                    heapq.heappush(open_, (filled, number, count - take, held))
                    number += 1
                heapq.heappush(open_, (filled + length, number, take, [*held, length]))
                number, n = number + 1, n - take
            else:
                each = limit // length
                for count, held in ((n // each, each), (1, n % each)):
                    if count and held:
                        heapq.heappush(open_, (held * length, number, count, [length] * held))
                        number += 1
                n = 0
    return [(count, held) for _, _, count, held in sorted(open_)]


def places(found: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for count, held in found:
        offset = 0
        for length in held:
            rank = used.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(table: DataFrame, limit: int = 1024, spread: int | None = None) -> DataFrame:
    """table (pieces, with a column length and doc_id, start to order them) with sequence_id and offset.

    Ranks within a length are counted over `spread` buckets (as many as shuffle partitions, 64 at least), so a length
    that a third of the pieces have doesn't land in one task. The buckets' counts stay a table; the driver sees the
    histogram, `limit` numbers at most, whatever the input. Equal pieces get places of their own, in any order among
    them; an empty table gives no rows; other columns are carried along."""
    spread = spread or max(64, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = table.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(spread)).cast("int"))
    counts = durable(salted.groupBy("length", "__salt").agg(F.count("*").alias("__n")), "length_counts")  # limit x spread rows at most
    where = places(patterns(dict(tuple(r) for r in counts.groupBy("length").agg(F.sum("__n")).collect()), limit))
    before = F.sum("__n").over(W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1))
    first = counts.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__first"))
    ranked = salted.withColumn("__row", F.row_number().over(W.partitionBy("length", "__salt").orderBy("doc_id", "start")) - 1)
    ranked = ranked.join(first, ["length", "__salt"]).select(*table.columns, (F.col("__first") + F.col("__row")).alias("__rank"))
    names = [*table.columns]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own, plan = length == k, where[int(k)]
                at = np.searchsorted(plan[:, 0], rank[own], side="right") - 1
                sequence[own] = plan[at, 1] + rank[own] - plan[at, 0]
                offset[own] = plan[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in table.dtypes)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, limit: int = 1024) -> DataFrame:
    """Pieces of all documents with their places. Pieces (without ids) are written once, as they are read twice. A null text
    counts as empty, and an empty one is a piece of its end alone; repeated rows and null ids give pieces of their own;
    an empty table gives no rows."""
    import public_tokenizers as P

    found = pieces(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, limit)
    return pack(durable(found, "pieces"), limit)


def op3_histogram_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens. Null and empty texts are one token; repeated rows are packed each; an empty
    table gives no rows."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
