"""Byte-level BPE over a corpus: a global distinct-word shuffle.

Texts are cut into pre-tokens, the matches of the pattern. A block of documents keeps its distinct pre-tokens
once, and each document as positions into them. Pre-tokens are dealt by hash to ranges, so that each
distinct one meets its copies in one range, which a task works off alone, and is encoded once; its ids go back
to the blocks, which reassemble documents by position. They travel packed, so rows shuffled are blocks x
ranges and not tokens. Blocks and ranges are of bounded size, whatever the input's. Decoding looks ids up in the
token-byte table (of the vocabulary's size, which is fixed)."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import of_kind, ranges

#: Bytes of input for a range of pre-tokens.
RANGE_BYTES = 64 << 20
#: Two libraries may disagree on the class of these characters (white space of one only; newer than 2021), or have no pair
#: of bytes for them; a text with one is a single pre-token here, which the encoder cuts itself.
ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff\u0870-\u0889\u0c5d\u0cdd\u0cf3\u1c89\u1c8a\u2c2f\u2c5f\ua7c0-\ua7dc\U00010570-\U000105bc\U00011200-\U00011fff\U00012f90-\U00012ff2\U00013430-\U00013455\U0001a000-\U0001efff\U0002b739-\U0002ffff\U00031350-\U000323af\U000e0000-\U0010ffff]")


@functools.cache
def _matcher(pattern: str):
    import regex

    return regex.compile(pattern)


def pretokens(text: str, pattern: str) -> list[str]:
    """The matches of the pattern, which joined give the text again; a text that it doesn't cover, or an odd one, whole."""
    if not text:
        return []
    if not text.isascii() and ODD.search(text):
        return [text]
    found = _matcher(pattern).findall(text)
    return found if sum(map(len, found)) == len(text) else [text]


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    table = ranks(path)
    out = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        out[i] = token
    return out


def pack_numbers(x: np.ndarray) -> bytes:
    """Non-negative numbers under 2**28 as 7-bit groups."""
    x = x.astype(np.uint32)
    groups = np.stack([(x >> np.uint32(7 * i)) & np.uint32(127) for i in range(4)], 1).astype(np.uint8)
    more = np.stack([x >= 1 << 7 * i for i in range(1, 4)], 1)
    groups[:, :3] |= more.astype(np.uint8) << 7
    return groups[np.concatenate([np.ones((len(x), 1), bool), more], 1)].tobytes()


def unpack_numbers(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8)
    if not len(x):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(x < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(x)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((x & 127).astype(np.int64) << (7 * place), first)


def pack_strings(items: list[bytes]) -> bytes:
    return zlib.compress(pack_numbers(np.array([len(items), *map(len, items)])) + b"".join(items), 1)


def unpack_strings(raw: bytes) -> list[bytes]:
    raw = zlib.decompress(raw)
    n = at = 0
    while True:  # the count, as pack_numbers wrote it
        n |= (raw[at] & 127) << 7 * at
        at += 1
        if raw[at - 1] < 128:
            break
    x = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(x[at : at + 4 * n] < 128)[:n]
    stop = at + (int(ends[-1]) + 1 if n else 0)
    cuts = np.concatenate([[0], np.cumsum(unpack_numbers(raw[at:stop]))]) + stop
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_ROWS = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("payload", pa.binary())])
_SQL = "key long, kind int, a long, b long, payload binary"


def _blocks(batches, pattern: str, ranges: int, block_bytes: int):
    """kind 0: a document: key is its block, a its id, b 1 if the id is null, payload its positions; kind 1: the pre-tokens
    of a block in one range: key is the range, a the block, payload positions and pre-tokens."""
    from pyspark import TaskContext

    block, size, codes, rows = TaskContext.get().partitionId() << 24, 0, defaultdict(), []
    codes.default_factory = codes.__len__

    def flush():
        dealt = defaultdict(lambda: ([], []))
        for word, code in codes.items():
            raw = word.encode()
            at, own = dealt[zlib.crc32(raw) % ranges]
            at.append(code)
            own.append(raw)
        for r, (at, own) in dealt.items():
            rows.append((-1 - r, 1, block, len(own), pack_strings([pack_numbers(np.diff(np.array(at), prepend=0)), *own])))
        out = pa.RecordBatch.from_pylist([dict(zip(_ROWS.names, x, strict=True)) for x in rows], _ROWS)
        rows.clear()
        codes.clear()
        return out

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            found = np.fromiter(map(codes.__getitem__, pretokens(text, pattern)), np.int64)
            rows.append((block, 0, 0 if key is None else key, int(key is None), pack_numbers(found)))
            size += len(text)
            if size >= block_bytes:
                yield flush()
                block, size = block + 1, 0
    if rows:
        yield flush()


def _encode_words(batches, path: str, pattern: str):
    """Of the rows of _blocks, sorted by key, those of pre-tokens: key becomes the block, payload holds positions and ids. Each
    distinct one of a range is encoded once; what is known is dropped at the range's end."""
    own = encoder(path, pattern)
    known: dict[bytes, bytes] = {}
    now = None
    for batch in batches:
        out = []
        for key, kind, block, payload in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if kind != 1:
                continue
            if key != now:
                known.clear()
                now = key
            at, *items = unpack_strings(payload)
            for word in items:
                if word not in known:
                    known[word] = np.array(own.encode_ordinary(word.decode()), "<u4").tobytes()
            out.append({"key": block, "payload": pack_strings([at, *map(known.__getitem__, items)])})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.int64()), ("payload", pa.binary())]))


def _reassemble(docs: pa.Table, found: pa.Table, finish) -> pa.Table:
    ids: dict[int, bytes] = {}
    for payload in found.column("payload").to_pylist():
        at, *items = unpack_strings(payload)
        ids.update(zip(np.cumsum(unpack_numbers(at)).tolist(), items, strict=True))
    parts = [b"".join(map(ids.__getitem__, unpack_numbers(p).tolist())) for p in docs.column("payload").to_pylist()]
    keys = [None if null else a for a, null in zip(docs.column("a").to_pylist(), docs.column("b").to_pylist(), strict=True)]
    columns = finish(parts) if finish else {"ids": pa.array(parts, pa.binary())}
    return pa.table({"doc_id": pa.array(keys, pa.int64())} | columns)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", finish=None, kinds: str = "ids binary", block_bytes: int = 10_000_000) -> DataFrame:
    """(doc_id, ids) for each row of docs: ids as little-endian unsigned 32-bit integers. A null text counts as
    empty and has no ids; repeated rows and null keys give a row each; other columns of docs are ignored.
    `finish` makes other columns (of the SQL types `kinds`) of a block's ids where they are, so that ids needn't travel."""
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n, parts = ranges(docs, RANGE_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(lambda batches: _blocks(batches, pattern, n, block_bytes), _SQL)
    rows = rows.repartition(parts, "key")
    ids = of_kind(rows, 1).sortWithinPartitions("key").mapInArrow(lambda batches: _encode_words(batches, path, pattern), "key long, payload binary")
    # Both readers share the exchange; the pre-tokens of a range never meet in a group.
    blocks = of_kind(rows, 0)
    return blocks.groupBy("key").cogroup(ids.groupBy("key")).applyInArrow(lambda x, y: _reassemble(x, y, finish), f"doc_id long, {kinds}")


def decode_ids(ids: bytes, path: str) -> bytes:
    """The bytes of a text's ids, by the token-byte table."""
    return b"".join(map(token_bytes(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the column `bytes`: the bytes of its column `ids`; null where ids are null."""
    names, at = list(encoded.columns), list(encoded.columns).index("ids")

    def run(batches):
        for batch in batches:
            out = [None if raw is None else decode_ids(raw, path) for raw in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "bytes"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{kinds}, bytes binary")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Each document's token count and the digests of its ids and of what they decode to. A null text counts as empty, whose
    digests are those of no bytes; repeated rows and null ids give a row each; an empty table gives no rows."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")

    def digests(parts: list[bytes]) -> dict:
        return {
            "n_tokens": pa.array([len(x) // 4 for x in parts], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(decode_ids(x, path)).hexdigest() for x in parts], pa.string()),
        }

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, path, P.PATTERN, finish=digests, kinds="n_tokens long, ids_sha256 string, decoded_sha256 string")
