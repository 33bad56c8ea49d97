"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes; a chunk ends before a word where the hash's top bits are zero and no such place
close by has a lower hash, so chunks resist insertions. In a stretch without white space it ends before a
character, at more zero bits; where a word begins or ends to repeat itself, always; far from all these, at the
least hash around. Every bound depends on the bytes around it alone, never on the bound before it. What is compared
are the shortest windows of neighbouring chunks with enough words, which cover any run of chunks that has so
many; they are dealt packed, by digest. Within a range of digests equal ones meet and the smallest (id,
place) wins; a window that has an earlier copy is a repeat. Blocks and ranges are of bounded size."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import pack_numbers, unpack_numbers
from .common import of_kind, ranges
from .words import _SPACE, Prefix, mix, raw_texts, word_spans

_RNG = np.random.Generator(np.random.PCG64(8))
_GEAR = _RNG.integers(0, 2**16, 256, dtype=np.uint16)
BITS, INNER_BITS, LEAST, REACH, RUN = 1, 4, 8, 64, 40
#: Words of a span; bytes of input for a range of digests.
LEAST_WORDS, RANGE_BYTES = 30, 32 << 20
_ROWS = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("a", pa.int64()), ("payload", pa.binary()), ("text", pa.binary())])
_SQL = "key long, kind int, block long, a long, payload binary, text binary"


def gear(raw: np.ndarray) -> np.ndarray:
    """At each byte the gear hash h = 2 h' + G[byte] modulo 2**16, by doubling: it holds the last 16 bytes."""
    h = _GEAR[raw]
    for shift in (1, 2, 4, 8):
        h[shift:] += h[:-shift] << shift
    return h


def _lowest(h: np.ndarray, reach: int) -> np.ndarray:
    """Whether a place holds the least of all from `reach` before to `reach` after it (ties count), by doubling."""
    low, size = h.copy(), 1
    n = len(h)
    while size < reach + 1:  # low[i]: the least of h[i - size + 1 .. i]
        step = min(size, reach + 1 - size)
        low[step:] = np.minimum(low[step:], low[:-step].copy()) if n > step else low[step:]
        size += step
    ahead = np.full(n, np.iinfo(h.dtype).max, h.dtype)
    if n > reach:
        ahead[: n - reach] = low[reach:]
    for i in range(max(0, n - reach), n) if n <= 2 * reach else ():
        ahead[i] = h[i:].min()
    if n > 2 * reach:
        ahead[n - reach :] = np.minimum.accumulate(h[n - reach :][::-1])[::-1]
    return (h <= low) & (h <= ahead)


def cuts(raw: np.ndarray, hashes: Prefix | None = None) -> np.ndarray:
    """Bounds of the chunks of one text, from 0 to its length."""
    n = len(raw)
    if not n:
        return np.zeros(1, np.int64)
    h, space = gear(raw), _SPACE[raw]
    begins = np.zeros(n, bool)  # a word begins after this byte
    begins[:-1] = space[:-1] & ~space[1:]
    since = np.arange(n) - np.maximum.accumulate(np.where(space, np.arange(n), -1))
    inner = np.zeros(n, bool)  # within a run without white space: a character begins after this byte
    inner[:-1] = (since[:-1] > RUN) & ((raw[1:] & 0xC0) != 0x80)
    found = np.flatnonzero((begins & (h < 1 << 16 - BITS)) | (inner & (h < 1 << 16 - INNER_BITS)))
    low, gone = h[found], np.zeros(len(found), bool)
    for d in range(1, LEAST):
        near = found[d:] - found[:-d] < LEAST
        if not near.any():
            break
        gone[:-d] |= near & (low[d:] < low[:-d])
        gone[d:] |= near & (low[:-d] < low[d:])
    a, b = word_spans(raw, np.array([0, n]))
    words = (hashes or Prefix(raw)).hashes(a, b)
    same = np.concatenate([[False], words[1:] == words[:-1], [False]])  # whether a word is the one before it
    turns = a[~same[:-1] & (same[1:] | np.concatenate([[False], same[:-2]]))] if len(words) else a
    found = np.union1d(found[~gone] + 1, turns)
    found = found[(found > 0) & (found < n)]
    edges = np.concatenate([[0], found, [n]])
    more = []
    for g in np.flatnonzero(np.diff(edges) > 2 * REACH).tolist():
        x, y = int(edges[g]), int(edges[g + 1]) - 1  # ends of chunks between: after the bytes x .. y - 1
        some = begins[x:y] | inner[x:y]
        value = np.where(some, h[x:y].astype(np.uint32), np.uint32(1 << 20))
        at = np.flatnonzero(_lowest(value, REACH) & some) + 1
        more.append(x + at[(at >= REACH) & (at <= y + 1 - x - REACH)])
    return np.concatenate([[0], np.union1d(found, np.concatenate(more)) if more else found, [n]]).astype(np.int64)


def sizes(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of a text's size in words: a word counts one; in a run of more than RUN bytes without white space each
    further byte counts as its share of a word of six bytes, in sixths; all in sixths."""
    n = len(raw)
    inside = ~_SPACE[raw]
    start = inside & np.concatenate([[True], ~inside[:-1]]) if n else inside
    since = np.arange(n) - np.maximum.accumulate(np.where(~inside, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(np.where(start, 6, np.where(inside & (since > RUN), 1, 0)))])


def items(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 chunk of what is compared, ordered by place: from and up to each chunk the shortest window of
    size `least` or more. These windows cover any run of chunks that has that size."""
    n = len(words)
    sums = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    to = np.searchsorted(sums, sums[:-1] + least)
    since = np.searchsorted(sums, sums[1:] - least, "right") - 1
    first = np.concatenate([at[to <= n], since[since >= 0]])
    last = np.concatenate([to[to <= n], at[since >= 0] + 1])
    place = np.unique(first * (n + 1) + last)
    return place // (n + 1), place % (n + 1)


def _zigzag(x: np.ndarray) -> np.ndarray:
    return np.where(x < 0, -2 * x - 1, 2 * x)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    return np.where(x & 1, -(x + 1) // 2, x // 2)


def _pack_longs(x: np.ndarray) -> bytes:
    return zlib.compress(np.diff(x, prepend=np.int64(0)).astype("<i8").tobytes(), 1)


def _unpack_longs(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), "<i8"))


def _blocks(batches, ranges: int, block_bytes: int, keep_text: bool, least: int):
    """kind 0: a document of a block: its chunks' starts (code points) and words, and its items' numbers in the block;
    kind 1: of a block, in one range of digests, the first of each digest: number, document, whether the block has it again."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 24
    rows: list[tuple] = []
    schema = _ROWS
    hold: list[tuple] = []
    size = 0

    def flush():
        nonlocal hold
        digests = [np.concatenate([x[i] for x in hold]) if hold else np.zeros(0, np.uint64) for i in (1, 2)]
        owner = np.repeat(np.array([x[0] for x in hold], np.int64), [len(x[1]) for x in hold])
        order = np.lexsort((np.arange(len(owner)), owner, digests[1], digests[0]))
        new = np.ones(len(order), bool)
        new[1:] = (digests[0][order][1:] != digests[0][order][:-1]) | (digests[1][order][1:] != digests[1][order][:-1])
        first = order[new]
        again = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
        code = np.zeros(len(order), np.int64)  # each item's number is the place of its digest's first copy
        code[order] = np.repeat(first, np.diff(np.append(np.flatnonzero(new), len(order))))
        at = 0
        for doc, hi, _, starts, words, text, kept in hold:
            own = code[at : at + len(hi)]
            back = own - np.arange(at, at + len(hi))
            payload = [pack_numbers(np.array([len(words)])), pack_numbers(np.diff(starts)), pack_numbers(words), pack_numbers(_zigzag(back))]
            rows.append((block, 0, block, doc, zlib.compress(b"".join(payload), 1) + at.to_bytes(8, "little"), zlib.compress(text, 1) if keep_text else None, kept))
            at += len(hi)
        by = np.argsort(first, kind="stable")
        first, again = first[by], again[by]
        deal = (digests[0][first] % np.uint64(ranges)).astype(np.int64)
        for r in np.unique(deal):
            own = first[deal == r]
            head = zlib.compress(pack_numbers(np.diff(own, prepend=0) * 2 + again[deal == r]), 1)
            docs = _pack_longs(owner[own])
            payload = len(head).to_bytes(4, "little") + len(docs).to_bytes(4, "little") + head + docs
            rows.append((-1 - int(r), 1, block, len(own), payload + digests[0][own].tobytes() + (digests[1][own] >> np.uint64(32)).astype("<u4").tobytes(), None, None))
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=False)], schema=schema)
        rows.clear()
        hold = []
        return out

    for batch in batches:
        others = [None] * batch.num_rows
        if batch.num_columns > 2:
            schema, others = _ROWS.append(pa.field("kept", batch.schema.types[2])), batch.column(2).to_pylist()
        for i, key in enumerate(batch.column(0).to_pylist()):
            raw, _ = raw_texts(batch.column(1).slice(i, 1))
            if key is None or (not len(raw) and not keep_text):
                continue
            hashes = Prefix(raw)
            found = cuts(raw, hashes)
            begin = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            words = np.diff(sizes(raw)[found])
            first, last = items(words, least)
            # White space at its end is no part of what is compared.
            solid = np.maximum.accumulate(np.where(_SPACE[raw], 0, np.arange(1, len(raw) + 1)))
            a, b = found[first], solid[found[last] - 1]
            hi = hashes.hashes(a, b)
            # A second hash: the same bytes seen as pairs.
            lo = Prefix(np.bitwise_xor(raw, np.roll(raw, 1) * np.uint8(3) + np.uint8(1)) if len(raw) else raw).hashes(np.minimum(a + 1, b), b)
            hold.append((key, hi, mix(lo ^ hi), begin[found], words, raw.tobytes(), others[i]))
            size += len(raw)
            if size >= block_bytes:
                yield flush()
                block, size = block + 1, 0
    if hold:
        yield flush()


def _match(table: pa.Table) -> pa.Table:
    """Of one range: for each block, the numbers of digests seen at least twice and the winner's document and place."""
    blocks, numbers, docs, again, hi, lo = [], [], [], [], [], []
    for block, n, payload in zip(table.column("block").to_pylist(), table.column("a").to_pylist(), table.column("payload").to_pylist(), strict=True):
        x, y = int.from_bytes(payload[:4], "little"), int.from_bytes(payload[4:8], "little")
        head = unpack_numbers(zlib.decompress(payload[8 : 8 + x]))
        blocks.append(np.full(n, block))
        numbers.append(np.cumsum(head >> 1))
        again.append(head & 1)
        docs.append(_unpack_longs(payload[8 + x : 8 + x + y]))
        hi.append(np.frombuffer(payload, "<u8", n, 8 + x + y))
        lo.append(np.frombuffer(payload, "<u4", n, 8 + x + y + 8 * n))
    blocks, numbers, docs, again, hi, lo = map(np.concatenate, (blocks, numbers, docs, again, hi, lo))
    order = np.lexsort((numbers, blocks, docs, lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(order)))
    several = np.repeat((sizes > 1) | (np.add.reduceat(again[order], at) > 0), sizes)
    winner = np.repeat(order[at], sizes)
    own, winner = order[several], winner[several]
    by = np.lexsort((numbers[own], blocks[own]))
    own, winner = own[by], winner[by]
    out_key, out = [], []
    bounds = np.flatnonzero(np.concatenate([[True], blocks[own][1:] != blocks[own][:-1], [True]])) if len(own) else [0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        x, w = own[a:b], winner[a:b]
        parts = [_pack_longs(numbers[x]), _pack_longs(docs[w]), _pack_longs((w == x).astype(np.int64))]
        out_key.append(int(blocks[x[0]]))
        out.append(b"".join(len(p).to_bytes(4, "little") for p in parts) + b"".join(parts))
    return pa.table({"key": pa.array(out_key, pa.int64()), "payload": pa.array(out, pa.binary())})


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _spans(words: np.ndarray, starts: np.ndarray, seen: np.ndarray, owner: np.ndarray, least: int) -> list[dict]:
    """The repeats of one document; seen: its items that have an earlier copy; owner: the winner's document."""
    n = len(words)
    first, last = (x[seen] for x in items(words, least))
    owner = owner[seen]
    sums = np.concatenate([[0], np.cumsum(words)])
    marked = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1))[:n] > 0
    spans = []
    for a, b in _runs(marked):
        # The document whose windows cover the most of it.
        inner = (first >= a) & (last <= b)
        low, high = first[inner] - a, last[inner] - a
        source, which = np.unique(owner[inner], return_inverse=True)
        share = [0] * len(source)
        for k in range(len(source)) if len(source) > 1 else ():
            x, y = low[which == k], high[which == k]
            share[k] = int(words[a:b][np.cumsum(np.bincount(x, minlength=b - a + 1) - np.bincount(y, minlength=b - a + 1))[:-1] > 0].sum())
        spans.append({"start": int(starts[a]), "end": int(starts[b]), "n_words": int(sums[b] - sums[a]) // 6, "first_doc_id": int(source[int(np.argmax(share))])})
    return spans


def _repeats(docs: pa.Table, found: pa.Table, least: int, keep_text: bool, within: bool) -> pa.Table:
    numbers, owners, wins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for payload in found.column("payload").to_pylist():
        at = 12
        for i, to in enumerate((numbers, owners, wins)):
            n = int.from_bytes(payload[4 * i : 4 * i + 4], "little")
            to.append(_unpack_longs(payload[at : at + n]))
            at += n
    numbers, owners, wins = map(np.concatenate, (numbers, owners, wins))
    by = np.argsort(numbers)
    numbers, owners, wins = numbers[by], owners[by], wins[by]
    out: dict[str, list] = {"doc_id": [], "repeats": [], "text": []}
    at: list[int] = []
    for i, (doc, payload, text) in enumerate(zip(*(docs.column(c).to_pylist() for c in ("a", "payload", "text")), strict=True)):
        raw, first = zlib.decompress(payload[:-8]), int.from_bytes(payload[-8:], "little")
        values = unpack_numbers(raw)
        n = int(values[0])
        starts = np.concatenate([[0], np.cumsum(values[1 : n + 1])])
        words, back = values[n + 1 : 2 * n + 1], _unzigzag(values[2 * n + 1 :])
        place = first + np.arange(len(back))
        code = back + place
        where = np.searchsorted(numbers, code)
        seen = np.zeros(len(back), bool)
        if len(numbers):
            where = np.minimum(where, len(numbers) - 1)
            # The winner itself stays: the first copy in the winning block; unless `within`, so do further copies in its row.
            own = code == place if within else (code >= first) & (code < first + len(back))
            seen = (numbers[where] == code) & ~((wins[where] == 1) & own)
        spans = _spans(words, starts, seen, owners[where] if len(numbers) else where, least) if seen.any() else []
        if keep_text:
            whole, parts, done = zlib.decompress(text).decode(), [], 0
            for s in spans:
                parts.append(whole[done : s["start"]])
                done = s["end"]
            out["text"].append("".join(parts) + whole[done:])
        elif not spans:
            continue
        out["doc_id"].append(doc)
        out["repeats"].append(spans)
        at.append(i)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("first_doc_id", pa.int64())]))
    table = {"doc_id": pa.array(out["doc_id"], pa.int64()), "repeats": pa.array(out["repeats"], kind)}
    table |= {"text": pa.array(out["text"], pa.string())} if keep_text else {}
    return pa.table(table | ({"kept": docs.column("kept").take(pa.array(at, pa.int64()))} if "kept" in docs.column_names else {}))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, keep_text: bool = False, within: bool = False, block_bytes: int = 6_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, repeats[, text][, kept]): the spans (code points, end exclusive) whose words occur before, in a document with a
    smaller id (or, with `within`, earlier in the same one), and that document; a span has `least_words` words or more. Without
    keep_text only documents with repeats are given; with it all, and text lacks the spans. Rows with a null key are
    left out; a null text counts as empty; of rows that share an id each counts as a document of its own, the first
    in the input being the original. An empty table gives no rows. Where there is no white space for over RUN bytes,
    six bytes count as a word. kept is a struct of the row's columns named in `keep`."""
    parts, least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 6 * least_words
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *([F.struct(*keep).alias("kept")] if keep else []))
    n = ranges(rows, RANGE_BYTES)
    blocks, kind = StructType.fromDDL(_SQL), StructType.fromDDL("doc_id long, repeats array<struct<start:long,end:long,n_words:long,first_doc_id:long>>" + ", text string" * keep_text)
    if keep:
        blocks, kind = (x.add("kept", rows.schema["kept"].dataType) for x in (blocks, kind))
    rows = rows.mapInArrow(lambda b: _blocks(b, n, block_bytes, keep_text, least), blocks).repartition(parts, "key")
    # Both readers share the exchange; the digests of a range meet in one group, documents in those of their blocks.
    found = of_kind(rows, 1).groupBy("key").applyInArrow(_match, "key long, payload binary")
    texts = of_kind(rows, 0)
    return texts.groupBy("key").cogroup(found.groupBy("key")).applyInArrow(lambda x, y: _repeats(x, y, least, keep_text, within), kind)


def op8_gear_chunks(spark, sf_dir: str) -> DataFrame:
    """A row for each repeated span of all documents. Null and empty texts have none; repeated rows count as documents of
    their own; an empty table gives no rows."""
    found = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.explode("repeats").alias("r")).select("doc_id", "r.start", "r.end", "r.n_words", "r.first_doc_id")


def without(text, repeats):
    """The text column less its spans (ordered, apart, as in `repeats`); null and empty spans change nothing."""
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("done"))
    step = F.aggregate(
        repeats,
        start,
        lambda s, r: F.struct(
            F.concat(s["kept"], F.substr(text, (s["done"] + 1).cast("int"), (r["start"] - s["done"]).cast("int"))).alias("kept"),
            r["end"].alias("done"),
        ),
        lambda s: F.concat(s["kept"], F.substr(text, (s["done"] + 1).cast("int"))),
    )
    return F.when(F.size(repeats) > 0, step).otherwise(text)
