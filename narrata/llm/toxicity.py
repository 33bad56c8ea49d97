"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their first 4, 6 and 8 bytes, hashed; a term's value is log(1 + its count).
The machine has the terms that tell the labels apart in the training rows, alone or beside another term (so a
group's name that is toxic only next to an insult is in it). It adds to their weights the products of their
hidden factors, so that a pair of terms can weigh more than both alone; the text's length is a term too, so
that a count can be seen against it. Rows are sparse throughout."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, text_slices
from .words import Prefix, raw_texts, segments, telling_terms, word_spans

#: Bounds of the training sample, by hash order: rows of each label.
TRAIN_ROWS = 3000
#: The model's size: places that terms hash to (as bits), terms that tell alone, terms that are looked at in pairs and those
#: of them that are taken, hidden factors, passes over the sample.
BITS, TERMS, PAIRED, PAIR_TERMS, FACTORS, EPOCHS = 20, 1500, 2500, 16, 6, 60
#: Chi-square of a term among the rows that hold another one: a chance in a hundred over all pairs that are tried.
PAIR_CHI = 38.0


def row_terms(array: pa.Array) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each text its distinct term hashes, their counts and its number of words."""
    raw, bounds = raw_texts(array)
    terms, where, owners = [], [], []
    for first, last in segments(raw):
        part = raw[first:last]
        inner = bounds[(bounds > first) & (bounds < last)] - first
        a, b = word_spans(part, np.concatenate([[0], inner, [len(part)]]))
        hashes = Prefix(part)
        for size in (4, 6, 8, None):
            long = np.flatnonzero(b - a > size) if size else np.arange(len(a))
            terms.append(hashes.hashes(a[long], a[long] + size if size else b[long]) >> np.uint64(64 - BITS))
            where.append(a[long] + first)
            owners.append(np.full(len(long), size is None))
    if not terms:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)] * len(array)
    terms, where, owners = np.concatenate(terms).astype(np.int64), np.concatenate(where), np.concatenate(owners)
    row = np.searchsorted(bounds, where, side="right") - 1
    keys, counts = np.unique((row << BITS) | terms, return_counts=True)
    words = np.bincount(row[owners], minlength=len(array))
    cut = np.searchsorted(keys, np.arange(len(array) + 1) << BITS)
    return [(keys[a:b] & ((1 << BITS) - 1), counts[a:b], int(n)) for a, b, n in zip(cut[:-1], cut[1:], words, strict=True)]


def pair_terms(rows, labels: np.ndarray, alone: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Terms (sorted) that tell the labels apart among the rows that hold another term, whatever they tell by themselves: the
    PAIR_TERMS best. Tried are those that tell alone and the commonest others, PAIRED in all."""
    both = found.sum(0)
    ones = int(labels.sum())
    both[telling_terms(found, (len(rows) - ones, ones), len(both))] = 0  # those tell alone, in the machine or not
    common = np.argsort(-both, kind="stable")[: max(0, PAIRED - len(alone))]
    tried = np.sort(np.concatenate([alone, common[both[common] >= 4]]))
    if not len(tried):
        return tried
    x = np.zeros((len(rows), len(tried)), np.float32)
    for i, (own, _, _) in enumerate(rows):
        at = np.minimum(np.searchsorted(tried, own), len(tried) - 1)
        x[i, at[tried[at] == own]] = 1
    ones, zeros = (x[labels == y].T @ x[labels == y] for y in (1, 0))  # rows with both terms
    n1, n0 = np.diag(ones)[:, None], np.diag(zeros)[:, None]  # among the rows with the first
    n, held = n0 + n1, ones + zeros
    spread = held * (n - held) * n1 * n0
    chi = np.divide(n * (ones * (n0 - zeros) - zeros * (n1 - ones)) ** 2, spread, out=np.zeros_like(spread), where=(spread > 0) & (held >= 4) & (n - held >= 4))
    best = chi.max(0)
    best[np.isin(tried, alone)] = 0
    good = np.flatnonzero(best >= PAIR_CHI)
    return np.sort(tried[good[np.argsort(-best[good], kind="stable")[:PAIR_TERMS]]])


class Sparse:
    """Rows of (place, value); the machine's last place is the text's length."""

    def __init__(self, rows, terms: np.ndarray):
        places, values, sizes = [], [], []
        for own, counts, words in rows:
            at = np.minimum(np.searchsorted(terms, own), max(0, len(terms) - 1))
            hit = terms[at] == own if len(terms) else np.zeros(len(own), bool)
            places += [at[hit], [len(terms)]]
            values += [np.log1p(counts[hit]), [np.log1p(words) / 5]]
            sizes.append(int(hit.sum()) + 1)
        self.places = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
        self.values = np.concatenate(values).astype(np.float32) if values else np.zeros(0, np.float32)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, values and each row's first of them."""
        sizes = self.first[rows + 1] - self.first[rows]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.arange(int(sizes.sum())) + np.repeat(self.first[rows] - first, sizes)
        return self.places[at], self.values[at], first


class Machine:
    """A factorization machine with a logistic output, trained by AdaGrad on sparse rows."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors

    def logits(self, rows) -> np.ndarray:
        """Of rows as row_terms gives them."""
        x = Sparse(rows, self.terms)
        return self._logits(x.places, x.values, x.first[:-1])[0] if len(x) else np.zeros(0, np.float32)

    def _logits(self, places, values, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hidden = self.factors[places] * values[:, None]
        inner = np.add.reduceat(hidden, first)
        linear = np.add.reduceat(self.weights[places] * values, first)
        return self.bias + linear + 0.5 * (inner * inner - np.add.reduceat(hidden * hidden, first)).sum(1), inner, hidden

    @classmethod
    def fit(cls, rows, labels: np.ndarray, share: float, seed: int = 10) -> "Machine":
        """share: of label 1 among all rows that could have been sampled, the score where there's nothing to learn. Else the
        sample's own odds hold, which weigh both labels alike where each has its full number of rows."""
        n = len(rows)
        if n == 0 or labels.min() == labels.max():  # nothing to tell apart
            p = min(max(share, 1e-3), 1 - 1e-3)
            return cls(np.zeros(0, np.int64), float(np.log(p / (1 - p))), np.zeros(1, np.float32), np.zeros((1, FACTORS), np.float32))
        found = np.zeros((2, 1 << BITS), np.int32)
        for (own, _, _), y in zip(rows, labels, strict=True):
            found[int(y), own] += 1
        ones = int(labels.sum())
        alone = telling_terms(found, (n - ones, ones), TERMS)
        terms = np.union1d(alone, pair_terms(rows, labels, alone, found))
        x, size = Sparse(rows, terms), len(terms) + 1
        rng = np.random.default_rng(seed)
        m = cls(terms, 0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32))
        sum_b, sum_w, sum_f = 1e-6, np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32)
        y = labels.astype(np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for at in range(0, n, 256):
                own = order[at : at + 256]
                places, values, first = x.take(own)
                z, inner, hidden = m._logits(places, values, first)
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
                sizes = np.diff(np.append(first, len(places)))
                weight = np.repeat(e, sizes) * values
                by = np.argsort(places, kind="stable")
                touched, start = np.unique(places[by], return_index=True)
                g = np.add.reduceat(weight[by], start) + 1e-4 * m.weights[touched]
                h = np.add.reduceat((weight[:, None] * (np.repeat(inner, sizes, 0) - hidden))[by], start) + 1e-3 * m.factors[touched]
                sum_b += float(e.sum()) ** 2
                sum_w[touched] += g * g
                sum_f[touched] += h * h
                m.bias -= 0.1 * float(e.sum()) / sum_b**0.5
                m.weights[touched] -= 0.1 * g / np.sqrt(sum_w[touched])
                m.factors[touched] -= 0.05 * h / np.sqrt(sum_f[touched])
        return m


def held_out(key: str):
    """Whether a row is kept from training: crc32 of the id as text is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Machine:
    """Fits a machine on at most `rows` labelled rows of each label that aren't held out, taken in the order of a hash of
    their id. Labels other than 0 and 1 don't count, nor do ids that have both; a null text counts as empty; rows that
    share an id count each. A bounded sample reaches the driver as term counts."""
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    usable = usable.where("doc_id is not null").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    totals = {r[0]: r[1] for r in usable.groupBy("y").count().collect()}
    order = F.xxhash64(F.lit("train"), "doc_id")
    picks = [usable.where(F.col("y") == y).orderBy(order, "doc_id").limit(rows) for y in (0, 1)]
    picked = picks[0].union(picks[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # 2 x rows ids at most

    def run(batches):
        for batch in batches:
            for lo, hi in text_slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                out = [zlib.compress(np.array([n, len(t), *t, *c], "<i4").tobytes(), 1) for t, c, n in row_terms(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(out, pa.binary())], names=["doc_id", "y", "terms"])

    ids, found, marks = [], [], []
    counted = texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, terms binary")
    for r in durable(counted, "training_terms").toLocalIterator():
        x = np.frombuffer(zlib.decompress(r.terms), "<i4")
        ids.append(r.doc_id)
        found.append((x[2 : 2 + x[1]], x[2 + x[1] :], int(x[0])))
        marks.append(r.y)
    at = np.argsort(np.array(ids, np.int64), kind="stable")  # whatever order the rows came in
    return Machine.fit([found[i] for i in at], np.array(marks, np.int64)[at], totals.get(1, 0) / max(1, sum(totals.values())))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row: the machine's probability, from the text alone; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            for lo, hi in text_slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                z = np.clip(machine.logits(row_terms(part.column(1))).astype(np.float64), -60, 60)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def op10_factorization_machine(spark, sf_dir: str) -> DataFrame:
    """All documents' scores; trained on the labels outside the held-out fifth. Null and empty texts are scored as empty; repeated
    rows alike; without labels all get one score; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
