"""Quality by co-training. One classifier sees the text's content: its words and what they are made of. The other
sees the page: source, language, size and how its lines lie, but no word or letter. Each is trained on a bounded
labelled sample. In each round both score all documents, and each hands the unlabelled ones that it is surest of
to the other as pseudo-labels. Both are calibrated on labelled rows kept aside, where the weights of their
calibrated log-odds are fitted too, so that a view that knows little says little."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, text_slices
from .words import Prefix, raw_texts, segments, telling_terms, word_spans

#: Bound of the sample, by hash order: labelled rows of each label.
LABELLED = 2500
#: Rounds of exchange; the rows of either label that a view hands over in one; the calibrated log-odds that it must be sure of,
#: and how far they must be from those of the labels alone, so that a view that knows nothing hands over nothing.
ROUNDS, HANDED, SURE, LIFT = 2, (60, 120), 1.5, 1.0
BITS, TERMS = 18, 800
#: Documents less likely good than this are rejected; under one half, so that doubt keeps a document.
REJECT = 0.3
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_SIGN = np.zeros(256, np.int64)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
STATS, LAYOUT = 7, 7
HASHED = 32  # places of each of source, language and both
PAGE = LAYOUT + 3 * HASHED


def page_row(text: np.ndarray, source, language) -> np.ndarray:
    """Size and lines of a page, and where it is from. Line hashes only tell whether lines repeat."""
    ends = np.flatnonzero(text == 10)
    edges = np.concatenate([[0], ends + 1, [len(text) + 1]])
    sizes = np.diff(edges) - 1
    full = np.flatnonzero(sizes > 0)
    distinct = len(np.unique(Prefix(text).hashes(edges[full], edges[full] + sizes[full]))) if len(full) > 1 else len(full)
    n, lines = len(text), len(full)
    out = np.zeros(PAGE, np.float32)
    out[:LAYOUT] = (
        np.log1p(n) / 5, np.log1p(lines) / 3, np.log1p(n / max(1, lines)) / 5, np.log1p(sizes.max(initial=0)) / 5, (len(sizes) - lines) / (len(sizes) + 3),
        (lines - distinct) / (lines + 3) * 3, np.log1p(sizes[full].std() if lines else 0) / 5,
    )
    for i, value in enumerate((source, language, (source, language))):
        out[LAYOUT + i * HASHED + zlib.crc32(repr(value).encode()) % HASHED] = 0.3
    return out


def row_views(texts: pa.Array, sources: list, languages: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row its content terms (hashes of words, of their last three bytes, of their shapes), their shares of
    the row's words, shares of its letters, and its page. A null text counts as empty, null source or language as a
    value of its own."""
    raw, bounds = raw_texts(texts)
    n = len(texts)
    terms, owners = [], []
    totals = np.zeros((n, 6))
    for first, last in segments(raw):
        part = raw[first:last]
        inner = bounds[(bounds > first) & (bounds < last)] - first
        a, b = word_spans(part, np.concatenate([[0], inner, [len(part)]]))
        row = np.searchsorted(bounds, a + first, side="right") - 1
        hashes = Prefix(part)
        ups, digits, signs = (np.concatenate([[0], np.cumsum(k[part])]) for k in (_UPPER, _DIGIT, _SIGN))
        up, digit, sign = ups[b] - ups[a], digits[b] - digits[a], signs[b] - signs[a]
        whole = hashes.hashes(a, b)
        tail = hashes.hashes(np.maximum(a, b - 3), b) ^ np.uint64(0x5555555555555555)
        again = np.concatenate([[False], whole[1:] == whole[:-1]])
        shape = (np.minimum(up, 3) * 64 + np.minimum(sign, 3) * 16 + np.minimum(digit, 3) * 4 + np.minimum((b - a) // 8, 3)).astype(np.uint64)
        shape = (shape * np.uint64(2) + again + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for x in (whole, tail, shape):
            terms.append((x >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(row)
        for i, x in enumerate((np.ones(len(a)), b - a, up, digit, sign, again)):
            totals[:, i] += np.bincount(row, x, minlength=n)
    terms, owners = np.concatenate(terms), np.concatenate(owners)
    keys, counts = np.unique((owners << BITS) | terms, return_counts=True)
    cut = np.searchsorted(keys, np.arange(n + 1) << BITS)
    out = []
    for i in range(n):
        words, letters, up, digit, sign, again = totals[i]
        own, c = keys[cut[i] : cut[i + 1]] & ((1 << BITS) - 1), counts[cut[i] : cut[i + 1]]
        # Shares lean to those of common prose, the more the shorter the text: a few words tell little.
        stats = np.array([
            (letters + 110) / (words + 20) / 10, (up + 3) / (letters + 100) * 3, (digit + 0.3) / (letters + 100) * 5, (sign + 2.5) / (letters + 100) * 5,
            again / (words + 20) * 3, (len(own) + 40) / (words + 20) / 3, float(words == 0),
        ], np.float32)
        out.append((own, np.sqrt(c / max(words, 1)).astype(np.float32), stats, page_row(raw[bounds[i] : bounds[i + 1]], sources[i], languages[i])))
    return out


def logistic(u: np.ndarray, target: np.ndarray, prior: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit that leans to `prior`, by damped Newton steps."""

    def loss(w):
        v = u @ w
        return float((np.logaddexp(0, v) - target * v).sum() + (penalty * (w - prior) ** 2).sum())

    w = prior.astype(np.float64)
    own = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        g = u.T @ (p - target) + 2 * penalty * (w - prior)
        h = (u * (p * (1 - p) + 1e-6)[:, None]).T @ u + np.diag(2 * penalty)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(w - size * step) > own:
            size /= 2
        new = loss(w - size * step)
        if not new < own - 1e-9:
            break
        w, own = w - size * step, new
    return w


class View:
    """A logistic classifier of dense rows with a calibration of its log-odds."""

    def __init__(self, size: int):
        self.weights, self.centre, self.bias, self.slope, self.shift = np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> "View":
        # Values count from their means, so that one never seen (a new source) says nothing.
        self.weights, self.centre, self.bias = np.zeros(x.shape[1], np.float32), x.mean(0), 0.0
        x = x - self.centre
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
        sums, sum_b = np.full(x.shape[1], 1e-8, np.float32), 1e-8
        for _ in range(steps):
            e = weight * (1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30))) - y)
            g, b = x.T @ e + penalty * self.weights, float(e.sum())
            sums, sum_b = sums + g * g, sum_b + b * b
            self.weights = self.weights - 0.3 * g / np.sqrt(sums)
            self.bias -= 0.3 * b / sum_b**0.5
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.weights + self.bias

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "View":
        """Platt's: a logistic fit of the labels on the raw log-odds; its targets stay off 0 and 1, so that a few or separable
        rows give no steep slope. With one label only the log-odds stay as they are."""
        z = self.raw(x).astype(np.float64)
        ones = int(y.sum())
        if not 0 < ones < len(y) or not z.std() > 0:
            return self
        target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
        centre, scale = z.mean(), z.std()
        w = logistic(np.stack([(z - centre) / scale, np.ones(len(z))], 1), target, np.zeros(2), np.array([0.05, 5e-7]))
        self.slope, self.shift = w[0] / scale, w[1] - w[0] * centre / scale
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x).astype(np.float64) + self.shift, -20, 20)


class CoTrained:
    """Both views; weights: of their calibrated log-odds, and a constant."""

    def __init__(self, terms: np.ndarray, content: View, page: View):
        self.terms, self.content, self.page, self.weights, self.prior = terms, content, page, np.array([0.5, 0.5, 0.0]), 0.0

    def matrices(self, rows) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(self.terms) + STATS), np.float32)
        for i, (own, value, stats, _) in enumerate(rows):
            if len(own) and len(self.terms):
                at = np.minimum(np.searchsorted(self.terms, own), len(self.terms) - 1)
                hit = self.terms[at] == own
                x[i, at[hit]] = value[hit]
            x[i, len(self.terms) :] = stats
        return x, np.array([r[3] for r in rows], np.float32).reshape(len(rows), PAGE)

    @classmethod
    def start(cls, rows, labels: np.ndarray) -> "CoTrained":
        """The terms that the training rows tell apart by; both views say that all is good, until they are fitted."""
        if not len(rows) or labels.min() == labels.max():  # nothing to learn from: all are kept
            terms = np.zeros(0, np.int64)
        else:
            train = np.arange(len(rows)) % 5 != 4
            found = np.zeros((2, 1 << BITS), np.int32)
            for (own, *_), y, use in zip(rows, labels, train, strict=True):
                if use:
                    found[int(y), own] += 1
            ones = int(labels[train].sum())
            terms = telling_terms(found, (int(train.sum()) - ones, ones), TERMS)
        out = cls(terms, View(len(terms) + STATS), View(PAGE))
        out.content.shift = out.page.shift = 3.0
        return out

    def fit(self, rows, labels: np.ndarray, given) -> "CoTrained":
        """Fits both views on labelled rows (each fifth is kept aside and calibrates) and on `given`: for each view, rows with
        the labels that the other one gave them."""
        train = np.arange(len(rows)) % 5 != 4
        both, y = self.matrices(rows), labels.astype(np.float32)
        for i, (view, penalty) in enumerate(((self.content, 1e-4), (self.page, 1e-3))):
            more = self.matrices([r for r, _ in given[i]])[i]
            view.fit(np.concatenate([both[i][train], more]), np.concatenate([y[train], np.array([v for _, v in given[i]], np.float32)]), penalty)
            view.slope, view.shift = 1.0, 0.0
            view.calibrate(both[i][~train], labels[~train])
        aside = labels[~train]
        if len(aside) and 0 < aside.sum() < len(aside):
            self.prior = float(np.log(aside.sum() / (len(aside) - aside.sum())))
            u = np.stack([self.content.logits(both[0][~train]), self.page.logits(both[1][~train]), np.ones(len(aside))], 1)
            # Independent views' log-odds add up, less the labels' own; rows kept aside correct that.
            self.weights = logistic(u, aside.astype(np.float64), np.array([1.0, 1.0, -self.prior]), np.array([0.5, 0.5, 0.5]))
        return self

    def logits(self, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds by content, by page and by both."""
        x, page = self.matrices(rows)
        a, b = self.content.logits(x), self.page.logits(page)
        return a, b, np.clip(self.weights[0] * a + self.weights[1] * b + self.weights[2], -20, 20)

    def sureness(self, rows) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view how sure it is of label 0 and of label 1; 0 where it isn't sure enough."""
        out = []
        for z in self.logits(rows)[:2]:
            out.append(tuple(np.where((way * z > SURE) & (way * (z - self.prior) > LIFT), way * z, 0.0) for way in (-1, 1)))
        return out


def _packed(view) -> bytes:
    own, value, stats, page = view
    return zlib.compress(own.astype("<i4").tobytes() + value.astype("<f4").tobytes() + stats.astype("<f4").tobytes() + page.astype("<f4").tobytes(), 1)


def _unpacked(raw: bytes):
    raw = zlib.decompress(raw)
    n = (len(raw) - 4 * (STATS + PAGE)) // 8
    return np.frombuffer(raw, "<i4", n).astype(np.int64), np.frombuffer(raw, "<f4", n, 4 * n), np.frombuffer(raw, "<f4", STATS, 8 * n), np.frombuffer(raw, "<f4", PAGE, 8 * n + 4 * STATS)


def _views(batch: pa.RecordBatch):
    """Slices of a batch with their rows' views."""
    for lo, hi in text_slices(batch, "text"):
        part = batch.slice(lo, hi - lo)
        yield part, row_views(part.column("text"), part.column("source").to_pylist(), part.column("lang").to_pylist())


def _surest(batches, machine: CoTrained):
    """Of a task's rows, for each view and label the distinct texts that the view is surest of, twice as many as it hands over."""
    held: dict[tuple[int, int], dict[int, tuple]] = {(v, y): {} for v in (0, 1) for y in (0, 1)}
    heaps: dict[tuple[int, int], list] = {k: [] for k in held}
    for batch in batches:
        for part, views in _views(batch):
            ids = part.column("doc_id").to_pylist()
            raw, bounds = raw_texts(part.column("text"))
            hashes = Prefix(raw).hashes(bounds[:-1], bounds[1:]).view(np.int64).tolist()
            for v, both in enumerate(machine.sureness(views)):
                for y, sure in enumerate(both):
                    for i in np.flatnonzero(sure).tolist():
                        key, own, heap, rows = (v, y), float(sure[i]), heaps[v, y], held[v, y]
                        if hashes[i] in rows or (len(heap) >= 2 * HANDED[y] and (own, hashes[i]) <= heap[0]):
                            continue
                        heapq.heappush(heap, (own, hashes[i]))
                        rows[hashes[i]] = (v, y, own, ids[i], hashes[i], _packed(views[i]))
                        if len(heap) > 2 * HANDED[y]:
                            del rows[heapq.heappop(heap)[1]]
    out = [x for rows in held.values() for x in rows.values()]
    kinds = pa.schema([("view", pa.int32()), ("y", pa.int32()), ("sure", pa.float64()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("views", pa.binary())])
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t.type) for i, t in enumerate(kinds)], schema=kinds)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """Fits both views on at most `labelled` rows of each label of `labels`, in the order of a hash of their id, and on what
    they hand each other in `rounds` passes over all of docs: of the distinct texts that a view is surest of, twice HANDED,
    those without a label, HANDED at most. Labels other than 0 and 1 don't count, nor do ids that have both. Without
    labels, or with one kind only, nothing is learnt and all is good. The bounded sample and what is handed over reach
    the driver, as term counts, shares and pages."""
    usable = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null")
    usable = usable.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    order = F.xxhash64(F.lit("quality"), "doc_id")
    picks = [usable.where(F.col("y") == y).orderBy(order, "doc_id").limit(labelled) for y in (0, 1)]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    texts = plain.join(F.broadcast(picks[0].union(picks[1])), "doc_id")  # bounded, as above

    def run(batches):
        for batch in batches:
            for part, views in _views(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(map(_packed, views)), pa.binary())], names=["doc_id", "y", "views"])

    sample = durable(texts.mapInArrow(run, "doc_id long, y int, views binary"), "quality_sample")
    found = sorted(((zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.views, r.y) for r in sample.toLocalIterator()), key=lambda r: r[:3])
    discard(sample)
    rows, y = [_unpacked(r[2]) for r in found], np.array([r[3] for r in found], np.int64)
    machine, given = CoTrained.start(rows, y), ([], [])
    if not len(rows) or y.min() == y.max():
        return machine
    machine.fit(rows, y, given)
    for _ in range(rounds):
        now = machine
        best = durable(plain.mapInArrow(lambda b, m=now: _surest(b, m), "view int, y int, sure double, doc_id long, hash long, views binary"), "quality_surest")
        best = best.groupBy("view", "y", "hash").agg(F.max(F.struct("sure", F.coalesce("doc_id", F.lit(0)).alias("id"), "doc_id", "views")).alias("b")).select("view", "y", "hash", "b.*")
        free = None
        for v in (0, 1):
            for label in (0, 1):
                top = best.where((F.col("view") == v) & (F.col("y") == label)).orderBy(F.desc("sure"), "hash").limit(2 * HANDED[label])
                top = top.join(usable.select("doc_id"), "doc_id", "left_anti").orderBy(F.desc("sure"), "hash").limit(HANDED[label])
                free = top if free is None else free.union(top)
        more: tuple[dict, dict] = ({}, {})
        for r in sorted(free.collect(), key=lambda r: (r.sure, r.hash)):  # 2 x the sum of HANDED at most
            more[1 - r.view][r.hash] = (_unpacked(r.views), r.y)  # from one view to the other
        given = tuple([(v, label) for _, (v, label) in sorted(x.items())] for x in more)
        machine.fit(rows, y, given)
    return machine


def score(docs: DataFrame, machine: CoTrained, prefix: str = "") -> DataFrame:
    """docs with p_content, p_page and quality, the probability of good quality by both views; `prefix` goes before these
    names, which docs must not have. A null text counts as empty; every row stays."""
    names, new_names = list(docs.columns), [prefix + c for c in ("p_content", "p_page", "quality")]

    def run(batches):
        for batch in batches:
            for part, views in _views(batch):
                new = [pa.array(1 / (1 + np.exp(-z))) for z in machine.logits(views)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, *new_names])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, " + ", ".join(f"`{c}` double" for c in new_names))


def op7_co_training(spark, sf_dir: str) -> DataFrame:
    """All documents' quality by both views. Null and empty texts are scored as empty; repeated rows alike; without labels all
    are good; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine).select("doc_id", "p_content", "p_page", F.col("quality").alias("score"), (F.col("quality") >= REJECT).alias("kept"))
