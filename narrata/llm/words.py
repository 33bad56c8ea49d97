"""Words, shingles and their hashes over the raw UTF-8 bytes of an Arrow batch, without a loop per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. A word's hash is a polynomial
over random values of its bytes modulo 2**64, finished with a mixer; equal words have equal hashes on
every machine, as the random values come from a fixed seed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_STEP = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(0, 2**63)) * 2 + 1
_BACK = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SEGMENT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= SEGMENT + 1:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Prefix:
    """Hashes of any spans of some bytes."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[raw] * _power(_BASE, n + 1)[:n], out=self.sums[1:])
        self.back = _power(_BACK, n + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def raw_texts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and each row's bounds in them; null counts as empty."""
    array = array.cast(pa.large_string()).fill_null("") if array.null_count else array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word runs over a row's bound."""
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    change = inside[1:] != inside[:-1]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    cut = cut[inside[cut] & inside[cut + 1]]
    if len(cut):
        edges = np.sort(np.concatenate([np.flatnonzero(change), np.repeat(np.unique(cut), 2)]))
    else:
        edges = np.flatnonzero(change)
    return edges[::2], edges[1::2]


def segments(raw: np.ndarray):
    """Bounds of parts of about SEGMENT bytes, cut only next to a space (or where a word is longer, after it)."""
    first = 0
    while len(raw) - first > SEGMENT:
        gaps = np.flatnonzero(_SPACE[raw[first : first + SEGMENT]])
        if len(gaps):
            last = first + int(gaps[-1]) + 1
        else:
            gaps = np.flatnonzero(_SPACE[raw[first + SEGMENT :]])
            last = first + SEGMENT + int(gaps[0]) + 1 if len(gaps) else len(raw)
        yield first, last
        first = last
    yield first, len(raw)


def word_hashes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, in order, and the index of each row's first word (one more at the end)."""
    raw, bounds = raw_texts(array)
    out, starts = [], []
    for first, last in [(0, len(raw))] if len(raw) <= 2 * SEGMENT else segments(raw):
        part = raw[first:last]
        inner = bounds[(bounds > first) & (bounds < last)] - first
        a, b = word_spans(part, np.concatenate([[0], inner, [len(part)]]))
        out.append(Prefix(part).hashes(a, b))
        starts.append(a + first)
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.searchsorted(at, bounds)


def shingles(array: pa.Array, k: int) -> list[np.ndarray]:
    """Each row's distinct k-word shingle hashes, sorted; with fewer words, one of the whole sequence; without words none."""
    hashes, first = word_hashes(array)
    n = len(hashes)
    if n >= k:
        whole = np.zeros(n - k + 1, np.uint64)
        for t in range(k):
            whole += hashes[t : n - k + 1 + t] * _STEP[t]
        whole = mix(whole)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([np.sum(hashes[a:b] * _STEP[: b - a])], np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def telling_terms(found: np.ndarray, rows: tuple[int, int], most: int, least_chi: float = 10.8) -> np.ndarray:
    """Terms (sorted) whose presence tells two labels apart: of found[label, term], the numbers of rows with the term, out
    of rows[label]. Chi-square of at least `least_chi` (a chance in a thousand), in four rows or more; the `most` largest."""
    b, a = found.astype(np.float64)
    n0, n1 = rows
    n, both = n0 + n1, a + b
    spread = both * (n - both) * n1 * n0
    chi = np.divide(n * (a * (n0 - b) - b * (n1 - a)) ** 2, spread, out=np.zeros(len(a)), where=spread > 0)
    good = np.flatnonzero((chi >= least_chi) & (both >= 4))
    return np.sort(good[np.argsort(-chi[good], kind="stable")[:most]])
