"""Secrets in whole texts: three fixed patterns, and values next to words such as "password" that are
dear to guess. The price of a value is the least log10 of guesses over its cuts into common words,
dates, repeats, keyboard walks or sequences, and brute-force spans (dynamic programming). Words are those of a
ranked vocabulary file; a value that only a verb joins to its name ("the token is ...") must also look unlike
prose."""

from __future__ import annotations

import functools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ranks

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Contexts of the added kind: a credential's name, then a sign or a verb, perhaps a scheme's word, then the value.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass ?(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|login|auth(?:orization)?|bearer|(?:api|access|private|client)[-_ ]?(?:key|secret))"""
    r"""["']?\x20*(?:([:=]>?)|\bis\b|\bwas\b)\x20*["']?(?:(?:bearer|basic|digest|token)\x20+["']?)?(?!(?:bearer|basic|digest|token)\x20)([^\s"'`,;<>()\[\]{}]{6,})""",
    re.I | re.A,
)
#: What a value behind a verb shows that prose doesn't: a digit, a sign within (not a hyphen or an apostrophe), a capital behind a small letter.
UNLIKE_PROSE = re.compile(r"[0-9]|\w[^\w\s.,:;!?'’-]+\w|_|[a-z][A-Z]")
TRAILING = ".,:;!?…"
#: A rejected value may hold a further context, whose value is a tail of it. Longer ones are cheap only as they repeat themselves: their tails
#: are not priced again, which keeps the work linear.
TAILS = 256
CONTEXT_HINTS = ("pass", "pwd", "pin", "secret", "token", "credential", "login", "auth", "bearer", "key")
KINDS = ("assign", "access", "hex", "guess")
#: The price from which a value counts.
LEAST = 10.0

# Common password words, most used first; rank is their price.
COMMON = """password qwerty dragon monkey letmein football baseball welcome master shadow michael jennifer sunshine
princess admin login superman batman trustno hunter iloveyou charlie secret summer winter spring autumn ashley
jordan thomas computer internet flower freedom whatever killer pepper ginger cookie cheese banana orange purple
silver golden diamond hello love money jesus angel mustang harley ranger soccer hockey tigger buster george andrew
daniel jessica joshua matthew robert access test user guest root pass word change default temp example sample
changeme the and for you with this that from have blue green black white""".split()
# Rows of the common keyboard; each stands half a key to the right of the one above.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("013457@$!", "oleastasi")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?[01]?\d[-/._]?[0-3]?\d|[0-3]?\d[-/._]?[01]?\d[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
REPEAT = re.compile(r"(.{1,8}?)\1+", re.S)
#: The longest word that is looked up.
LONGEST = 18
#: Each segment beyond the first also costs its place; each turn of a walk the choice of a way.
JOIN, TURN = math.log10(2), math.log10(6)
_KEYS = {c: (r, 2 * i + r) for r, row in enumerate(ROWS) for i, c in enumerate(row)}


@functools.cache
def prices(path: str | None) -> dict[str, float]:
    """log10 of guesses by word: the common passwords first, then the words of a vocabulary of byte-level BPE ranks, in the
    order of its ranks (tokens that are a space and small or capital letters)."""
    words = dict.fromkeys(COMMON)
    if path:
        for token in sorted(ranks(path), key=ranks(path).get):
            if token[:1] == b" " and len(token) > 3 and token[1:].isalpha():
                words.setdefault(token[1:].decode().lower())
    return {w: math.log10(i + 2) for i, w in enumerate(words) if len(w) <= LONGEST}


def _alphabet(value: str) -> float:
    sizes = ((r"[0-9]", 10), (r"[a-z]", 26), (r"[A-Z]", 26), (r"[^0-9a-zA-Z]", 33))
    return math.log10(sum(n for p, n in sizes if re.search(p, value)))


def _way(a: str, b: str) -> tuple[int, int] | None:
    """The step from a key to its neighbour, of which it has six, or to itself."""
    if a in _KEYS and b in _KEYS:
        down, right = _KEYS[b][0] - _KEYS[a][0], _KEYS[b][1] - _KEYS[a][1]
        if (down, abs(right)) in ((0, 0), (0, 2), (1, 1), (-1, 1)):
            return down, right
    return None


def walks(value: str) -> list[tuple[int, int, float]]:
    """Longest runs of three keys or more that are neighbours on the keyboard, at the price of a start, a length and the turns;
    and of letters or digits that follow each other in order, either way."""
    low, out, start, turns, way = value.lower(), [], 0, 0, None
    for i in range(1, len(low) + 1):
        step = _way(low[i - 1], low[i]) if i < len(low) else None
        if step is None:
            if i - start >= 3:
                out.append((start, i, math.log10(len(_KEYS) * (i - start)) + turns * TURN))
            start, turns, way = i, 0, None
        else:
            turns += way is not None and step != way
            way = step
    start, way = 0, 0
    for i in range(1, len(low) + 1):
        step = ord(low[i]) - ord(low[i - 1]) if i < len(low) and low[i - 1 : i + 1].isalnum() else 0
        if abs(step) != 1 or way not in (0, step):
            if i - start >= 3:
                out.append((start, i, math.log10(2 * 36 * (i - start))))
            start, way = (i - 1, step) if abs(step) == 1 else (i, 0)
        else:
            way = step
    return out


def segments(value: str, words: str | None = None, depth: int = 0) -> list[tuple[int, int, float]]:
    """(start, end, price) of all spans of a value that are cheaper to guess than by brute force."""
    low = value.lower()
    plain, known, out = low.translate(LEET), prices(words), []
    for i in range(len(value)):
        for j in range(i + 3, min(len(value), i + LONGEST) + 1):
            price = known.get(low[i:j])
            if price is None and (price := known.get(plain[i:j])) is not None:
                price += JOIN
            if price is not None:
                out.append((i, j, price + (JOIN if value[i:j] != low[i:j] else 0)))
    for m in DATE.finditer(value):
        out.append((*m.span(), 2.0 if m.end() - m.start() == 4 else math.log10(365.25 * 120)))
    out += walks(value)
    if depth < 2:
        for m in REPEAT.finditer(value):
            out.append((*m.span(), guess_cost(m[1], words, depth + 1) + math.log10((m.end() - m.start()) / len(m[1]))))
    return out


def guess_cost(value: str, words: str | None = None, depth: int = 0) -> float:
    """log10 of the guesses for a value; 0 for the empty one. words: the path of a vocabulary. Linear in the value's length."""
    if not value:
        return 0.0
    n, each = len(value), _alphabet(value)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for a, b, price in segments(value, words, depth):
        ends[b].append((a, price))
    whole, brute = [0.0] * (n + 1), [math.inf] * (n + 1)  # least price up to here; the same, if brute force ends here
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], whole[j - 1] + (JOIN if j > 1 else 0)) + each
        whole[j] = min([brute[j], *(whole[i] + price + (JOIN if i else 0) for i, price in ends[j])])
    return whole[n]


def spans(text: str, least: float = LEAST, words: str | None = None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, price) by start, then kind. Positions are code points; the end is exclusive."""
    found: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end(), guess_cost(m[2], words)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        base = list(found)
        at = known = 0
        while m := CONTEXT.search(text, at):
            (a, b), at = m.span(2), m.start(2)
            value = m[2] if m[1] else m[2].rstrip(TRAILING)
            b = a + len(value)
            if b <= known or any(x <= a and b <= y for _, x, y, _ in base) or not (m[1] or UNLIKE_PROSE.search(value)):
                continue
            if (price := guess_cost(value, words)) >= least:
                found.append(("guess", a, b, price))
                at = b
            elif b - a > TAILS:
                known = b
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def vocabulary() -> str:
    """The path of the ranked words, on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_SPANS = "array<struct<kind:string,start:long,end:long,cost:double>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, words: str | None = None) -> DataFrame:
    """(doc_id, spans) for each row of docs; a null text counts as empty and has no spans. `least` is the price
    (log10 of guesses) from which a credential-context value counts; such values wholly inside a base span aren't repeated.
    `words` is the path of ranked words (unset: the public vocabulary's). Repeated rows and null ids give a row each; an
    empty table gives no rows; other columns are ignored."""
    words = words or vocabulary()

    def run(batches):
        for batch in batches:
            out = [[dict(zip(("kind", "start", "end", "cost"), x, strict=True)) for x in spans(t or "", least, words)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _TYPE)], names=["doc_id", "spans"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, spans {_SPANS}")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", least: float = LEAST, words: str | None = None) -> DataFrame:
    """docs with each span of `text` (overlapping ones as one) replaced by `mark`; null stays null, all rows and columns stay."""
    words = words or vocabulary()
    names, at = list(docs.columns), list(docs.columns).index(text)

    def clean(value: str | None) -> str | None:
        if not value or not (found := spans(value, least, words)):
            return value
        out, done = [], 0
        for _, a, b, _ in found:
            if a >= done:
                out += [value[done:a], mark]
            done = max(done, b)
        return "".join(out) + value[done:]

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(x) for x in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def op5_guess_cost_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in each document. A null text counts as empty, without spans; repeated rows and null ids
    give a row each; an empty table gives no rows."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("guess"),
    )
