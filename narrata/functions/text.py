"""Text as column expressions; character classes are Unicode-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"


def words(text: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Segments that end in ., ! or ? before white space; the mark stays."""
    parts = F.split(strip(text), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def match_key(sentence: Column) -> Column:
    """Lower case, single spaces, no non-word characters at the ends."""
    flat = strip(F.regexp_replace(F.lower(sentence), SPACES, " "))
    return F.regexp_replace(flat, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def embedding_text(title: Column, body: Column) -> Column:
    """'title. body', or whichever isn't empty."""
    t, b = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(body, F.lit("")))
    return F.when((t != "") & (b != ""), F.concat(t, F.lit(". "), b)).when(t != "", t).otherwise(b)


def excerpt(text: Column, limit: int) -> Column:
    """A flat text, cut at a word's end within `limit` characters and marked where it was cut."""
    flat = strip(F.regexp_replace(text, SPACES, " "))
    head = F.substring(flat, 1, limit)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def slug(text: Column, limit: int = 60) -> Column:
    """Lower-case letters and digits joined by hyphens."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(flat, 1, limit)


def display_label(label: Column) -> Column:
    """A cluster's raw label without its number, underscores as commas."""
    return F.regexp_replace(F.regexp_replace(label, r"^-?\d+_", ""), "_", ", ")


def html_text(html: Column) -> Column:
    """Visible text: navigation, scripts, styles, headers, footers and comments go, tags become spaces."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "footer", "header"):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(bare, SPACES, " "))


def article_id(source: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", source, url), 256), 1, 16)


def flexible_date(text: Column) -> Column:
    """A date in one of several written forms, tried in order, or the first ISO date inside the text."""
    forms = ["yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy", "MM/dd/yyyy", "yyyy/MM/dd"]
    tries = [F.try_to_timestamp(strip(text), F.lit(f)).cast("date") for f in forms]
    iso = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(*tries, F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd")).cast("date"))
