"""Per-document structural furniture, as column expressions: byline titles, attribution preambles, leading stamps,
disclaimers, and line furniture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import PARAMS

# Patterns and word lists that results depend on.
BYLINE = r"^([A-Z][\w'’.-]*(?:\s+[A-Z][\w'’.-]*){1,3}):\s+(\S.*)$"
NOT_NAMES = """summary release paper report review update outlook statement minutes notes brief briefing chapter part
volume appendix box table figure session panel chart special focus spotlight editorial commentary
the a an new press executive working policy annual quarterly monthly weekly interim final
overview introduction conclusion abstract highlights remarks speech interview testimony address""".split()
PLACES = """new york hong kong south north korea sudan africa saudi arabia puerto rico united states kingdom nations
middle east latin america european union euro area san francisco los angeles el salvador sri lanka
costa rica sierra leone cape verde ivory coast czech republic central western eastern southern northern
sub saharan asia pacific atlantic mediterranean gulf""".split()
KIND = (
    r"(?:speech|interview|remarks|address|statement|keynote(?:\s+\w+)?|lecture|welcome\s+address|opening\s+(?:remarks|statement)|"
    r"introductory\s+(?:remarks|statement)|panel\s+(?:remarks|contribution)|testimony|presentation|dinner\s+(?:speech|remarks)|text\s+of)"
)
ATTRIBUTION = rf"(?:\b{KIND}\b[^.]{{0,400}}?\bby\b|\b{KIND}\b\s+(?:with|of|in)\b)"
MONTH = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
DATE = rf"(?:{MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{MONTH}\.?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})"
LEADING_DATE = rf"^\s*(?:published(?:\s+on)?\s*:?\s*)?{DATE}\b[\s,:.–—-]*"
LEADING_PUBLISHED = r"^\s*published(?:\s+on)?\s*:\s*"
LEADING_CREDIT = r"^\s*(?:editors?'?\s+note|editor'?s\s+note|author'?s\s+note|disclaimer|acknowledgement?s?)\s*[:\-].{0,300}?[.!?]\s+"
DISCLAIMER = (
    r"(?:the\s+)?(?:views?|opinions?|analysis(?:\s+and\s+conclusions?)?)\s+(?:expressed|presented|set\s+forth)\b[^.]{0,320}?\bnot\s+necessarily\b[^.]{0,180}?\."
)
MASTHEAD = (
    r"(?:\bISSN\b[\s:]*\d{4}-?\d{3}[\dX]\b|\b(?:IMF|BIS|ECB|OFR|CBO|NBER)\s+working\s+papers?\s+(?:describe|are|should)\b[^.]{0,260}?\."
    r"|\bworking\s+papers?\s+describe\s+research\s+in\s+progress\b[^.]{0,260}?\.)"
)
PAGE_NUMBER = r"^\s*(?:-\s*)?\d{1,4}(?:\s*-)?\s*$"
PAGE_OF = r"^\s*page\s+\d+(?:\s+of\s+\d+)?\s*$"
REFERENCES = r"^\s*(?:references|reference\s+list|bibliography|works\s+cited|end\s*notes|foot\s*notes|notes)\s*:?\s*$"
METADATA = (
    r"^\s*(?:jel\s+(?:classification|codes?|no\.?)\b|key\s?words?\s*[:\-]|(?:doi|https?|www\.)\S*|(?:available|retrieved|downloaded|accessed)\s+(?:at|from|on)\b"
    r"|electronic\s+copy\s+available\s+at\b|for\s+(?:media|press)\s+(?:inquiries|enquiries|information)\b|\S+@\S+\.\S+\s*$)"
)
#: Java's classes made those of Unicode, letters of either case.
ANY, ANY_CASE, ANY_CASE_ALL = "(?U)", "(?Ui)", "(?Uis)"


def byline(title: Column, body: Column) -> Column:
    """struct(title, speaker): a title "Speaker Name: Rest" split, where the name's last word stands in the body's first
    400 characters; speaker is null otherwise."""
    flat = X.strip(title)
    speaker, rest = X.strip(F.regexp_extract(flat, ANY + BYLINE, 1)), X.strip(F.regexp_extract(flat, ANY + BYLINE, 2))
    tokens = F.transform(X.words(F.lower(speaker)), lambda t: F.regexp_replace(t, r"^[.,]+|[.,]+$", ""))
    surname = F.element_at(tokens, -1)
    bad = F.arrays_overlap(tokens, F.array(*(F.lit(x) for x in sorted({*NOT_NAMES, *PLACES}))))
    good = (speaker != "") & ~bad & (F.length(surname) >= 3) & F.contains(F.lower(F.substring(body, 1, 400)), surname)
    good = F.coalesce(good, F.lit(False))
    return F.struct(F.when(good, rest).otherwise(title).alias("title"), F.when(good, speaker).alias("speaker"))


def preamble(body: Column, title: Column) -> Column:
    """The body without its title's repeat and, where one starts in the first 120 of 600 characters, the attribution
    sentence up to a sentence's end within 800."""
    lead = r"(?U)^\s+"
    text, flat = F.regexp_replace(body, lead, ""), X.strip(title)
    repeats = (flat != "") & F.startswith(F.lower(text), F.lower(flat))
    text = F.when(repeats, F.regexp_replace(F.substr(text, F.length(flat) + 1), r"^[ \t\n:—–-]+", "")).otherwise(text)
    before = F.regexp_extract(F.substring(text, 1, 600), rf"(?Uis)^(.*?)({ATTRIBUTION})", 1)
    has = F.regexp_like(F.substring(text, 1, 600), F.lit(ANY_CASE + ATTRIBUTION)) & (F.length(before) < 120)
    rest = F.substr(text, F.length(before) + 1)
    head = F.regexp_extract(F.substr(rest, F.lit(1), 800 - F.length(before)), r'(?Us)^(.*?\.\s+)(?=[A-Z*“"(])', 1)
    return F.when(has & (head != ""), F.regexp_replace(F.substr(rest, F.length(head) + 1), lead, "")).otherwise(text)


def _if_new_sentence(text: Column, rest: Column) -> Column:
    """rest, if it is shorter and starts a sentence; else text."""
    bare = F.regexp_replace(rest, r"^[ \t\n:—–.-]+", "")
    return F.when(rest == text, text).when(bare.rlike(r"""(?U)^(?:$|[\p{Lu}\d"'“‘(])"""), bare).otherwise(text)


def leading(body: Column, title: Column) -> Column:
    """The body without, at its very start, the title, a date stamp, "Published:" and an editorial credit: each only where a
    new sentence follows."""
    text, flat = F.regexp_replace(body, r"(?U)^\s+", ""), X.strip(title)
    echo = (F.length(flat) >= 8) & F.startswith(F.lower(text), F.lower(flat))
    text = _if_new_sentence(text, F.when(echo, F.substr(text, F.length(flat) + 1)).otherwise(text))
    for pattern in (LEADING_DATE, LEADING_PUBLISHED, LEADING_CREDIT):
        text = _if_new_sentence(text, F.regexp_replace(text, ANY_CASE_ALL + pattern, ""))
    text = F.regexp_replace(text, r"(?U)^\s+", "")
    return F.when(text == "", body).otherwise(text)


def disclaimers(body: Column) -> Column:
    """struct(body, n): disclaimers and mastheads removed anywhere, and how many."""
    n = F.regexp_count(body, F.lit(ANY_CASE + DISCLAIMER)) + F.regexp_count(F.regexp_replace(body, ANY_CASE + DISCLAIMER, " "), F.lit(ANY_CASE + MASTHEAD))
    text = F.regexp_replace(F.regexp_replace(body, ANY_CASE + DISCLAIMER, " "), ANY_CASE + MASTHEAD, " ")
    return F.struct(F.when(n > 0, X.strip(F.regexp_replace(text, "[ \t]{2,}", " "))).otherwise(body).alias("body"), n.alias("n"))


def line_rows(articles: DataFrame, words: int = PARAMS.running_line_words, repeats: int = PARAMS.running_line_repeats, tail: float = PARAMS.reference_tail) -> DataFrame:
    """(article_id, i, line, reason): each line of a body with why it goes (null: it stays). Bodies of fewer than four lines
    stay whole. All is within a document, so one shuffle by document serves."""
    lines = articles.select("article_id", F.posexplode(F.split("body", "\n")).alias("i", "line"))
    key = X.strip(F.regexp_replace(F.lower("line"), X.SPACES, " "))
    lines = lines.withColumn("key", key).withColumn("short", (F.col("key") != "") & (F.size(F.split("key", " ")) <= words))
    doc = W.partitionBy("article_id")
    lines = lines.withColumn("n", F.count("*").over(doc)).withColumn("same", F.count_if("short").over(W.partitionBy("article_id", "key")))
    heading = F.col("line").rlike(ANY_CASE + REFERENCES) & (F.col("i") >= F.floor(F.col("n") * F.lit(tail)))
    lines = lines.withColumn("cut", F.min(F.when(heading, F.col("i"))).over(doc))
    reason = (
        F.when(F.col("n") < 4, None)
        .when(F.col("i") >= F.col("cut"), "references")
        .when(F.col("line").rlike(ANY + PAGE_NUMBER) | F.col("line").rlike(ANY_CASE + PAGE_OF), "page")
        .when(F.col("short") & (F.col("same") >= repeats), "running")
        .when(F.col("line").rlike(ANY_CASE + METADATA), "metadata")
    )
    return lines.select("article_id", "i", "line", reason.alias("reason"))


def line_pass(articles: DataFrame) -> DataFrame:
    """(article_id, body, dropped, references) after the line pass."""
    return line_rows(articles).groupBy("article_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.struct("i", "line")))), lambda x: x["line"]), "\n").alias("body"),
        F.count("reason").alias("dropped"),
        F.coalesce(F.bool_or(F.col("reason") == "references"), F.lit(False)).alias("references"),
    )


def clean(articles: DataFrame, byline_sources: tuple[str, ...] = ("bis",)) -> DataFrame:
    """articles (article_id, source_id, title, body[, author]) after all steps in their order, with each step's count.
    Ids should be distinct."""
    known = articles["author"] if "author" in articles.columns else F.lit(None).cast("string")
    rows = articles.withColumn("__a", known).withColumn("__by", F.col("source_id").isin(*byline_sources))
    rows = rows.withColumn("__s", F.when(F.col("__by"), byline(F.col("title"), F.col("body"))).otherwise(F.struct(F.col("title"), F.lit(None).cast("string").alias("speaker"))))
    rows = rows.withColumn("title", F.col("__s.title")).withColumn("speaker", F.col("__s.speaker"))
    rows = rows.withColumn("author", F.coalesce(F.nullif("__a", F.lit("")), "speaker")).withColumn("__b0", F.col("body"))
    rows = rows.withColumn("__b1", F.when(F.col("__by"), preamble(F.col("__b0"), F.col("title"))).otherwise(F.col("__b0")))
    rows = rows.withColumn("__b2", leading(F.col("__b1"), F.col("title"))).withColumn("__d", disclaimers(F.col("__b2"))).withColumn("body", F.col("__d.body"))
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+", "")
    rows = rows.withColumn("n_byline", F.col("speaker").isNotNull().cast("int")).withColumn("n_preamble", (bare("__b1") != bare("__b0")).cast("int"))
    rows = rows.withColumn("n_leading", (bare("__b2") != bare("__b1")).cast("int")).withColumn("n_disclaimers", F.col("__d.n"))
    lines = line_pass(rows.select("article_id", "body")).select("article_id", F.col("body").alias("__l"), F.col("dropped").alias("n_lines"), F.col("references").cast("int").alias("n_references"))
    out = rows.join(lines, "article_id", "left").withColumn("body", F.when(F.col("n_lines") > 0, F.col("__l")).otherwise(F.col("body")))
    return out.drop("__a", "__by", "__s", "__b0", "__b1", "__b2", "__d", "__l")


def report(cleaned: DataFrame) -> DataFrame:
    """One row of sums over all articles."""
    steps = ["n_byline", "n_preamble", "n_leading", "n_disclaimers", "n_lines", "n_references"]
    touched = sum((F.col(c) for c in steps[:5]), F.lit(0)) > 0
    return cleaned.agg(F.count("*").alias("n_articles"), *(F.sum(c).cast("long").alias(c) for c in steps), F.count_if(touched).alias("n_modified"))
