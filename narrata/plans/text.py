"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import boilerplate as B
from ..operators import chunker as C
from ..operators import furniture as U
from ..sources import tables as T
from .registry import query

ART = "WITH " + T.ARTICLES_SQL
SPLIT = r"string_split(regexp_replace(trim(body, E' \t\n\r'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
KEY = r"regexp_replace(regexp_replace(trim(regexp_replace(lower(sentence), '\s+', ' ', 'g')), '^[^\p{L}\p{N}_]+', ''), '[^\p{L}\p{N}_]+$', '')"
COUNT = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> ''))"
SENTENCES = f"""sent0 AS (SELECT article_id, unnest({SPLIT}) AS sentence, generate_subscripts({SPLIT}, 1) - 1 AS pos FROM art),
sent AS (SELECT article_id, pos, trim(sentence, E' \\t\\n\\r') AS sentence, {KEY} AS key, {COUNT.format('sentence')} >= 6 AS eligible FROM sent0 WHERE trim(sentence, E' \\t\\n\\r') <> ''),
tem AS (SELECT key, count(DISTINCT article_id) AS df FROM sent WHERE eligible GROUP BY 1 HAVING count(DISTINCT article_id) >= 5)"""


@query(f"{ART}, {SENTENCES} SELECT key, df FROM tem")
def boilerplate_df(spark, d):
    """Sentences in five documents or more."""
    return B.templates(B.sentence_rows(T.articles(spark, d)), 5)


@query(f"{ART}, {SENTENCES} SELECT key, df FROM tem ORDER BY df DESC, key LIMIT 50")
def boilerplate_top(spark, d):
    """The 50 most frequent of them."""
    return B.templates(B.sentence_rows(T.articles(spark, d)), 5).orderBy(F.desc("df"), "key").limit(50)


@query(
    f"""{ART}, {SENTENCES}, m AS (SELECT s.*, t.key IS NOT NULL AND eligible AS gone FROM sent s LEFT JOIN tem t USING (key)),
k AS (SELECT article_id, count(*) FILTER (gone) AS removed, coalesce(string_agg(sentence, ' ' ORDER BY pos) FILTER (NOT gone), '') AS rest FROM m GROUP BY 1),
r AS (SELECT article_id, CASE WHEN k.removed > 0 THEN rest ELSE body END AS body, coalesce(k.removed, 0) AS removed FROM art LEFT JOIN k USING (article_id))
SELECT article_id, md5(body) AS body_md5, removed, removed > 0 AND {COUNT.format('body')} < 50 AS dropped FROM r"""
)
def boilerplate_strip(spark, d):
    """All articles without their templates."""
    out = B.strip_boilerplate(T.articles(spark, d), 5)
    return out.select("article_id", F.md5("body").alias("body_md5"), "removed", "dropped")


@query(f"{ART} SELECT article_id, CAST({COUNT.format('body')} AS INTEGER) AS word_count FROM art")
def word_count(spark, d):
    """White-space words of each article."""
    return T.articles(spark, d).select("article_id", X.word_count(F.col("body")).alias("word_count"))


@query("SELECT page_id, substr(sha256('site|' || url), 1, 16) AS article_id FROM pages")
def article_id(spark, d):
    """Stable ids of source and address."""
    return T.table(spark, d, "pages").select("page_id", X.article_id(F.lit("site"), F.col("url")).alias("article_id"))


CHUNKED = r"""w AS (SELECT article_id, body, list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '') AS w FROM art),
t AS (SELECT *, CASE WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 448) AS INTEGER) + 1 END AS chunk_total FROM w),
c0 AS (SELECT *, CAST(unnest(generate_series(0, chunk_total - 1)) AS INTEGER) AS chunk_index FROM t),
c AS (SELECT article_id, article_id || '_c' || lpad(CAST(chunk_index AS VARCHAR), 3, '0') AS chunk_id, chunk_index, CAST(chunk_total AS INTEGER) AS chunk_total, chunk_total > 1 AS is_chunked,
  CASE WHEN chunk_total = 1 THEN body ELSE array_to_string(w[chunk_index * 448 + 1 : chunk_index * 448 + 512], ' ') END AS body FROM c0)"""


@query(f"{ART}, {CHUNKED} SELECT chunk_id, chunk_index, chunk_total, is_chunked, md5(body) AS body_md5, CAST({COUNT.format('body')} AS INTEGER) AS word_count FROM c")
def chunks(spark, d):
    """All chunks."""
    return C.chunks(T.articles(spark, d)).select("chunk_id", "chunk_index", "chunk_total", "is_chunked", F.md5("body").alias("body_md5"), "word_count")


@query(f"{ART}, {CHUNKED} SELECT article_id, chunk_id FROM c WHERE chunk_index = 0")
def document_representative(spark, d):
    """Each article's first chunk."""
    return C.representatives(C.chunks(T.articles(spark, d))).select("article_id", "chunk_id")


@query(f"{ART}, {CHUNKED} SELECT article_id, md5(string_agg(body, ' ' ORDER BY chunk_index)) AS body_md5, count(*) AS n FROM c GROUP BY 1")
def fold_chunks(spark, d):
    """Articles joined again from their chunks."""
    rows = C.chunks(T.articles(spark, d)).withColumn("n", F.col("chunk_total").cast("long"))
    return C.fold(rows, "article_id").select("article_id", F.md5("body").alias("body_md5"), "n")


@query(
    r"""SELECT page_id, sha1(CASE WHEN t <> '' AND b <> '' THEN t || '. ' || b WHEN t <> '' THEN t ELSE b END) AS text_sha1
FROM (SELECT page_id, trim(url) AS t, trim(CASE WHEN page_id % 7 = 0 THEN '' ELSE html END, E' \t\n\r') AS b FROM pages)"""
)
def embedding_text_sha1(spark, d):
    """The digest of the text to encode."""
    body = F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("html"))
    return T.table(spark, d, "pages").select("page_id", F.sha1(X.embedding_text(F.col("url"), body)).alias("text_sha1"))


LINES = r"""ln0 AS (SELECT article_id, unnest(string_split(body, E'\n')) AS line, generate_subscripts(string_split(body, E'\n'), 1) - 1 AS i FROM {src}),
ln1 AS (SELECT *, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS key FROM ln0),
ln2 AS (SELECT *, key <> '' AND len(string_split(key, ' ')) <= 6 AS short FROM ln1),
ln3 AS (SELECT *, count(*) OVER (PARTITION BY article_id) AS n, count(*) FILTER (short) OVER (PARTITION BY article_id, key) AS same FROM ln2),
ln4 AS (SELECT *, min(CASE WHEN regexp_matches(line, '(?i){ref}') AND i >= floor(n * 0.6) THEN i END) OVER (PARTITION BY article_id) AS cut FROM ln3),
ln AS (SELECT article_id, i, line, CASE WHEN n < 4 THEN NULL WHEN i >= cut THEN 'references' WHEN regexp_matches(line, '{page}') OR regexp_matches(line, '(?i){of}') THEN 'page'
  WHEN short AND same >= 3 THEN 'running' WHEN regexp_matches(line, '(?i){meta}') THEN 'metadata' END AS reason FROM ln4)""".replace(
    "{ref}", U.REFERENCES
).replace("{page}", U.PAGE_NUMBER).replace("{of}", U.PAGE_OF).replace("{meta}", U.METADATA)
# Articles with furniture between their lines.
DRESSED = """dr AS (SELECT article_id, 'Page ' || article_id || E'\\nHead of page\\n' || body || E'\\nHead of page\\nJEL codes: E5\\nmail@example.com\\nHead of page\\n12\\nReferences\\nA. Author' AS body FROM art)"""


def _dressed(spark, d):
    body = F.concat(F.lit("Page "), "article_id", F.lit("\nHead of page\n"), "body", F.lit("\nHead of page\nJEL codes: E5\nmail@example.com\nHead of page\n12\nReferences\nA. Author"))
    return T.articles(spark, d).withColumn("body", body)


@query(f"{ART}, {DRESSED}, {LINES.replace('{src}', 'dr')} SELECT article_id, reason, count(*) AS n FROM ln WHERE reason IS NOT NULL GROUP BY 1, 2")
def furniture_lines(spark, d):
    """Lines that go, by reason."""
    return U.line_rows(_dressed(spark, d)).where("reason is not null").groupBy("article_id", "reason").agg(F.count("*").alias("n"))


@query(
    f"""{ART}, {DRESSED}, {LINES.replace('{src}', 'dr')} SELECT article_id, md5(coalesce(string_agg(line, E'\\n' ORDER BY i) FILTER (reason IS NULL), '')) AS body_md5,
count(reason) AS dropped, coalesce(bool_or(reason = 'references'), false) AS "references" FROM ln GROUP BY 1"""
)
def furniture_line_pass(spark, d):
    """Bodies after the line pass."""
    return U.line_pass(_dressed(spark, d)).select("article_id", F.md5("body").alias("body_md5"), "dropped", "references")


LEAD = "The views expressed here are those of the author and do not necessarily reflect those of the bank."


@query(
    f"""{ART}, x AS (SELECT article_id, body || ' {LEAD} ISSN: 1018-5941 ' || body AS body FROM art),
y AS (SELECT article_id, body, regexp_replace(body, '(?i){U.DISCLAIMER}', ' ', 'g') AS b1 FROM x),
z AS (SELECT article_id, body, len(regexp_extract_all(body, '(?i){U.DISCLAIMER}')) + len(regexp_extract_all(b1, '(?i){U.MASTHEAD}')) AS n, regexp_replace(b1, '(?i){U.MASTHEAD}', ' ', 'g') AS b2 FROM y)
SELECT article_id, CAST(n AS INTEGER) AS n, md5(CASE WHEN n > 0 THEN trim(regexp_replace(b2, '[ \\t]{{2,}}', ' ', 'g'), E' \\t\\n\\r') ELSE body END) AS body_md5 FROM z"""
)
def disclaimers(spark, d):
    """Disclaimers and mastheads removed from inside bodies."""
    body = F.concat("body", F.lit(f" {LEAD} ISSN: 1018-5941 "), "body")
    rows = T.articles(spark, d).select("article_id", U.disclaimers(body).alias("x"))
    return rows.select("article_id", F.col("x.n").alias("n"), F.md5("x.body").alias("body_md5"))


@query(
    r"""WITH x AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '^[\s,:.–—-]+', '') AS rest FROM documents)
SELECT doc_id, md5(trim(CASE WHEN regexp_matches(rest, '^[\p{Lu}\d"''“‘(]') THEN rest ELSE 'January 21, 2010. ' || text END, E' \t\n\r')) AS body_md5, 'John Smith' AS speaker FROM x"""
)
def leading_and_byline(spark, d):
    """A date stamp before each text taken off where a sentence follows, and a byline found in the text."""
    text = F.coalesce("text", F.lit(""))
    found = U.byline(F.lit("John Smith: A road ahead"), F.concat(F.lit("Speech by Mr Smith. "), text))
    body = X.strip(U.leading(F.concat(F.lit("January 21, 2010. "), text), F.lit("A road ahead")))
    return T.table(spark, d, "documents").select("doc_id", F.md5(body).alias("body_md5"), found["speaker"].alias("speaker"))


@query(None)
def furniture_clean(spark, d):
    """All furniture steps over all articles, with src1 as a source of bylines."""
    out = U.clean(_dressed(spark, d), ("src1",))
    return out.select("article_id", F.md5("body").alias("body_md5"), "speaker", "n_byline", "n_preamble", "n_leading", "n_disclaimers", "n_lines", "n_references")


@query(None)
def furniture_report(spark, d):
    """Sums over the furniture steps."""
    return U.report(U.clean(_dressed(spark, d), ("src1",)))


BARE = r"regexp_replace({}, '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')"
PAGE = "regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g')"
for _tag in ("script", "style", "nav", "footer", "header"):
    PAGE = BARE.replace("{tag}", _tag).format(PAGE)
PAGE = f"regexp_replace({PAGE}, '(?s)<[^>]*>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    PAGE = f"replace({PAGE}, '{_a}', '{_b}')"
PAGE = f"trim(regexp_replace({PAGE}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({PAGE}) AS text_md5, CAST(length({PAGE}) AS INTEGER) AS n FROM pages")
def page_text(spark, d):
    """Visible text of all pages."""
    text = X.html_text(F.col("html"))
    return T.table(spark, d, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).alias("n"))


@query(
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), '(^|\.)example\.com$') AS own FROM pages"""
)
def own_domain(spark, d):
    """Whether a page is on its source's host or under it."""
    host = F.parse_url("url", F.lit("HOST"))
    return T.table(spark, d, "pages").select("page_id", host.alias("host"), ((host == "example.com") | F.endswith(host, F.lit(".example.com"))).alias("own"))


@query(
    f"""{ART}, x AS (SELECT article_id, day, CASE CAST(article_id AS BIGINT) % 6 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%B %-d, %Y') WHEN 2 THEN strftime(day, '%-d %B %Y')
  WHEN 3 THEN strftime(day, '%m/%d/%Y') WHEN 4 THEN 'posted ' || strftime(day, '%Y-%m-%d') || ' at noon' ELSE 'no date' END AS text FROM art)
SELECT article_id, CASE WHEN text = 'no date' THEN NULL ELSE day END AS day FROM x"""
)
def flexible_dates(spark, d):
    """Dates written in several ways."""
    kind, day = F.col("article_id").cast("long") % 6, F.col("day")
    text = F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "MMMM d, yyyy")).when(kind == 2, F.date_format(day, "d MMMM yyyy"))
    text = text.when(kind == 3, F.date_format(day, "MM/dd/yyyy")).when(kind == 4, F.concat(F.lit("posted "), F.date_format(day, "yyyy-MM-dd"), F.lit(" at noon"))).otherwise("no date")
    return T.articles(spark, d).select("article_id", X.flexible_date(text).alias("day"))


@query(f"{ART} SELECT article_id FROM art WHERE day BETWEEN DATE '2012-01-01' AND DATE '2018-06-30'")
def date_range_filter(spark, d):
    """Articles within dates; unparseable ones drop out."""
    day = F.try_to_timestamp(F.substring(F.concat(F.col("day").cast("string"), F.lit("T00:00:00Z")), 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return T.articles(spark, d).where(day.between(F.lit("2012-01-01").cast("date"), F.lit("2018-06-30").cast("date"))).select("article_id")


@query(f"{ART} SELECT source_id, count(*) FILTER (source_id NOT IN ('src3', 'src7')) AS kept, count(*) FILTER (source_id IN ('src3', 'src7')) AS excluded FROM art GROUP BY 1")
def provenance_filter(spark, d):
    """Kept and excluded articles by source."""
    out = F.lower("source_id").isin("src3", "src7")
    return T.articles(spark, d).groupBy("source_id").agg(F.count_if(~out).alias("kept"), F.count_if(out).alias("excluded"))


@query(f"{ART} SELECT article_id FROM art WHERE regexp_matches(body, '(?i)licensed|password')")
def topic_regex_filter(spark, d):
    """Articles that match a pattern in any case."""
    return T.articles(spark, d).where(F.concat_ws(" ", "title", "body").rlike("(?i)licensed|password")).select("article_id")


@query(
    r"""WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE CASE WHEN contains(substr(t, 1, 120), ' ') THEN regexp_replace(substr(t, 1, 120), ' [^ ]*$', '') ELSE substr(t, 1, 120) END || '…' END AS excerpt FROM x"""
)
def excerpts(spark, d):
    """Flat heads cut at a word's end."""
    return T.table(spark, d, "documents").select("doc_id", X.excerpt(F.col("text"), 120).alias("excerpt"))


@query(r"SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM pages")
def slugs(spark, d):
    """File-name forms."""
    return T.table(spark, d, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@query(
    r"""SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(url), '[/?=&#.:]+'), lambda t: t <> '' AND NOT regexp_matches(t, '^(https?|www|com|org|net)$|\d')), ' ') AS terms FROM pages"""
)
def keyword_artifacts(spark, d):
    """Terms without address parts."""
    terms = F.filter(F.split(F.lower("url"), "[/?=&#.:]+"), lambda t: (t != "") & ~t.rlike(r"^(https?|www|com|org|net)$|\d"))
    return T.table(spark, d, "pages").select("page_id", F.array_join(terms, " ").alias("terms"))


@query(
    r"""WITH x AS (SELECT page_id, CAST(2000 + page_id % 40 AS VARCHAR) AS y FROM pages),
t AS (SELECT page_id, list_filter(list_transform(regexp_extract_all('report ' || '1887 ' || y || ' and 2011', '\b(\d{4})\b', 1), lambda v: CAST(v AS INTEGER)), lambda v: v BETWEEN 2010 AND 2030) AS ys FROM x)
SELECT page_id, CASE WHEN len(ys) > 0 THEN make_date(ys[1], 1, 1) END AS day FROM t"""
)
def year_fallback(spark, d):
    """The first year in a window, as its first day."""
    text = F.concat(F.lit("report 1887 "), (F.lit(2000) + F.col("page_id") % 40).cast("string"), F.lit(" and 2011"))
    years = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{4})\b"), F.lit(1)), lambda v: v.cast("int")), lambda v: v.between(2010, 2030))
    return T.table(spark, d, "pages").select("page_id", F.make_date(F.get(years, F.lit(0)), F.lit(1), F.lit(1)).alias("day"))


@query(
    """WITH x AS (SELECT doc_id, 2010 + doc_id % 5 AS year FROM documents),
r AS (SELECT doc_id, year, row_number() OVER (PARTITION BY year ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY year) AS n FROM x)
SELECT doc_id, CAST(make_date(year, 1, 1) + CAST(round_even((k + 0.5) / n * 364, 0) AS INTEGER) AS DATE) AS day FROM r"""
)
def date_by_rank(spark, d):
    """Documents that only have a year, spread over it by rank."""
    from ..operators.volume import spread_over_year

    rows = T.table(spark, d, "documents").select("doc_id", (F.lit(2010) + F.col("doc_id") % 5).cast("int").alias("year"))
    return spread_over_year(rows, "doc_id").select("doc_id", "day")


META = """x AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<meta name="release-date" content="2014-05-06">' WHEN 1 THEN '<time datetime="2015-07-08T10:00:00Z">x</time>'
  WHEN 2 THEN '<meta name="dcterms.date" content="2016-09-10">' ELSE '' END || html AS html FROM pages)"""


@query(
    f"""WITH {META} SELECT page_id, CAST(coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+release-date[^>]+content="(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''),
nullif(regexp_extract(html, '(?i)<time[^>]+datetime="(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]+dcterms[^>]+content="(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '')) AS DATE) AS day FROM x"""
)
def page_dates(spark, d):
    """Dates of pages: release-date, else time, else dcterms."""
    k = F.col("page_id") % 4
    head = F.when(k == 0, '<meta name="release-date" content="2014-05-06">').when(k == 1, '<time datetime="2015-07-08T10:00:00Z">x</time>').when(k == 2, '<meta name="dcterms.date" content="2016-09-10">').otherwise("")
    html = F.concat(head, "html")
    found = [F.nullif(F.regexp_extract(html, p + r'="(\d{4}-\d{2}-\d{2})', 1), F.lit("")) for p in ("(?i)<meta[^>]+release-date[^>]+content", "(?i)<time[^>]+datetime", "(?i)<meta[^>]+dcterms[^>]+content")]
    return T.table(spark, d, "pages").select("page_id", F.try_to_timestamp(F.coalesce(*found), F.lit("yyyy-MM-dd")).cast("date").alias("day"))
