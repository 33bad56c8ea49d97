"""Queries of record rules, set operations and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as Y
from ..operators import series as S
from ..operators import signals as G
from ..operators import sources as R
from ..operators import volume as V
from ..sources import tables as T
from .registry import query
from .signals import EVENTS_SQL, _sunday
from .text import ART
from .volume import VOL

RULES = [(r"/en/", "english"), (r"page=", "listing"), (r"\.org", "org"), (r"#", "anchor")]


@query(
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 'english' WHEN regexp_matches(url, 'page=') THEN 'listing' WHEN regexp_matches(url, '\.org') THEN 'org' WHEN regexp_matches(url, '#') THEN 'anchor' ELSE 'other' END AS section,
regexp_replace(url, '\.pdf$', '.htm') AS canonical FROM pages"""
)
def url_sections(spark, d):
    """Sections of addresses, by the first rule that matches."""
    return T.table(spark, d, "pages").select("page_id", R.first_match(F.col("url"), RULES, "other").alias("section"), F.regexp_replace("url", r"\.pdf$", ".htm").alias("canonical"))


@query("SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1")
def first_of_host(spark, d):
    """The first page of each host."""
    rows = T.table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), "page_id")
    return R.once(rows, "host", "page_id")


@query("SELECT c_custkey, contains(title, 'Under') OR contains(title, 'Deputy') AS held_back FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Under Secretary' WHEN 1 THEN 'Secretary' ELSE 'Deputy' END AS title FROM customer)")
def role_guard(spark, d):
    """Records held back by their speaker's role."""
    title = F.when(F.col("c_custkey") % 3 == 0, "Under Secretary").when(F.col("c_custkey") % 3 == 1, "Secretary").otherwise("Deputy")
    return T.table(spark, d, "customer").select("c_custkey", R.held_back(title).alias("held_back"))


@query(
    """SELECT CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS "F", round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS "O", round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 6) AS "P", CAST(NULL AS DOUBLE) AS "X" FROM orders GROUP BY 1"""
)
def wide_series(spark, d):
    """Several series side by side, one of them without rows."""
    rows = T.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("series"), F.col("o_orderdate").cast("date").alias("day")).agg(F.round(F.avg("o_totalprice"), 6).alias("value"))
    return R.wide(rows, ["F", "O", "P", "X"])


@query("SELECT 'status' AS key, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def source_totals(spark, d):
    """Counts by each of two columns."""
    return R.totals(T.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), "status", "priority")


@query(f"{VOL} SELECT source_id, max(day) AS last FROM vol GROUP BY 1")
def source_frontier(spark, d):
    """Sources' last days."""
    return R.frontier(T.volume(spark, d))


@query(
    """SELECT id, CASE WHEN l.id IS NULL THEN 'only right' WHEN r.id IS NULL THEN 'only left' ELSE 'both' END AS side
FROM (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL) l FULL JOIN (SELECT DISTINCT doc_id AS id FROM labels WHERE doc_id IS NOT NULL) r USING (id)"""
)
def known_and_missing(spark, d):
    """Ids in both lists, and those that one lacks."""
    known, wanted = (T.table(spark, d, name).select(F.col("doc_id").alias("id")).where("id is not null").distinct() for name in ("documents", "labels"))
    rows = known.withColumn("l", F.lit(True)).join(wanted.withColumn("r", F.lit(True)), "id", "full")
    return rows.select("id", F.when(F.col("l").isNull(), "only right").when(F.col("r").isNull(), "only left").otherwise("both").alias("side"))


@query(f"WITH {EVENTS_SQL} SELECT event_date, count(*) AS n FROM (SELECT event_date FROM ev UNION ALL SELECT event_date FROM ev WHERE event_label LIKE 'CPI%') GROUP BY 1")
def calendar_union(spark, d):
    """Calendars put together, events that occur in both kept twice."""
    events = G.calendar_events(spark, "1995-01-01", "2001-12-31").select("event_date", "event_label")
    return events.unionAll(events.where("event_label like 'CPI%'")).groupBy("event_date").agg(F.count("*").alias("n"))


@query(
    f"""{ART}, w AS (SELECT CAST(article_id AS BIGINT) AS id, list_distinct(regexp_split_to_array(lower(body), '[^\\p{{L}}]+')) AS w FROM art),
p AS (SELECT a.id, len(list_intersect(a.w, b.w)) AS both_n, len(list_distinct(list_concat(a.w, b.w))) AS any_n FROM w a JOIN w b ON b.id = a.id + 1)
SELECT id, CAST(both_n AS INTEGER) AS both_n, CAST(any_n AS INTEGER) AS any_n, round(coalesce(both_n / nullif(any_n, 0), 0), 6) AS jaccard FROM p"""
)
def set_sizes(spark, d):
    """Shared and joint words of neighbours."""
    words = F.array_distinct(F.split(F.lower("body"), r"[^\p{L}]+"))
    rows = T.articles(spark, d).select(F.col("article_id").cast("long").alias("id"), words.alias("w"))
    pairs = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("w").alias("v")), "id")
    both, joint = F.size(F.array_intersect("w", "v")), F.size(F.array_union("w", "v"))
    return pairs.select("id", both.alias("both_n"), joint.alias("any_n"), F.round(F.coalesce(F.try_divide(both, joint), F.lit(0.0)), 6).alias("jaccard"))


@query(
    f"""{VOL}, s AS (SELECT topic, {_sunday('day')} AS week, CAST(count(*) AS DOUBLE) AS v FROM vol GROUP BY 1, 2),
w AS (SELECT topic, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM s GROUP BY topic) SELECT topic, week, coalesce(v, 0) AS value FROM w LEFT JOIN s USING (topic, week)"""
)
def sunday_week_sums(spark, d):
    """Weekly sums of each topic, silent weeks 0."""
    return V.sunday_weeks(T.volume(spark, d).withColumn("one", F.lit(1.0)), "one", "sum", "topic")


@query(
    """WITH x AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS t FROM part)
SELECT id, round(20 / (1 + exp(-0.3 * (t - 25))), 6) AS logistic, round(300 * 0.21 * 0.21 / 0.01 * exp(-0.21 * t) / pow(1 + 20 * exp(-0.21 * t), 2), 6) AS bass,
round(CASE WHEN t / 10 > 1 THEN ln(t / 10) / (0.1 + t / 100) ELSE 0 END, 6) AS peak, CASE WHEN t > 5 THEN round(10 + 6 + 24 / (t - 4), 6) END AS aicc FROM x"""
)
def formulas(spark, d):
    """Curves and measures as expressions."""
    t = F.col("p_size").cast("double")
    lit = lambda v: F.lit(float(v))
    aicc = Y.aicc(lit(-5), 3, t)
    return T.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.round(Y.logistic(t, lit(20), lit(0.3), lit(25)), 6).alias("logistic"),
        F.round(Y.bass(t, lit(300), lit(0.01), lit(0.2)), 6).alias("bass"),
        F.round(Y.bass_peak(lit(0.1), t / 100), 6).alias("peak"),
        F.when(t > 5, F.round(aicc, 6)).alias("aicc"),
    )


@query(
    """WITH x AS (SELECT o_orderpriority AS k, o_totalprice AS y, 1000 + 145000.0 AS f FROM orders)
SELECT k, round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2 FROM x GROUP BY 1"""
)
def fit_quality(spark, d):
    """Share of variance that a constant explains, by group."""
    rows = T.table(spark, d, "orders").withColumn("f", F.lit(146000.0))
    return rows.groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(Y.r_squared(F.col("o_totalprice"), F.col("f")), 6).alias("r2"))


@query(None)
def surrogates(spark, d):
    """How rarely a topic's shifted series correlates with the level series as much as it does unshifted."""
    from .series import _market_pairs

    return S.surrogates(_market_pairs(spark, d))
