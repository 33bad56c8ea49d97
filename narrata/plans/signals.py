"""Queries of the recency signals and the calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals as S
from ..operators import volume as V
from ..sources import tables as T
from .registry import query
from .volume import ADJ, VOL

CUSTOMER_VOL = VOL + """, cust AS (SELECT o_orderkey AS article_id, CAST(o_custkey AS INTEGER) AS topic, CAST(o_orderdate AS DATE) AS day FROM orders)"""


def _customers(spark, d):
    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_custkey").cast("int").alias("topic"), F.col("o_orderdate").cast("date").alias("day"))


def _sunday(x: str) -> str:
    return f"CAST(CAST(date_trunc('week', {x}) AS DATE) + 6 AS DATE)"


HEAT = f"""{VOL}, dly AS (SELECT topic, day, count(DISTINCT article_id) AS n FROM vol WHERE topic <> -1 GROUP BY 1, 2),
fr AS (SELECT max(day) AS frontier FROM dly),
wk AS (SELECT topic, {_sunday('day')} AS week, sum(n) AS n FROM dly GROUP BY 1, 2),
sp AS (SELECT topic, CAST(unnest(generate_series({_sunday('min(day)')}, (SELECT CAST({_sunday('frontier + 1')} - 7 AS DATE) FROM fr), INTERVAL 7 DAY)) AS DATE) AS week FROM dly GROUP BY topic),
x AS (SELECT topic, week, coalesce(n, 0) AS v, row_number() OVER (PARTITION BY topic ORDER BY week DESC) - 1 AS back FROM sp LEFT JOIN wk USING (topic, week)),
g AS (SELECT topic, count(*) AS weeks, avg(v) FILTER (back < 16) AS rm, sum(v) FILTER (back < 16) AS rs, avg(v) FILTER (back >= 16 AND back < 68) AS bm, stddev_samp(v) FILTER (back >= 16 AND back < 68) AS sd FROM x GROUP BY 1)"""


@query(
    f"""{HEAT}
SELECT topic, (rm - bm) / (sd / 4) >= 2 AND rs >= 3 AS is_heating, round((rm - bm) / (sd / 4), 3) AS z, CAST(rs AS BIGINT) AS recent_articles FROM g WHERE weeks >= 68 AND sd > 0"""
)
def corpus_heating(spark, d):
    """Topics' recent weeks against their baseline."""
    return S.corpus_heating(T.volume(spark, d))


@query(
    f"""{HEAT}
SELECT topic, round((rm - bm) / (sd / 4), 3) AS z, CAST(row_number() OVER (ORDER BY round((rm - bm) / (sd / 4), 3) DESC, topic) AS INTEGER) AS place FROM g WHERE weeks >= 68 AND sd > 0 AND (rm - bm) / (sd / 4) >= 0"""
)
def heating_list(spark, d):
    """Topics at or over their baseline, the hottest first: one row a topic, so one task ranks them."""
    from pyspark.sql import Window as W

    rows = S.corpus_heating(T.volume(spark, d)).where("z >= 0")
    return rows.select("topic", "z", F.row_number().over(W.orderBy(F.desc("z"), "topic")).alias("place"))


@query(
    f"""{VOL}, {ADJ}, a AS (SELECT topic, day, adjusted, (SELECT max(day) FROM adj WHERE topic <> -1) AS frontier FROM adj WHERE topic <> -1),
s AS (SELECT topic, (frontier - day) // 7 AS back, sum(adjusted) AS v FROM a GROUP BY 1, 2),
sp AS (SELECT topic, unnest(generate_series(0, max(back))) AS back FROM s GROUP BY 1),
x AS (SELECT topic, back, coalesce(v, 0) AS v FROM sp LEFT JOIN s USING (topic, back)),
g AS (SELECT topic, count(*) AS weeks, avg(v) FILTER (back < 16) AS rm, sum(v) FILTER (back < 16) AS rs, avg(v) FILTER (back >= 16 AND back < 68) AS bm, stddev_samp(v) FILTER (back >= 16 AND back < 68) AS sd FROM x GROUP BY 1)
SELECT topic, round((rm - bm) / (sd / 4), 4) AS z, round(rs, 4) AS recent_articles FROM g WHERE weeks >= 68 AND sd > 0 AND (rm - bm) / (sd / 4) >= 0.5 AND rs >= 3"""
)
def frontier_heating(spark, d):
    """The read side's heating, at half a standard error."""
    out = S.frontier_heating(V.adjusted_volume(T.volume(spark, d)).where("topic <> -1"), k=0.5)
    return out.select("topic", F.round("z", 4).alias("z"), F.round("recent_articles", 4).alias("recent_articles"))


@query(
    f"""WITH {T.PRESS_SQL}, w AS (SELECT query, {_sunday('day')} AS week, avg(ratio) AS v FROM press WHERE year(day) >= 1995 GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY week DESC) - 1 AS back FROM w),
g AS (SELECT query, count(*) AS weeks, avg(v) FILTER (back < 16) AS rm, avg(v) FILTER (back >= 16 AND back < 68) AS bm, stddev_samp(v) FILTER (back >= 16 AND back < 68) AS sd FROM x GROUP BY 1)
SELECT query, (rm - bm) / sd >= 2 AS is_heating, round((rm - bm) / sd, 3) AS z, round(rm, 6) AS recent_mean, round(bm, 6) AS baseline_mean FROM g WHERE weeks >= 68 AND sd > 0"""
)
def press_heating(spark, d):
    """Attention shares' recent weeks against their baseline."""
    out = S.press_heating(T.press(spark, d), since=1995)
    return out.withColumn("recent_mean", F.round("recent_mean", 6)).withColumn("baseline_mean", F.round("baseline_mean", 6))


@query(
    f"""WITH {T.PRESS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY day) AS r FROM press),
b AS (SELECT query, count(*) AS n, avg(story_count) FILTER (r <= 90) AS m, coalesce(nullif(stddev_samp(story_count) FILTER (r <= 90), 0), 1) AS sd FROM x GROUP BY 1)
SELECT query, day, story_count, CASE WHEN n >= 90 THEN round((story_count - m) / sd, 3) ELSE 0 END AS z_score, n >= 90 AND (story_count - m) / sd > 2 AS is_anomaly FROM x JOIN b USING (query)"""
)
def anomaly_z(spark, d):
    """Daily counts against their query's first 90."""
    return S.anomaly_z(T.press(spark, d))


@query(
    f"""{CUSTOMER_VOL}, e AS (SELECT topic, count(DISTINCT article_id) AS n_articles, min(day) AS onset, max(day) AS last FROM cust GROUP BY 1)
SELECT topic, n_articles, onset, n_articles < 42 AND onset >= (SELECT max(last) FROM e) - 7 * 160 AND n_articles >= 3 AS forming FROM e"""
)
def forming(spark, d):
    """Young topics under the floor (customers, within 160 weeks)."""
    return S.forming(_customers(spark, d), weeks=160)


@query(
    f"""{CUSTOMER_VOL}, e AS (SELECT topic, min(day) AS onset, max(day) AS last FROM cust GROUP BY 1)
SELECT topic, onset, last, (SELECT max(last) FROM e) - onset <= 700 AS emerging FROM e"""
)
def emerging(spark, d):
    """Topics that began within 100 weeks of the frontier."""
    return S.emerging(_customers(spark, d), weeks=100)


EVENTS_SQL = """months AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS m),
parts AS (SELECT m, year(m) AS y, month(m) AS k, last_day(m) AS l FROM months),
ev AS (SELECT CAST(l - CAST((isodow(l) - 3 + 7) % 7 AS INTEGER) AS DATE) AS event_date, 'FOMC Meeting (approx)' AS event_label, 0 AS r FROM parts WHERE k IN (1, 3, 5, 6, 7, 9, 11, 12)
UNION ALL SELECT CAST(m + CAST((5 - isodow(m) + 7) % 7 AS INTEGER) AS DATE), 'Employment Situation (approx)', 1 FROM parts
UNION ALL SELECT make_date(y, k, 12), 'CPI (approx)', 2 FROM parts
UNION ALL SELECT CAST(l - CAST((isodow(l) - 5 + 7) % 7 AS INTEGER) AS DATE), 'PCE (approx)', 3 FROM parts
UNION ALL SELECT CAST(l - CAST((isodow(l) - 3 + 7) % 7 AS INTEGER) AS DATE), 'GDP (approx)', 4 FROM parts WHERE k IN (1, 4, 7, 10)
UNION ALL SELECT make_date(y, k, 15), 'MPR to Congress', 5 FROM parts WHERE k IN (2, 7))"""


@query(f"WITH {EVENTS_SQL} SELECT event_date, event_label FROM ev")
def calendar_events(spark, d):
    """The calendar of seven years."""
    return S.calendar_events(spark, "1995-01-01", "2001-12-31").select("event_date", "event_label")


WEEKS_SQL = f"""{VOL}, {EVENTS_SQL}, wk AS (SELECT DISTINCT CAST(date_trunc('week', day) AS DATE) AS week FROM vol),
hit AS (SELECT week, event_label, min(struct_pack(d := event_date, r := r)) AS o FROM wk JOIN ev ON event_date BETWEEN week - 3 AND week + 9 GROUP BY 1, 2),
lab AS (SELECT week, string_agg(event_label, ' | ' ORDER BY o) AS label FROM hit GROUP BY 1)"""


@query(f"{WEEKS_SQL} SELECT week, label IS NOT NULL AS calendar_event, coalesce(label, '') AS calendar_event_label FROM wk LEFT JOIN lab USING (week)")
def calendar_flagged_weeks(spark, d):
    """The corpus's weeks with the events near them."""
    weeks = V.weekly_unique(T.volume(spark, d)).select("week").distinct()
    return S.annotate_weeks(weeks, S.calendar_events(spark, "1995-01-01", "2001-12-31"))


@query(
    f"""{WEEKS_SQL}, tw AS (SELECT DISTINCT topic, CAST(date_trunc('week', day) AS DATE) AS week FROM vol)
SELECT topic, count(*) FILTER (label IS NOT NULL AND week BETWEEN DATE '1996-01-01' AND DATE '1997-06-30') AS n_flagged FROM tw LEFT JOIN lab USING (week) GROUP BY 1"""
)
def calendar_growth_phase(spark, d):
    """Flagged weeks within a growth phase, by topic."""
    weeks = S.annotate_weeks(V.weekly_unique(T.volume(spark, d)).select("topic", "week"), S.calendar_events(spark, "1995-01-01", "2001-12-31"))
    return S.flagged_in_phase(weeks, F.lit("1996-01-01").cast("date"), F.lit("1997-06-30").cast("date"))
