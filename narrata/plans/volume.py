"""Queries of the volume algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import volume as V
from ..sources import tables as T
from .registry import query

VOL = "WITH " + T.VOLUME_SQL
DAILY = """daily AS (SELECT day, count(DISTINCT article_id) AS n FROM vol GROUP BY 1)"""
RATE = (
    DAILY
    + """, spine AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
rate AS (SELECT day, avg(coalesce(n, 0)) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS rate FROM spine LEFT JOIN daily USING (day)),
mean AS (SELECT avg(rate) AS mean_rate FROM rate WHERE rate > 0)"""
)
ADJ = (
    RATE
    + """, tdaily AS (SELECT topic, day, count(DISTINCT article_id) AS n FROM vol GROUP BY 1, 2),
tspine AS (SELECT topic, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM tdaily GROUP BY topic),
adj AS (SELECT topic, day, coalesce(n, 0) AS n, CASE WHEN rate > 0 THEN coalesce(n, 0) / rate * mean_rate ELSE 0 END AS adjusted
  FROM tspine LEFT JOIN tdaily USING (topic, day) LEFT JOIN rate USING (day) CROSS JOIN mean)"""
)
SMOOTH = ADJ + """, smooth AS (SELECT topic, day, row_number() OVER (PARTITION BY topic ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY topic) AS n_days, adjusted,
  avg(adjusted) OVER (PARTITION BY topic ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS y FROM adj)"""


@query(f"{VOL}, {DAILY} SELECT day, n FROM daily")
def daily_unique(spark, d):
    """Distinct articles a day."""
    return V.daily_unique(T.volume(spark, d))


@query(f"{VOL}, {RATE} SELECT day, round(rate, 6) AS rate, round(mean_rate, 6) AS mean_rate FROM rate CROSS JOIN mean")
def base_rate(spark, d):
    """The corpus's smoothed daily volume."""
    return V.base_rate(T.volume(spark, d)).select("day", F.round("rate", 6).alias("rate"), F.round("mean_rate", 6).alias("mean_rate"))


@query(f"{VOL}, {ADJ} SELECT topic, day, CAST(n AS BIGINT) AS n, round(adjusted, 6) AS adjusted FROM adj")
def cluster_adjusted_volume(spark, d):
    """Each topic's daily counts against the base rate."""
    return V.adjusted_volume(T.volume(spark, d)).withColumn("adjusted", F.round("adjusted", 6))


@query(f"{VOL}, {SMOOTH} SELECT topic, day, round(y, 6) AS y FROM smooth WHERE topic <> -1")
def smoothed_volume(spark, d):
    """A centred week's mean of the adjusted volume."""
    rows = V.adjusted_volume(T.volume(spark, d)).where("topic <> -1")
    return V.centred_mean(rows, "adjusted", 7, "topic").select("topic", "day", F.round("smooth", 6).alias("y"))


@query(f"{VOL} SELECT topic, CAST(date_trunc('week', day) AS DATE) AS week, count(DISTINCT article_id) AS n FROM vol GROUP BY 1, 2")
def weekly_unique(spark, d):
    """Distinct articles by topic and Monday week."""
    return V.weekly_unique(T.volume(spark, d))


@query(
    f"""{VOL}, w AS (SELECT topic, CAST(date_trunc('week', day) AS DATE) AS week, count(DISTINCT article_id) AS n FROM vol GROUP BY 1, 2)
SELECT topic, week, round(avg(n) OVER (PARTITION BY topic ORDER BY week ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM w"""
)
def smoothed_weeks(spark, d):
    """A rolling mean of four present weeks (28 days)."""
    rows = V.weekly_unique(T.volume(spark, d)).withColumnRenamed("week", "day")
    return V.centred_mean(rows, "n", 28 // 7, "topic").select("topic", F.col("day").alias("week"), F.round("smooth", 6).alias("smooth"))


@query(
    f"""{VOL}, b AS (SELECT topic, source_id, count(DISTINCT article_id) AS n FROM vol GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY topic) AS total, row_number() OVER (PARTITION BY topic ORDER BY n DESC, source_id) AS r FROM b)
SELECT topic, source_id, n, round(n / total, 6) AS share, n / total >= 0.9 AS flagged FROM r WHERE r = 1"""
)
def source_contamination(spark, d):
    """Topics' largest source."""
    return V.contamination(T.volume(spark, d)).withColumn("share", F.round("share", 6))


@query(
    f"""{VOL}, s AS (SELECT topic FROM vol WHERE topic <> -1 GROUP BY 1 HAVING count(DISTINCT article_id) >= 42)
SELECT source_id, count(DISTINCT article_id) AS n FROM vol WHERE topic IN (SELECT topic FROM s) GROUP BY 1"""
)
def composition(spark, d):
    """Surfaced articles by source."""
    return V.composition(T.volume(spark, d))


@query(
    f"""{VOL}, t AS (SELECT topic, count(DISTINCT article_id) AS n FROM vol WHERE topic <> -1 GROUP BY 1)
SELECT substr('EFGHJ', 1 + topic % 5, 1) AS code, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1"""
)
def composition_by_code(spark, d):
    """Distinct articles of each topic, summed by the topic's code; an article in two topics counts twice."""
    by = T.volume(spark, d).where("topic <> -1").groupBy("topic").agg(F.countDistinct("article_id").alias("n"))
    return by.groupBy(F.substring(F.lit("EFGHJ"), F.col("topic") % 5 + 1, F.lit(1)).alias("code")).agg(F.sum("n").alias("n"))


@query(f"{VOL} SELECT topic, count(DISTINCT article_id) AS n_articles FROM vol WHERE topic <> -1 GROUP BY 1 HAVING count(DISTINCT article_id) >= 42")
def floor_filter(spark, d):
    """Topics with 42 articles or more."""
    return V.surfaced(T.volume(spark, d))


YEARS = list(range(1995, 2002))


@query(
    f"""{VOL} SELECT source_id, {', '.join(f"count(DISTINCT CASE WHEN year(day) = {y} THEN article_id END) AS y{y}" for y in YEARS)},
count(DISTINCT article_id) AS total FROM vol GROUP BY 1"""
)
def source_year_pivot(spark, d):
    """Articles by source and year."""
    return V.source_year_pivot(T.volume(spark, d).withColumn("year", F.year("day")), YEARS)


@query(f"{VOL} SELECT source_id, CAST(year(day) AS INTEGER) AS year, count(*) AS n FROM vol GROUP BY ROLLUP (source_id, CAST(year(day) AS INTEGER))")
def source_year_rollup(spark, d):
    """The pivot's counts with subtotals."""
    return T.volume(spark, d).rollup("source_id", F.year("day").alias("year")).agg(F.count("*").alias("n"))


@query(
    f"""{VOL}, h AS (SELECT DISTINCT topic AS source_id, CAST(date_trunc('week', day) AS DATE) AS year FROM vol)
SELECT a.source_id, b.year FROM (SELECT DISTINCT source_id FROM h) a CROSS JOIN (SELECT DISTINCT year FROM h) b
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.source_id = a.source_id AND h.year = b.year)"""
)
def coverage_gaps(spark, d):
    """Weeks in which a topic lacks articles that others have."""
    rows = T.volume(spark, d).select(F.col("topic").alias("source_id"), F.date_trunc("WEEK", "day").cast("date").alias("year"))
    return V.coverage_gaps(rows)


@query(
    f"""{VOL}, {SMOOTH}, run AS (SELECT *, sum(y) OVER (PARTITION BY topic ORDER BY i) AS run, sum(y) OVER (PARTITION BY topic) AS total FROM smooth WHERE topic <> -1),
m AS (SELECT topic, max(n_days) AS n, max(total) AS total, min(i) FILTER (run >= 0.025 * total) AS a, min(i) FILTER (run >= 0.975 * total) AS b FROM run GROUP BY 1)
SELECT topic, CAST(CASE WHEN total > 0 AND b > a THEN a ELSE 0 END AS INTEGER) AS i0, CAST(CASE WHEN total > 0 AND b > a THEN b ELSE n - 1 END AS INTEGER) AS i1 FROM m"""
)
def central_mass(spark, d):
    """The days that hold 95 % of a topic's volume."""
    return V.central_mass(_smooth(spark, d), "y", 0.05, "topic")


def _smooth(spark, d):
    rows = V.adjusted_volume(T.volume(spark, d)).where("topic <> -1")
    return V.centred_mean(rows, "adjusted", 7, "topic").select("topic", "day", F.col("smooth").alias("y"))


@query(
    f"""{VOL}, {SMOOTH} SELECT topic, CAST(i // 7 AS INTEGER) AS block, (min(i) + max(i)) / 2 AS centre, round(avg(y), 6) AS mean
FROM smooth WHERE topic <> -1 GROUP BY 1, 2"""
)
def weekly_blocks(spark, d):
    """Means of 7-day blocks of each topic."""
    return V.weekly_blocks(_smooth(spark, d), "y", "topic").withColumn("mean", F.round("mean", 6))


@query(
    f"""{VOL}, {SMOOTH}, s AS (SELECT topic, CAST(max(n_days) AS INTEGER) AS n FROM smooth WHERE topic <> -1 GROUP BY 1),
marks AS (SELECT DISTINCT topic, n, m FROM (SELECT topic, n, CAST(unnest(generate_series(0, n - 1, greatest(n // 9, 1))) AS INTEGER) AS m FROM s UNION ALL SELECT topic, n, n - 1 FROM s))
SELECT a.topic, a.n, a.m AS i0, b.m AS i1, (SELECT count(*) FROM smooth x WHERE x.topic = a.topic AND x.y > 0 AND x.i BETWEEN a.m AND b.m) >= 5 AS usable
FROM marks a JOIN marks b USING (topic) WHERE b.m - a.m >= greatest(a.n // 3, 30)"""
)
def fit_windows(spark, d):
    """The windows in which a topic's curves are fitted."""
    return V.fit_windows(_smooth(spark, d), "y", 10, 30, "topic")


@query(
    f"""{VOL}, t AS (SELECT day, count(DISTINCT article_id) AS n FROM vol WHERE topic <> -1 GROUP BY 1)
SELECT day, n - lag(n) OVER (ORDER BY day) AS step FROM t QUALIFY lag(n) OVER (ORDER BY day) IS NOT NULL"""
)
def first_difference(spark, d):
    """Change from day to day; the first day drops out."""
    from pyspark.sql import Window as W

    daily = V.daily_unique(T.volume(spark, d).where("topic <> -1"))
    return daily.select("day", (F.col("n") - F.lag("n").over(W.orderBy("day"))).alias("step")).where("step is not null")


@query(
    """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT month, round(v / lag(v, 12) OVER (ORDER BY month) - 1, 6) AS change FROM m"""
)
def year_over_year(spark, d):
    """Monthly change against twelve rows before."""
    from pyspark.sql import Window as W

    m = T.table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    return m.select("month", F.round(F.col("v") / F.lag("v", 12).over(W.orderBy("month")) - 1, 6).alias("change"))
