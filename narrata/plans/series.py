"""Queries of series numerics and overlays."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import overlays as O
from ..operators import series as S
from ..operators import volume as V
from ..sources import tables as T
from .registry import query
from .signals import _sunday
from .volume import ADJ, SMOOTH, VOL, _smooth

WAVES = f"""{VOL}, {SMOOTH}, s AS (SELECT topic, i, round(y, 9) AS y FROM smooth WHERE topic <> -1), mx AS (SELECT topic, max(y) AS top FROM s GROUP BY 1),
ch AS (SELECT *, CASE WHEN y IS DISTINCT FROM lag(y) OVER (PARTITION BY topic ORDER BY i) THEN 1 ELSE 0 END AS c FROM s),
ru AS (SELECT topic, y, i, sum(c) OVER (PARTITION BY topic ORDER BY i) AS run FROM ch),
pl AS (SELECT topic, run, min(y) AS y, (min(i) + max(i)) // 2 AS mid FROM ru GROUP BY 1, 2),
pk AS (SELECT *, lag(y) OVER (PARTITION BY topic ORDER BY run) AS a, lead(y) OVER (PARTITION BY topic ORDER BY run) AS b FROM pl),
wv AS (SELECT topic, mid, y FROM pk JOIN mx USING (topic) WHERE y > a AND y > b AND y >= top / 2)"""


def _rounded(spark, d):
    return _smooth(spark, d).withColumn("y", F.round("y", 9))


@query(
    f"""{WAVES} SELECT topic, round(sum(y), 4) AS total_volume, round(max(y), 6) AS peak_volume, CAST(arg_max(i, struct_pack(y := y, i := -i)) AS DOUBLE) AS time_to_peak_days,
count(*) FILTER (y >= top / 2) AS active_days, greatest(1, (SELECT count(*) FROM wv WHERE wv.topic = s.topic)) AS wave_count FROM s JOIN mx USING (topic) GROUP BY topic"""
)
def shape_facts(spark, d):
    """What a topic's curve looks like."""
    return S.shape_facts(_rounded(spark, d)).withColumn("total_volume", F.round("total_volume", 4)).withColumn("peak_volume", F.round("peak_volume", 6))


@query(f"{WAVES} SELECT topic, CAST(mid AS INTEGER) AS i, round(y, 6) AS y FROM wv")
def half_height_peaks(spark, d):
    """Interior peaks of at least half a topic's height, a plateau once, by window functions."""
    w = W.partitionBy("topic")
    rows = V.indexed(_rounded(spark, d), "topic").withColumn("top", F.max("y").over(w))
    new = (~F.col("y").eqNullSafe(F.lag("y").over(w.orderBy("i")))).cast("int")
    rows = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w.orderBy("i")))
    flat = rows.groupBy("topic", "run").agg(F.min("y").alias("y"), F.max("top").alias("top"), F.floor((F.min("i") + F.max("i")) / 2).cast("int").alias("i"))
    order = w.orderBy("run")
    flat = flat.withColumn("a", F.lag("y").over(order)).withColumn("b", F.lead("y").over(order))
    return flat.where("y > a and y > b and y >= top / 2").select("topic", "i", F.round("y", 6).alias("y"))


@query(
    f"""{VOL}, {SMOOTH}, s AS (SELECT topic, i, round(y, 9) AS y FROM smooth WHERE topic <> -1 AND i >= n_days - 28),
p AS (SELECT a.topic, sum(sign(b.y - a.y)) AS s FROM s a JOIN s b ON a.topic = b.topic AND a.i < b.i GROUP BY 1),
t AS (SELECT topic, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT topic, y, count(*) AS c FROM s GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT a.topic, median((ln(1 + b.y) - ln(1 + a.y)) / (b.i - a.i)) AS slope FROM s a JOIN s b ON a.topic = b.topic AND a.i < b.i GROUP BY 1)
SELECT topic, CAST(s AS DOUBLE) AS s, CAST(ties AS DOUBLE) AS ties, round(slope, 6) AS slope FROM p JOIN t USING (topic) JOIN m USING (topic)"""
)
def trend_statistic(spark, d):
    """Sign sum, ties and median slope of the last 28 days."""
    return S.trends(_rounded(spark, d), 28).select("topic", "s", "ties", F.round("slope", 6).alias("slope"))


@query(
    f"""{VOL}, {SMOOTH}, s AS (SELECT topic, i, n_days AS n, y, sum(y) OVER (PARTITION BY topic ORDER BY i ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING) AS w FROM smooth WHERE topic <> -1),
g AS (SELECT topic, max(n) AS n, avg(y) FILTER (i >= n - 28) AS recent, max(w) FILTER (i <= n - 56) / 28 AS loud, avg(y) FILTER (i < n - 28) AS prefix FROM s GROUP BY 1),
l AS (SELECT topic, recent, CASE WHEN n >= 56 THEN loud WHEN n > 28 THEN prefix END AS level FROM g)
SELECT topic, round(coalesce(recent / nullif(level, 0), 1), 6) AS ratio, round(nullif(level, 0), 6) AS level, coalesce(recent / nullif(level, 0), 1) < 0.25 AS faded FROM l"""
)
def faded_windows(spark, d):
    """Recent weeks against the loudest ones before."""
    out = O.loudest_window(_smooth(spark, d), 28, 0.25)
    return out.select("topic", F.round("ratio", 6).alias("ratio"), F.round("level", 6).alias("level"), "faded")


@query(None)
def stage_catalogue(spark, d):
    """Topics' life-cycle stages."""
    return S.stages(_rounded(spark, d))


@query(None)
def lens_fits(spark, d):
    """Three curves fitted to each topic of the short event series."""
    rows = T.event_volume(spark, d)
    series = V.filled_daily(rows.select("article_id", "topic", "day"), "topic").select("topic", "day", F.col("n").cast("double").alias("y"))
    return S.lens_fits(series)


def _fits(spark, d):
    """Fits as a table: one for each topic and lens, of made-up quality."""
    rows = T.volume(spark, d).where("topic <> -1").select("topic").distinct()
    rows = rows.withColumn("lens", F.explode(F.array(F.lit("logistic"), F.lit("sir"), F.lit("bass"))))
    h = F.col("topic") * 7 + F.length("lens") * 13
    rows = rows.withColumn("r2", (h % 100) / 100).withColumn("converged", F.col("r2") >= 0.3).withColumn("peak_time", (h % 50).cast("double"))
    return rows.withColumn("i0", (F.col("topic") * 3).cast("int")).withColumn("i1", (F.col("topic") * 3 + 40).cast("int"))


FITS = f"""{VOL}, f0 AS (SELECT DISTINCT topic, unnest(['logistic', 'sir', 'bass']) AS lens FROM vol WHERE topic <> -1),
fits AS (SELECT topic, lens, (topic * 7 + length(lens) * 13) % 100 / 100 AS r2, (topic * 7 + length(lens) * 13) % 100 / 100 >= 0.3 AS converged,
  CAST((topic * 7 + length(lens) * 13) % 50 AS DOUBLE) AS peak_time FROM f0)"""


@query(
    f"""{FITS} SELECT topic, lens, converged, peak_time, r2 FROM fits QUALIFY row_number() OVER (PARTITION BY topic ORDER BY CASE WHEN converged AND lens = 'sir' THEN 0
WHEN converged AND lens = 'logistic' THEN 1 WHEN lens = 'sir' THEN 2 WHEN lens = 'logistic' THEN 3 ELSE 4 END) = 1"""
)
def staging_fit(spark, d):
    """The fit that stands for a topic."""
    return S.staging_fit(_fits(spark, d))


@query(f"{FITS} SELECT topic, lens, r2 FROM fits WHERE converged QUALIFY row_number() OVER (PARTITION BY topic ORDER BY r2 DESC, lens DESC) = 1")
def best_lens(spark, d):
    """The lens shown first."""
    return S.best_lens(_fits(spark, d))


@query(
    f"""{VOL}, {SMOOTH}, s AS (SELECT topic, i, n_days, y FROM smooth WHERE topic <> -1)
SELECT topic, CAST(max(n_days) AS INTEGER) AS n, CAST(count(*) FILTER (i BETWEEN topic * 3 AND topic * 3 + 40) AS INTEGER) AS inside, round(sum(y) FILTER (i BETWEEN topic * 3 AND topic * 3 + 40), 4) AS total FROM s GROUP BY 1"""
)
def reprojection(spark, d):
    """Windows padded with nulls to the whole series."""
    rows = S.reprojected(_fits(spark, d).where("lens = 'sir'"), _smooth(spark, d))
    inside = F.filter("padded", lambda v: v.isNotNull())
    total = F.aggregate(inside, F.lit(0.0), lambda s, v: s + v)
    return rows.select("topic", F.size("padded").alias("n"), F.size(inside).alias("inside"), F.round(total, 4).alias("total"))


MARKET = f"""{VOL}, {ADJ}, vw AS (SELECT topic, {_sunday('day')} AS week, sum(adjusted) AS v FROM adj WHERE topic <> -1 GROUP BY 1, 2),
mk AS (SELECT {_sunday('CAST(day AS DATE)')} AS week, avg(value) AS o FROM (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1) GROUP BY 1)"""


def _market_pairs(spark, d):
    volume = V.adjusted_volume(T.volume(spark, d)).where("topic <> -1")
    return O.weekly_pairs(volume, "adjusted", T.market(spark, d), "value")


@query(f"{MARKET} SELECT topic, week, round(v, 5) AS value, round(o, 6) AS other FROM vw JOIN mk USING (week)")
def market_overlay(spark, d):
    """Weekly volumes beside the level series."""
    return _market_pairs(spark, d).select("topic", "week", F.round("value", 5).alias("value"), F.round("other", 6).alias("other"))


@query(
    f"""{VOL}, {ADJ}, {T.PRESS_SQL}, vw AS (SELECT topic, {_sunday('day')} AS week, sum(adjusted) AS v FROM adj WHERE topic <> -1 GROUP BY 1, 2),
pw AS (SELECT {_sunday('day')} AS week, avg(ratio) AS o FROM press WHERE query = 'N' GROUP BY 1)
SELECT topic, week, round(v, 5) AS value, round(o, 6) AS other FROM vw JOIN pw USING (week)"""
)
def press_overlay(spark, d):
    """Weekly volumes beside the press's attention share."""
    volume = V.adjusted_volume(T.volume(spark, d)).where("topic <> -1")
    press = T.press(spark, d).where("query = 'N'")
    return O.weekly_pairs(volume, "adjusted", press, "ratio").select("topic", "week", F.round("value", 5).alias("value"), F.round("other", 6).alias("other"))


@query(None)
def granger(spark, d):
    """Which of a topic's volume and the level series leads."""
    pairs = _market_pairs(spark, d)
    return S.overlays(pairs.select("topic", "week", "value"), pairs.select("week", "other").distinct())


@query(None)
def responsiveness(spark, d):
    """Topics' response to the level series."""
    return S.responsiveness(_market_pairs(spark, d))


@query(
    """WITH l AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS day FROM orders),
r AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1), q AS (SELECT CAST(day - 9500 + CAST((day - DATE '2024-01-01') * 60 AS INTEGER) AS DATE) AS day, v FROM r),
h AS (SELECT l.day, q.v, row_number() OVER (PARTITION BY l.day ORDER BY abs(q.day - l.day), q.day) AS k FROM l JOIN q ON abs(q.day - l.day) <= 45)
SELECT l.day, h.v FROM l LEFT JOIN h ON l.day = h.day AND k = 1"""
)
def nearest_asof(spark, d):
    """Months with the nearest value of a sparse series."""
    left = T.table(spark, d, "orders").select(F.trunc("o_orderdate", "MM").alias("day")).distinct()
    daily = T.table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("e")).agg(F.count("*").cast("double").alias("v"))
    right = daily.select(F.date_add("e", F.date_diff("e", F.lit("2024-01-01").cast("date")) * 60 - 9500).alias("day"), "v")
    return O.nearest(left, right, "day", "v")


@query(
    """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY 1)
SELECT month, round(mean, 6) AS mean, n FROM m"""
)
def monthly_mean(spark, d):
    """Monthly means."""
    return O.monthly_mean(T.table(spark, d, "orders"), "o_orderdate", "o_totalprice").withColumn("mean", F.round("mean", 6))


@query(
    """WITH a AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS x FROM orders GROUP BY 1),
b AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1)
SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM a JOIN b USING (month)"""
)
def monthly_corr(spark, d):
    """Correlation of two monthly series."""
    a = O.monthly_mean(T.table(spark, d, "orders"), "o_orderdate", "o_totalprice").select("month", F.col("mean").alias("x"))
    b = O.monthly_mean(T.table(spark, d, "lineitem"), "l_shipdate", "l_extendedprice").select("month", F.col("mean").alias("y"))
    return O.correlation(a.join(b, "month"), "x", "y").withColumn("r", F.round("r", 6))


@query(
    f"""{VOL}, {ADJ}, p AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1)
SELECT topic, day, n_1 AS n FROM (SELECT topic, a.day, p.n AS n_1 FROM adj a LEFT JOIN p USING (day))"""
)
def overlay_on_grid(spark, d):
    """An external series on each topic's days."""
    grid = V.adjusted_volume(T.volume(spark, d)).select("topic", "day")
    press = T.press(spark, d).groupBy("day").agg(F.sum("story_count").alias("n"))
    return O.on_grid(grid, press, "n").select("topic", "day", "n")


@query(
    f"""{VOL}, d AS (SELECT day, count(*) AS n FROM vol GROUP BY 1), s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d),
x AS (SELECT s.day, CASE WHEN day(s.day) % 3 = 0 THEN NULL ELSE n END AS n FROM s LEFT JOIN d USING (day))
SELECT day, coalesce(last_value(n IGNORE NULLS) OVER (ORDER BY day), first_value(n IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS n FROM x"""
)
def gap_fill(spark, d):
    """Gaps filled forward, then backward."""
    daily = V.filled_daily(T.volume(spark, d)).select("day", "n")
    has = V.daily_unique(T.volume(spark, d)).select("day", F.col("n").alias("v"))
    rows = daily.join(has, "day", "left").withColumn("v", F.when(F.dayofmonth("day") % 3 != 0, F.col("v")))
    w = W.orderBy("day")
    back = F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing))
    return rows.select("day", F.coalesce(F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)), back).alias("n"))
