"""Recency signals against the corpus frontier (never the wall clock), and the economic calendar."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.weeks import first_weekday, frontier_bucket, last_weekday, sunday_end
from ..schema import PARAMS
from .volume import daily_unique


def _judged(weekly: DataFrame, keys: list[str], recent: int, base: int, k: float, scale: float) -> DataFrame:
    """weekly: (keys, back, value), back counted from 0 at the latest week. Too few weeks or no spread give no row."""
    is_recent, is_base = F.col("back") < recent, (F.col("back") >= recent) & (F.col("back") < recent + base)
    out = weekly.groupBy(*keys).agg(
        F.count("*").alias("weeks"),
        F.avg(F.when(is_recent, F.col("value"))).alias("recent_mean"),
        F.sum(F.when(is_recent, F.col("value"))).alias("recent_sum"),
        F.avg(F.when(is_base, F.col("value"))).alias("base_mean"),
        F.stddev_samp(F.when(is_base, F.col("value"))).alias("base_sd"),
    )
    out = out.where((F.col("weeks") >= recent + base) & (F.col("base_sd") > 1e-12))
    return out.withColumn("z_raw", (F.col("recent_mean") - F.col("base_mean")) / (F.col("base_sd") / F.lit(scale))).withColumn("k", F.lit(float(k)))


def corpus_heating(rows: DataFrame, recent: int = PARAMS.heat_recent, base: int = PARAMS.heat_base, k: float = PARAMS.heat_sigma, least: int = PARAMS.heat_articles) -> DataFrame:
    """Weekly distinct articles (weeks end on Sunday, silent ones 0) of the recent weeks against the trailing baseline, in
    standard errors. Only Sundays up to the frontier count, so the week under way drops out."""
    daily = daily_unique(rows.where("topic <> -1"), "topic")
    frontier = daily.agg(F.max("day").alias("frontier"))
    weekly = daily.groupBy("topic", sunday_end(F.col("day")).alias("week")).agg(F.sum("n").alias("n"))
    ends = daily.groupBy("topic").agg(sunday_end(F.min("day")).alias("a")).crossJoin(F.broadcast(frontier))
    last = F.date_sub(sunday_end(F.date_add("frontier", 1)), 7)
    weeks = ends.where(F.col("a") <= last).select("topic", last.alias("last"), F.explode(F.sequence("a", last, F.expr("interval 7 days"))).alias("week"))
    weekly = weeks.join(weekly, ["topic", "week"], "left").select("topic", F.floor(F.date_diff("last", "week") / 7).alias("back"), F.coalesce("n", F.lit(0)).cast("double").alias("value"))
    out = _judged(weekly, ["topic"], recent, base, k, math.sqrt(recent))
    fires = (F.col("z_raw") >= k) & (F.col("recent_sum") >= least)
    return out.select("topic", fires.alias("is_heating"), F.round("z_raw", 3).alias("z"), F.col("recent_sum").cast("long").alias("recent_articles"))


def frontier_heating(series: DataFrame, frontier: Column | None = None, recent: int = PARAMS.heat_recent, base: int = PARAMS.heat_base, k: float = PARAMS.heat_sigma, least: int = PARAMS.heat_articles) -> DataFrame:
    """The read side's rule: 7-day buckets counted back from the frontier over adjusted volume; only firing topics."""
    series = series.crossJoin(F.broadcast(series.agg(F.max("day").alias("frontier"))))
    bucket = frontier_bucket(F.col("day"), F.col("frontier"))
    sums = series.groupBy("topic", bucket.alias("back")).agg(F.sum("adjusted").alias("v"))
    span = sums.groupBy("topic").agg(F.max("back").alias("n")).select("topic", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("back"))
    weekly = span.join(sums, ["topic", "back"], "left").select("topic", "back", F.coalesce("v", F.lit(0.0)).alias("value"))
    out = _judged(weekly, ["topic"], recent, base, k, math.sqrt(recent))
    return out.where((F.col("z_raw") >= k) & (F.col("recent_sum") >= least)).select("topic", F.col("z_raw").alias("z"), F.col("recent_sum").alias("recent_articles"))


def press_heating(press: DataFrame, recent: int = PARAMS.heat_recent, base: int = PARAMS.heat_base, k: float = PARAMS.heat_sigma, since: int = PARAMS.press_since) -> DataFrame:
    """Weekly mean attention share (weeks without records stay absent) against its baseline, in its deviations."""
    weekly = press.where(F.year("day") >= since).groupBy("query", sunday_end(F.col("day")).alias("week")).agg(F.avg("ratio").alias("value"))
    weekly = weekly.withColumn("back", F.row_number().over(W.partitionBy("query").orderBy(F.desc("week"))) - 1)
    out = _judged(weekly, ["query"], recent, base, k, 1.0)
    return out.select("query", (F.col("z_raw") >= k).alias("is_heating"), F.round("z_raw", 3).alias("z"), "recent_mean", F.col("base_mean").alias("baseline_mean"))


def anomaly_z(press: DataFrame, first: int = 90, sigma: float = 2.0) -> DataFrame:
    """Each record's distance from the mean of its query's first records, in their deviations (0 counts as 1). With fewer
    records than that nothing is flagged."""
    w = W.partitionBy("query")
    rows = press.withColumn("r", F.row_number().over(w.orderBy("day")))
    early = F.when(F.col("r") <= first, F.col("story_count"))
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("m", F.avg(early).over(w)).withColumn("sd", F.stddev_samp(early).over(w))
    z = (F.col("story_count") - F.col("m")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    enough = F.col("n") >= first
    return rows.select("query", "day", "story_count", F.when(enough, F.round(z, 3)).otherwise(0.0).alias("z_score"), (enough & (z > sigma)).alias("is_anomaly"))


def forming(rows: DataFrame, weeks: int = PARAMS.forming_weeks, least: int = PARAMS.forming_articles, floor: int = PARAMS.floor_articles) -> DataFrame:
    """Topics under the floor that began within `weeks` of the frontier and have `least` articles."""
    ends = rows.where("topic <> -1").groupBy("topic").agg(F.countDistinct("article_id").alias("n_articles"), F.min("day").alias("onset"), F.max("day").alias("last"))
    ends = ends.crossJoin(F.broadcast(ends.agg(F.max("last").alias("frontier"))))
    is_forming = (F.col("n_articles") < floor) & (F.col("onset") >= F.date_sub("frontier", 7 * weeks)) & (F.col("n_articles") >= least)
    return ends.select("topic", "n_articles", "onset", is_forming.alias("forming"))


def emerging(rows: DataFrame, weeks: int = PARAMS.emerging_weeks) -> DataFrame:
    """Whether a topic began within `weeks` of the frontier."""
    ends = rows.where("topic <> -1").groupBy("topic").agg(F.min("day").alias("onset"), F.max("day").alias("last"))
    ends = ends.crossJoin(F.broadcast(ends.agg(F.max("last").alias("frontier"))))
    return ends.select("topic", "onset", "last", (F.date_diff("frontier", "onset") <= 7 * weeks).alias("emerging"))


# The calendar's events, as (label, rule, months).
EVENTS = (
    ("FOMC Meeting (approx)", "last Wed", (1, 3, 5, 6, 7, 9, 11, 12)),
    ("Employment Situation (approx)", "first Fri", tuple(range(1, 13))),
    ("CPI (approx)", "12", tuple(range(1, 13))),
    ("PCE (approx)", "last Fri", tuple(range(1, 13))),
    ("GDP (approx)", "last Wed", (1, 4, 7, 10)),
    ("MPR to Congress", "15", (2, 7)),
)


def calendar_events(spark, start: str, end: str) -> DataFrame:
    """(event_date, event_label) within the dates, duplicates on a day kept."""
    months = spark.sql(f"SELECT explode(sequence(trunc(DATE '{start}', 'MM'), DATE '{end}', interval 1 month)) AS month")
    year, month = F.year("month"), F.month("month")
    out = None
    for rank, (label, rule, when) in enumerate(EVENTS):
        kind, _, weekday = rule.partition(" ")
        day = first_weekday(year, month, weekday) if kind == "first" else last_weekday(year, month, weekday) if kind == "last" else F.make_date(year, month, F.lit(int(rule)))
        part = months.where(month.isin(*when)).select(day.alias("event_date"), F.lit(label).alias("event_label"), F.lit(rank).alias("event_rank"))
        out = part if out is None else out.unionAll(part)
    return out.where(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def annotate_weeks(weeks: DataFrame, events: DataFrame, half: int = PARAMS.calendar_half_window) -> DataFrame:
    """weeks (week: a Monday) with whether an event falls within the week or `half` days of it, and the labels, each once,
    in the order of their dates. Each event is dealt to the few weeks it touches, so this is an equi-join."""
    day = F.explode(F.sequence(F.date_sub("event_date", 6 + half), F.date_add("event_date", half)))
    touched = events.withColumn("week", day).where("dayofweek(week) = 2").groupBy("week")
    touched = touched.agg(F.array_sort(F.collect_list(F.struct("event_date", "event_rank", "event_label"))).alias("e"))
    label = F.array_join(F.array_distinct(F.transform("e", lambda x: x["event_label"])), " | ")
    out = weeks.join(touched, "week", "left")
    return out.withColumn("calendar_event", F.col("e").isNotNull()).withColumn("calendar_event_label", F.coalesce(label, F.lit(""))).drop("e")


def flagged_in_phase(annotated: DataFrame, start: Column, end: Column) -> DataFrame:
    """How many flagged weeks lie in a phase."""
    return annotated.groupBy("topic").agg(F.count_if(F.col("calendar_event") & F.col("week").between(start, end)).alias("n_flagged"))
