"""Counts of distinct articles over time, and series made of them. Noise (topic -1) counts in the base rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.weeks import monday_start, sunday_end
from ..schema import PARAMS


def daily_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct articles a day; rows without a day don't count."""
    return rows.where("day is not null").groupBy(*keys, "day").agg(F.countDistinct("article_id").alias("n"))


def spine(rows: DataFrame, *keys: str) -> DataFrame:
    """Every day from a group's first to its last."""
    ends = rows.groupBy(*keys).agg(F.min("day").alias("__a"), F.max("day").alias("__b"))
    return ends.where("__a is not null").select(*keys, F.explode(F.sequence("__a", "__b")).alias("day"))


def filled_daily(rows: DataFrame, *keys: str) -> DataFrame:
    """daily_unique with zeros on the days between."""
    daily = daily_unique(rows, *keys)
    return spine(daily, *keys).join(daily, [*keys, "day"], "left").select(*keys, "day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def centred_mean(rows: DataFrame, value: str, days: int, *keys: str) -> DataFrame:
    """A centred moving mean over the rows that are there; an even width looks one further back."""
    w = W.partitionBy(*keys).orderBy("day") if keys else W.orderBy("day")
    return rows.withColumn("smooth", F.avg(value).over(w.rowsBetween(-(days // 2), (days - 1) // 2)))


def base_rate(rows: DataFrame, days: int = PARAMS.smooth_days) -> DataFrame:
    """(day, rate, mean_rate): the smoothed corpus volume on each calendar day and its mean over positive days.
    Its rows are calendar days, however large the corpus is."""
    smooth = centred_mean(filled_daily(rows), "n", days).select("day", F.col("smooth").alias("rate"))
    mean = smooth.agg(F.avg(F.when(F.col("rate") > 0, F.col("rate"))).alias("mean_rate"))
    return smooth.crossJoin(F.broadcast(mean))


def adjusted_volume(rows: DataFrame) -> DataFrame:
    """(topic, day, n, adjusted) over each topic's own days: counts against the corpus's base rate, on its mean level."""
    rate = base_rate(rows)
    return (
        filled_daily(rows, "topic")
        .join(F.broadcast(rate), "day", "left")  # one row a calendar day
        .select("topic", "day", "n", F.when(F.col("rate") > 0, F.col("n") / F.col("rate") * F.col("mean_rate")).otherwise(0.0).alias("adjusted"))
    )


def contamination(rows: DataFrame, limit: float = PARAMS.contamination) -> DataFrame:
    """Each topic's largest source, its share of the topic's articles, and whether it reaches the limit."""
    by = rows.groupBy("topic", "source_id").agg(F.countDistinct("article_id").alias("n"))
    total = by.groupBy("topic").agg(F.sum("n").alias("total"))
    first = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("n"), "source_id"))
    top = by.withColumn("r", first).where("r = 1").join(total, "topic")
    share = F.col("n") / F.col("total")
    return top.select("topic", "source_id", "n", (share).alias("share"), (share >= limit).alias("flagged"))


def weekly_unique(rows: DataFrame) -> DataFrame:
    """Distinct articles of a topic by Monday week; weeks without any are absent."""
    return rows.where("day is not null").groupBy("topic", monday_start(F.col("day")).alias("week")).agg(F.countDistinct("article_id").alias("n"))


def sunday_weeks(rows: DataFrame, value: str, how: str, *keys: str) -> DataFrame:
    """Weekly sum (0 in weeks between without rows) or mean (null there) by weeks that end on Sunday."""
    week = sunday_end(F.col("day")).alias("week")
    agg = F.sum(value) if how == "sum" else F.avg(value)
    weekly = rows.groupBy(*keys, week).agg(agg.alias("value"))
    ends = weekly.groupBy(*keys).agg(F.min("week").alias("__a"), F.max("week").alias("__b"))
    weeks = ends.select(*keys, F.explode(F.sequence("__a", "__b", F.expr("interval 7 days"))).alias("week"))
    out = weeks.join(weekly, [*keys, "week"], "left")
    return out.withColumn("value", F.coalesce("value", F.lit(0.0))) if how == "sum" else out


def surfaced(rows: DataFrame, floor: int = PARAMS.floor_articles) -> DataFrame:
    """Topics (not noise) with at least `floor` distinct articles."""
    return rows.where("topic <> -1").groupBy("topic").agg(F.countDistinct("article_id").alias("n_articles")).where(F.col("n_articles") >= floor)


def indexed(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with i, the day's number within its series, and n_days."""
    w = W.partitionBy(*keys)
    return rows.withColumn("i", F.date_diff("day", F.min("day").over(w))).withColumn("n_days", F.count("*").over(w))


def central_mass(rows: DataFrame, value: str, alpha: float = PARAMS.mass_alpha, *keys: str) -> DataFrame:
    """First and last index between which all but alpha of a series' sum lies; a series without mass is whole."""
    w = W.partitionBy(*keys)
    run = indexed(rows, *keys).withColumn("total", F.sum(value).over(w)).withColumn("run", F.sum(value).over(w.orderBy("i").rowsBetween(W.unboundedPreceding, 0)))

    def reach(q: float):
        return F.min(F.when(F.col("run") >= q * F.col("total"), F.col("i")))

    out = run.groupBy(*keys).agg(F.max("total").alias("total"), F.max("n_days").alias("n"), reach(alpha / 2).alias("a"), reach(1 - alpha / 2).alias("b"))
    good = (F.col("total") > 0) & (F.col("b") > F.col("a"))
    return out.select(*keys, F.when(good, F.col("a")).otherwise(0).cast("int").alias("i0"), F.when(good, F.col("b")).otherwise(F.col("n") - 1).cast("int").alias("i1"))


def weekly_blocks(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Means of 7-day blocks from a series' own first day, with the block's middle; the last block may be short."""
    block = F.floor(F.col("i") / 7).cast("int").alias("block")
    out = indexed(rows, *keys).groupBy(*keys, block).agg(F.avg(value).alias("mean"), F.min("i").alias("a"), F.max("i").alias("b"))
    return out.select(*keys, "block", ((F.col("a") + F.col("b")) / 2).alias("centre"), "mean")


def fit_windows(rows: DataFrame, value: str, anchors: int = PARAMS.anchors, least: int = PARAMS.min_span_days, *keys: str) -> DataFrame:
    """Pairs of anchors (multiples of n // (anchors - 1), and the last day) that span max(n // 3, least) days or more and
    hold five positive days or more; `usable` tells."""
    series = indexed(rows, *keys)
    series = series.groupBy(*keys).agg(F.max("n_days").cast("int").alias("n"), F.collect_list(F.when(F.col(value) > 0, F.col("i"))).alias("on"))
    step = F.greatest(F.floor(F.col("n") / (anchors - 1)).cast("int"), F.lit(1))
    marks = F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("n") - 1, step), F.array(F.col("n") - 1))))
    series = series.withColumn("marks", marks).withColumn("i0", F.explode("marks")).withColumn("i1", F.explode("marks"))
    wide = F.col("i1") - F.col("i0") >= F.greatest(F.floor(F.col("n") / 3).cast("int"), F.lit(least))
    positive = F.size(F.filter("on", lambda i: (i >= F.col("i0")) & (i <= F.col("i1"))))
    return series.where(wide).select(*keys, "n", "i0", "i1", (positive >= 5).alias("usable"))


def source_year_pivot(rows: DataFrame, years: list[int]) -> DataFrame:
    """Distinct articles by source and year, absent as 0, and the source's total."""
    counted = rows.groupBy("source_id").pivot("year", years).agg(F.countDistinct("article_id"))
    columns = [F.coalesce(F.col(str(y)), F.lit(0)).alias(f"y{y}") for y in years]
    return counted.select("source_id", *columns).withColumn("total", sum((F.col(f"y{y}") for y in years), F.lit(0)).cast("long"))


def coverage_gaps(rows: DataFrame) -> DataFrame:
    """Years that other sources have and this one lacks."""
    has = rows.select("source_id", "year").distinct()
    return has.select("source_id").distinct().crossJoin(F.broadcast(has.select("year").distinct())).join(has, ["source_id", "year"], "left_anti")


def composition(rows: DataFrame, floor: int = PARAMS.floor_articles) -> DataFrame:
    """Distinct articles of surfaced topics by source."""
    kept = rows.join(surfaced(rows, floor).select("topic"), "topic", "left_semi")
    return kept.groupBy("source_id").agg(F.countDistinct("article_id").alias("n"))


def spread_over_year(rows: DataFrame, key: str, year: str = "year", block: int = 1 << 16) -> DataFrame:
    """rows with `day`: those of a year spread over it by their rank in the order of `key`, a number. Ranks are counted in blocks of
    the key's values, so that no year lands in one task; a block's start is the count of the year's blocks before it."""
    w = W.partitionBy(year)
    blocked = rows.withColumn("__block", F.floor(F.col(key) / block))
    counts = blocked.groupBy(year, "__block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(w.orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(year, "__block", F.coalesce(before, F.lit(0)).alias("__start"), F.sum("__n").over(w).alias("__all"))
    own = blocked.withColumn("__row", F.row_number().over(W.partitionBy(year, "__block").orderBy(key)) - 1).join(starts, [year, "__block"])
    share = (F.col("__start") + F.col("__row") + 0.5) / F.col("__all") * 364
    return own.withColumn("day", F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.bround(share, 0).cast("int"))).select(*rows.columns, "day")
