"""Joins of cluster series with external ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .volume import sunday_weeks


def weekly_pairs(volume: DataFrame, value: str, external: DataFrame, other: str) -> DataFrame:
    """(topic, week, value, other): Sunday weeks in which both series have a value: sums of volume, means of the other."""
    own = sunday_weeks(volume, value, "sum", "topic")
    ext = sunday_weeks(external, other, "mean").select("week", F.col("value").alias("other"))
    return own.join(ext, "week").where("value is not null and other is not null").select("topic", "week", "value", "other")


def nearest(left: DataFrame, right: DataFrame, on: str, value: str, reach_days: int = 45) -> DataFrame:
    """left with the value of right's nearest date within reach (ties to the earlier one), else null. Dates are dealt to
    buckets as wide as the reach, so each left row meets three buckets and not all dates."""
    bucket = lambda c: F.floor(F.unix_date(c) / reach_days)
    near = left.withColumn("__b", F.explode(F.array(*(bucket(on) + i for i in (-1, 0, 1)))))
    other = right.select(F.col(on).alias("__on"), F.col(value).alias("__v")).withColumn("__b", bucket("__on"))
    hit = near.join(other, "__b").where(F.abs(F.date_diff("__on", on)) <= reach_days)
    best = hit.groupBy(*left.columns).agg(F.min_by("__v", F.struct(F.abs(F.date_diff("__on", on)), "__on")).alias(value))
    return left.join(best, left.columns, "left")


def monthly_mean(rows: DataFrame, day: str, value: str) -> DataFrame:
    return rows.groupBy(F.trunc(day, "MM").alias("month")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def correlation(pairs: DataFrame, a: str, b: str, least: int = 4) -> DataFrame:
    """One row: Pearson's correlation, null with fewer than `least` pairs."""
    whole = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return whole.agg(F.count("*").alias("n"), F.corr(a, b).alias("r")).select("n", F.when(F.col("n") >= least, F.col("r")).alias("r"))


def on_grid(grid: DataFrame, series: DataFrame, value: str) -> DataFrame:
    """The series on the grid's days, null where it has none."""
    return grid.join(series.select("day", value), "day", "left")


def loudest_window(series: DataFrame, width: int, fraction: float, key: str = "topic") -> DataFrame:
    """(key, ratio, level, faded): the last `width` days' mean against the loudest `width` days before them (the first of
    equals); series no longer than that haven't faded."""
    w = W.partitionBy(key)
    rows = series.withColumn("i", F.row_number().over(w.orderBy("day")) - 1).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("sum", F.sum("y").over(w.orderBy("i").rowsBetween(0, width - 1)))
    start = F.when(F.col("i") <= F.col("n") - 2 * width, F.struct(F.round("sum", 9).alias("s"), (-F.col("i")).alias("i"), F.col("sum").alias("raw")))
    out = rows.groupBy(key).agg(
        F.max("n").alias("n"),
        F.avg(F.when(F.col("i") >= F.col("n") - width, F.col("y"))).alias("recent"),
        (F.max(start)["raw"] / width).alias("loud"),
        F.avg(F.when(F.col("i") < F.col("n") - width, F.col("y"))).alias("prefix"),
    )
    level = F.when(F.col("n") >= 2 * width, F.col("loud")).when(F.col("n") > width, F.col("prefix"))
    out = out.withColumn("level", F.when(level > 0, level))
    ratio = F.coalesce(F.col("recent") / F.col("level"), F.lit(1.0))
    return out.select(key, ratio.alias("ratio"), "level", (F.col("level").isNotNull() & (ratio < fraction)).alias("faded"))
