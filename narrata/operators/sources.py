"""Rules that source readers share, over records already fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(text: Column, rules: list[tuple[str, str]], other: str | None = None) -> Column:
    """The name of the first rule (pattern, name) that matches."""
    out = None
    for pattern, name in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def once(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def held_back(title: Column, roles: str = r"(?i)\b(under|assistant|deputy)\b") -> Column:
    """Whether a speaker's role keeps a record out."""
    return title.rlike(roles)


def wide(rows: DataFrame, names: list[str], key: str = "series", day: str = "day", value: str = "value") -> DataFrame:
    """A column a series, by day; a series that has no rows is a column of nulls."""
    return rows.groupBy(day).pivot(key, names).agg(F.first(value)).orderBy(day)


def totals(rows: DataFrame, *keys: str) -> DataFrame:
    """(key, value, n): counts by each of several columns on its own, in one pass by grouping sets."""
    grouped = rows.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count("*").alias("n"), *(F.grouping(k).alias(f"__{k}") for k in keys))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:
        name = F.when(F.col(f"__{k}") == 0, k).otherwise(name)
        value = F.when(F.col(f"__{k}") == 0, F.col(k).cast("string")).otherwise(value)
    return grouped.select(name.alias("key"), value.alias("value"), "n")


def frontier(rows: DataFrame) -> DataFrame:
    """Each source's last day."""
    return rows.groupBy("source_id").agg(F.max("day").alias("last"))
