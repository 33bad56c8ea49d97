"""What is published, one JSON document a row, and the read side's queries over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def finite(x: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def finite_array(x: Column) -> Column:
    return F.transform(x, finite)


def index(parts: DataFrame, *optional: DataFrame) -> DataFrame:
    """One row a cluster: parts (topic, n_articles) with each optional frame (topic, ...) joined; stage defaults to dormant,
    in_scope to true; in the catalogue's order (in scope first, then by articles)."""
    out = parts
    for frame in optional:
        out = out.join(frame, "topic", "left")
    for name, default in (("stage", "dormant"), ("in_scope", True)):
        out = out.withColumn(name, F.coalesce(name, F.lit(default)) if name in out.columns else F.lit(default))
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("in_scope"), F.desc("n_articles"), "topic")))


def documents(rows: DataFrame, key: str = "topic") -> DataFrame:
    """(key, json): a strict JSON document a row, nulls kept, doubles finite."""
    clean = [finite(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else finite_array(F.col(f"`{c}`")).alias(c) if t == "array<double>" else F.col(f"`{c}`") for c, t in rows.dtypes]
    return rows.select(*clean).select(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def directory(rows: DataFrame) -> DataFrame:
    """One JSON document of all clusters, by topic. Its size is that of the clusters, not the articles."""
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("json"))


def light(series: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, week, mean): weekly means of topics under the floor, by weeks named by their first Monday, that day excluded."""
    from ..functions.weeks import after_monday

    kept = series.join(topics, "topic", "left_semi")
    return kept.groupBy("topic", after_monday(F.col("day")).alias("week")).agg(F.round(F.avg("adjusted"), 4).alias("mean"))


def catalogue(rows: DataFrame, text: str = "", stages: tuple[str, ...] = (), scope_only: bool = False, stageless_pass: bool = False) -> DataFrame:
    """Rows whose label or terms hold the text, whose stage is ticked (or none is, or they have none and may pass), in scope
    if asked for."""
    q = text.strip().lower()
    ok = F.lit(True) if not q else F.contains(F.lower("label"), F.lit(q)) | F.contains(F.lower(F.array_join("terms", " ")), F.lit(q))
    if stages:
        ticked = F.col("stage").isin(*stages)
        ok = ok & (ticked | F.col("stage").isNull() if stageless_pass else F.coalesce(ticked, F.lit(False)))
    return rows.where(ok & F.col("in_scope") if scope_only else ok)


def directory_filter(rows: DataFrame, text: str = "", surfaced_only: bool = False) -> DataFrame:
    q = text.strip().lower()
    ok = F.lit(True) if not q else F.contains(F.lower("name"), F.lit(q)) | F.contains(F.col("label"), F.lit(q))
    return rows.where(ok & F.col("surfaced") if surfaced_only else ok)


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of ordered rows; the number is held between the first and the last page."""
    last = max(0, -(-rows.count() // size) - 1)
    return rows.orderBy(*order).offset(min(max(0, number), last) * size).limit(size)


def display_name(human: Column, label: Column) -> Column:
    """The human name, else the raw label made readable."""
    return F.coalesce(F.nullif(human, F.lit("")), X.display_label(label))


def sparkline(values: Column, n: int = 44) -> Column:
    """Means of n buckets; shorter series stay."""
    step = F.size(values) / F.lit(n)
    cut = lambda i: F.slice(values, F.floor(i * step).cast("int") + 1, F.greatest(F.floor((i + 1) * step) - F.floor(i * step), F.lit(1)).cast("int"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return F.when(F.size(values) <= n, values).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: mean(cut(i))))


def bar_heights(values: Column, height: float) -> Column:
    """Values from 0 to `height` between their least and greatest; a flat series lies at 0."""
    low, high = F.array_min(values), F.array_max(values)
    span = F.when(high > low, high - low).otherwise(1.0)
    return F.transform(F.arrays_zip(values.alias("v"), F.array_repeat(low, F.size(values)).alias("l"), F.array_repeat(span, F.size(values)).alias("s")), lambda x: (x["v"] - x["l"]) / x["s"] * height)


def node_size(n: Column, least: Column, most: Column) -> Column:
    """A map node's size: 6 + 12 t ** 0.67 of the logarithm's place t between the least and the greatest, 3 at least."""
    t = F.coalesce(F.try_divide(F.log1p(n) - F.log1p(least), F.log1p(most) - F.log1p(least)), F.lit(0.0))
    return F.greatest(F.lit(3.0), 6 + 12 * F.pow(t, F.lit(0.67)))


def roll_up(rows: DataFrame, groups: dict[str, str]) -> DataFrame:
    """(source, n): sources of a group together, ascending."""
    name = F.col("source_id")
    for k, v in groups.items():
        name = F.when(F.col("source_id") == k, v).otherwise(name)
    return rows.groupBy(name.alias("source")).agg(F.sum("n").alias("n")).orderBy("n", "source")
