"""Python data sources: the contract that network readers share. A fetcher gives records of a range of dates; the reader
splits the range into partitions, drops what a record must not have, and never invents a date."""

from __future__ import annotations

import json
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: name -> fetch(start, end) -> iterable of dicts; processes that read must register their own.
FETCHERS: dict = {}


class DateRange(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end


def split_range(start: str, end: str, days: int) -> list[tuple[str, str]]:
    """Consecutive ranges of at most `days` days."""
    a, b, out = date.fromisoformat(start), date.fromisoformat(end), []
    while a <= b:
        z = min(b, a + timedelta(days=days - 1))
        out.append((a.isoformat(), z.isoformat()))
        a = z + timedelta(days=1)
    return out


def bisect_range(start: str, end: str, count, cap: int) -> list[tuple[str, str]]:
    """Halves a range until count(start, end) is at most the cap, or a day is left."""
    if start == end or count(start, end) <= cap:
        return [(start, end)]
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    middle = a + (b - a) // 2
    return bisect_range(start, middle.isoformat(), count, cap) + bisect_range((middle + timedelta(days=1)).isoformat(), end, count, cap)


class FeedSource(DataSource):
    """spark.read.format("feed").option("records", json lines or a path of the driver)...: records with a date in the range.
    Options: fetcher (a name in FETCHERS) or records (a JSON list), start, end, days (a partition's), hosts (comma-separated:
    a record's host must be one of them or under it), min_words."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "url string, title string, body string, published_at string"

    def reader(self, schema):
        return FeedReader(self.options)


class FeedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [DateRange(a, b) for a, b in split_range(self.options["start"], self.options["end"], int(self.options.get("days", 31)))]

    def read(self, partition):
        if "fetcher" in self.options:
            records = FETCHERS[self.options["fetcher"]](partition.start, partition.end)
        else:
            records = json.loads(self.options["records"])
        hosts = [h for h in self.options.get("hosts", "").split(",") if h]
        least = int(self.options.get("min_words", 0))
        for r in records:
            day = (r.get("published_at") or "")[:10]
            host = (r.get("url") or "").split("//")[-1].split("/")[0].lower()
            if not partition.start <= day <= partition.end or (hosts and not any(host == h or host.endswith("." + h) for h in hosts)):
                continue
            if len((r.get("body") or "").split()) >= least:
                yield r.get("url"), r.get("title"), r.get("body"), r.get("published_at")


def register(spark) -> None:
    spark.dataSource.register(FeedSource)


def composite(frames: dict, spark):
    """All sources' rows with their source_id, and a status row each; raises if any failed or is empty. frames: name -> a
    function that returns a DataFrame with url, title, body, published_at. All are tried before it raises."""
    from pyspark.sql import functions as F

    out, status = None, []
    for name, make in frames.items():
        try:
            rows = make().withColumn("source_id", F.lit(name))
            n = rows.count()
            status.append((name, n, "empty" if n == 0 else "done"))
            out = rows if out is None else out.unionByName(rows)
        except Exception as e:  # noqa: BLE001
            status.append((name, 0, f"failed: {str(e)[:200]}"))
    if bad := [s for s in status if s[2] != "done"]:
        raise RuntimeError(f"sources failed: {bad}")
    return out, spark.createDataFrame(status, "source_id string, n long, status string")
