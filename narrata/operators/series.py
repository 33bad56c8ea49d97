"""Series-level results: each topic's series meets one grouped function once. A series has one value a calendar day, so a
group's size doesn't grow with the corpus."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..schema import PARAMS

LENSES = ("logistic", "sir", "bass")


def packed(rows: DataFrame, value: str = "y", key: str = "topic") -> DataFrame:
    """(key, first, last, y): each series as an array by day."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("day", F.col(value).cast("double").alias("v")))), lambda s: s["v"])
    return rows.groupBy(key).agg(F.min("day").alias("first"), F.max("day").alias("last"), ordered.alias("y"))


def _map(df: DataFrame, f, schema: str) -> DataFrame:
    def run(frames):
        for frame in frames:
            out = [row for r in frame.itertuples(index=False) for row in f(r)]
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in schema.split(",")])

    return df.mapInPandas(run, schema)


def shape_facts(series: DataFrame, key: str = "topic") -> DataFrame:
    def f(r):
        x = N.shape_facts(np.asarray(r.y, float))
        yield (getattr(r, key), x["total_volume"], x["peak_volume"], x["time_to_peak_days"], x["active_days"], x["wave_count"])

    return _map(packed(series, key=key), f, f"{key} {dict(series.dtypes)[key]}, total_volume double, peak_volume double, time_to_peak_days double, active_days long, wave_count long")


def trends(series: DataFrame, last: int | None = None, key: str = "topic") -> DataFrame:
    """The trend test of each series, or of its last values."""

    def f(r):
        y = np.asarray(r.y, float)
        x = N.mann_kendall(y[-last:] if last else y)
        yield (getattr(r, key), x["trend"], x["p"], x["z"], x["s"], x["ties"], x["slope"])

    return _map(packed(series, key=key), f, f"{key} {dict(series.dtypes)[key]}, trend string, p double, z double, s double, ties double, slope double")


def stages(series: DataFrame, key: str = "topic") -> DataFrame:
    """Each topic's stage and what it rests on; silence counts against the latest day of all series."""
    rows = packed(series, key=key)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("last").alias("frontier")))).withColumn("silent", F.date_diff("frontier", "last"))

    def f(r):
        x = N.classify(np.asarray(r.y, float), int(r.silent))
        yield (getattr(r, key), x["stage"], x["trend"], x["trend_p"], x["trend_z"], x["slope"], x["recent_peak_ratio"], x["near_peak"], x["stale"], x["elapsed_days"], x["smoothed_volume"], int(r.silent))

    kind = f"{key} {dict(series.dtypes)[key]}, stage string, trend string, trend_p double, trend_z double, slope double, recent_peak_ratio double, near_peak boolean, stale boolean, elapsed_days long, smoothed_volume long, days_since_active long"
    return _map(rows, f, kind)


def lens_fits(series: DataFrame, key: str = "topic", lenses: tuple[str, ...] = LENSES) -> DataFrame:
    """Each lens's best window of each series: converged, R2, AICc, peak day, window, parameters. A task per series and lens."""
    rows = packed(series, key=key).withColumn("lens", F.explode(F.array(*(F.lit(x) for x in lenses))))
    rows = rows.repartition(F.col(key), F.col("lens"))

    def f(r):
        x = N.best_window(r.lens, np.asarray(r.y, float))
        good = lambda v: v if v is not None and math.isfinite(v) else None
        params = {k: float(v) for k, v in x.items() if k not in ("converged", "i0", "i1", "r2", "aicc", "peak_time") and math.isfinite(v)}
        yield (getattr(r, key), r.lens, bool(x["converged"]), good(x["r2"]), good(x["aicc"]), good(x["peak_time"]), int(x["i0"]), int(x["i1"]), params)

    return _fits(rows, f, key, dict(series.dtypes)[key])


def _fits(rows: DataFrame, f, key: str, kind: str) -> DataFrame:
    names = [key, "lens", "converged", "r2", "aicc", "peak_time", "i0", "i1", "params"]

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([row for r in frame.itertuples(index=False) for row in f(r)], columns=names)

    return rows.mapInPandas(run, f"{key} {kind}, lens string, converged boolean, r2 double, aicc double, peak_time double, i0 int, i1 int, params map<string,double>")


def staging_fit(fits: DataFrame, key: str = "topic") -> DataFrame:
    """The fit that stands for a topic: converged epidemic, converged logistic, epidemic, logistic, then any."""
    place = F.when(F.col("converged") & (F.col("lens") == "sir"), 0).when(F.col("converged") & (F.col("lens") == "logistic"), 1).when(F.col("lens") == "sir", 2).when(F.col("lens") == "logistic", 3).otherwise(4)
    return fits.groupBy(key).agg(F.min_by(F.struct("lens", "converged", "peak_time", "r2"), place).alias("fit")).select(key, "fit.*")


def best_lens(fits: DataFrame, key: str = "topic") -> DataFrame:
    """The converged lens with the highest R2; topics without one have none."""
    return fits.where("converged").groupBy(key).agg(F.max_by("lens", F.struct("r2", "lens")).alias("lens"), F.max("r2").alias("r2"))


def reprojected(fits: DataFrame, series: DataFrame, key: str = "topic") -> DataFrame:
    """(key, lens, padded): a window as an array over the whole series, null outside it."""
    n = packed(series, key=key).select(key, F.size("y").alias("n"), "y")
    inside = F.slice("y", F.col("i0") + 1, F.col("i1") - F.col("i0") + 1)
    null = F.lit(None).cast("double")
    whole = F.concat(F.array_repeat(null, F.col("i0")), inside, F.array_repeat(null, F.col("n") - F.col("i1") - 1))
    return fits.join(n, key).select(key, "lens", whole.alias("padded"))


def overlays(volume: DataFrame, other: DataFrame, key: str = "topic", lags: int = PARAMS.granger_lags, alpha: float = PARAMS.granger_alpha) -> DataFrame:
    """(key, n, p_leads, p_follows, lags, verdict) of weekly pairs (key, week, volume, other): whether the volume leads the other
    series, follows it, both or neither. A p of 0 counts as significant."""
    pair = volume.join(other, "week")
    rows = pair.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("week", F.col("value").alias("v"), F.col("other").alias("o")))).alias("s"))
    rows = rows.select(key, F.transform("s", lambda x: x["v"]).alias("v"), F.transform("s", lambda x: x["o"]).alias("o"))

    def f(r):
        a, b = N.granger(r.o, r.v, lags), N.granger(r.v, r.o, lags)
        if a is None or b is None:
            yield (getattr(r, key), len(r.v), None, None, None, None, "insufficient")
            return
        verdict = {(True, True): "both", (True, False): "leads", (False, True): "follows", (False, False): "neither"}[a[0] < alpha, b[0] < alpha]
        yield (getattr(r, key), len(r.v), a[0], b[0], float(a[1]), float(b[1]), verdict)

    return _map(rows, f, f"{key} {dict(volume.dtypes)[key]}, n long, p_leads double, p_follows double, lag_leads double, lag_follows double, verdict string")


def responsiveness(pairs: DataFrame, key: str = "topic") -> DataFrame:
    """(key, phi, lam, p_ar, p_trend) of pairs (key, week, value, other): the series on its own and the other's last value."""
    rows = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("week", "value", "other"))).alias("s"))
    rows = rows.select(key, F.transform("s", lambda x: x["value"]).alias("v"), F.transform("s", lambda x: x["other"]).alias("o"))

    def f(r):
        x = N.arx(r.v, r.o)
        yield (getattr(r, key), x["phi"], x["lam"], x["p_ar"], x["p_trend"])

    return _map(rows, f, f"{key} {dict(pairs.dtypes)[key]}, phi double, lam double, p_ar double, p_trend double")


def surrogates(pairs: DataFrame, key: str = "topic", least_shift: int = 8) -> DataFrame:
    """(key, r, p): Pearson's correlation of (value, other) by week, and the share of circular shifts of the value, of at
    least `least_shift` weeks either way, that correlate as strongly."""
    rows = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("week", "value", "other"))).alias("s"))
    rows = rows.select(key, F.transform("s", lambda x: x["value"]).alias("v"), F.transform("s", lambda x: x["other"]).alias("o"))

    def f(r):
        v, o = np.asarray(r.v, float), np.asarray(r.o, float)
        n = len(v)
        if n < 3 * least_shift or v.std() == 0 or o.std() == 0:
            yield (getattr(r, key), None, None)
            return
        v, o = (v - v.mean()) / v.std(), (o - o.mean()) / o.std()
        all_shifts = np.fft.irfft(np.fft.rfft(o) * np.conj(np.fft.rfft(v)), n) / n
        others = np.abs(all_shifts[least_shift : n - least_shift + 1])
        yield (getattr(r, key), float(all_shifts[0]), float((1 + (others >= abs(all_shifts[0]) - 1e-12).sum()) / (1 + len(others))))

    return _map(rows, f, f"{key} {dict(pairs.dtypes)[key]}, r double, p double")
