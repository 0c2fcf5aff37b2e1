"""Forecasts and fits by sums: least squares on any number of rows, volatility forecasts and their losses, propagator and response fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import divide

DAY = 86_400_000


def least_squares(df: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Coefficients (with intercept) and R². One aggregation; only the k² sums reach the driver."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    there = df
    for c in (y, *xs):
        there = there.where(F.col(c).isNotNull())
    t = F.col(y).cast("double")
    k = len(cols)
    row = there.agg(*[F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]], *[F.sum(c * t) for c in cols], F.sum(t * t)).first()
    if row is None or row[0] is None:
        return {}
    m, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[at]
            at += 1
    v, yy = np.array(row[at : at + k], float), float(row[at + k])
    b = np.linalg.lstsq(m, v, rcond=None)[0]
    total = yy - v[0] ** 2 / m[0, 0]
    return dict(zip(["intercept", *xs], map(float, b), strict=True)) | {"r2": float((b @ v - v[0] ** 2 / m[0, 0]) / total) if total > 0 else float("nan")}


def har_frame(hours: DataFrame, value: str = "x") -> DataFrame:
    """(symbol, h, y, last, day, week): the value and its regressors, the value before and means of the 24 and 168 rows before."""
    w = Window.partitionBy("symbol").orderBy("h")
    mean = lambda n: F.when(F.count(value).over(w.rowsBetween(-n, -1)) >= n, F.avg(value).over(w.rowsBetween(-n, -1)))
    return hours.select("symbol", "h", F.col(value).alias("y"), F.lag(value).over(w).alias("last"), mean(24).alias("day"), mean(168).alias("week"))


def predict(df: DataFrame, fit: dict[str, float], floor: float = 1e-9) -> DataFrame:
    f = sum((F.col(x) * b for x, b in fit.items() if x not in ("intercept", "r2")), F.lit(fit["intercept"]))
    return df.withColumn("forecast", F.greatest(f, F.lit(floor)))


def qlike(x: Column, f: Column) -> Column:
    return divide(x, f) - F.ln(divide(x, f)) - 1


def diebold_mariano(df: DataFrame, a: str, b: str, cluster: str) -> DataFrame:
    """Mean loss difference a - b with a standard error clustered by ``cluster``."""
    from tidewright.operators.inference import clustered_mean

    return clustered_mean(df.withColumn("__d", F.col(a) - F.col(b)), [], "__d", cluster).withColumn("t", divide(F.col("mean"), F.col("se")))


def level_visits(tape: DataFrame, step: int = 50, after_ms: int = 3_600_000) -> DataFrame:
    """First visit of each round level by symbol and day, and the worst price within ``after_ms``: levels are exploded from each trade's move, then met by day."""
    w = Window.partitionBy("symbol", "day").orderBy("ts_ms", "id")
    t = tape.withColumn("day", F.expr(f"ts_ms div {DAY}"))
    move = t.select("symbol", "day", "ts_ms", "id", "tick", F.lag("tick").over(w).alias("before")).where("before IS NOT NULL")
    lo, hi = F.least("tick", "before"), F.greatest("tick", "before")
    # a sequence whose end is below its start would run backwards
    levels = F.when(F.ceil(lo / step) <= F.floor(hi / step), F.sequence(F.ceil(lo / step), F.floor(hi / step)))
    crossed = move.select("symbol", "day", "ts_ms", "id", (F.col("tick") > F.col("before")).alias("up"), F.explode(F.filter(levels, lambda k: (k * step > lo) | (k * step == F.col("tick")))).alias("k"))
    first = crossed.groupBy("symbol", "day", "k").agg(F.min_by(F.struct("ts_ms", "id", "up"), F.struct("ts_ms", "id")).alias("v"))
    hit = first.select("symbol", "day", (F.col("k") * step).alias("level"), "v.ts_ms", "v.up")
    later = hit.join(t.select("symbol", "day", F.col("ts_ms").alias("t"), "tick"), ["symbol", "day"]).where((F.col("t") >= F.col("ts_ms")) & (F.col("t") <= F.col("ts_ms") + after_ms))
    beyond = F.max(F.when(F.col("up"), F.col("tick") - F.col("level")).otherwise(F.col("level") - F.col("tick")))
    return later.groupBy("symbol", "day", "level", "ts_ms", "up").agg(beyond.alias("beyond"), F.count("*").alias("trades"))


def duration_variance(bars: DataFrame, threshold: float) -> DataFrame:
    """Variance of a day from its count of range bars: count times threshold² / (4 ln 2)."""
    return bars.groupBy("symbol", "day").agg((F.countDistinct("range_bar") * threshold * threshold / 2.772588722239781).alias("variance"))


def propagator(c: list[float], r: list[float]) -> np.ndarray:
    """G from R(l) = G(l) + Σ G(l - n) C(n) + Σ (G(l + n) - G(n)) C(n), cut at the last lag and solved by least squares. ``c`` and ``r`` are for lags 1, 2, …"""
    n = len(r)
    m = np.zeros((n, n))
    for i in range(n):
        m[i, i] += 1
        for k in range(1, n + 1):
            if i - k >= 0:
                m[i, i - k] += c[k - 1]
            if i + k < n:
                m[i, i + k] += c[k - 1]
            m[i, k - 1] -= c[k - 1]
    return np.linalg.lstsq(m, np.asarray(r, float), rcond=None)[0]


def propagators(responses: DataFrame) -> DataFrame:
    """(symbol, lag, g): kernel values of each symbol from its (symbol, lag, c, r); a group is a symbol's lags."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("lag")
        g = propagator(x.c.tolist(), x.r.tolist())
        return pd.DataFrame({"symbol": x.symbol.to_numpy(), "lag": x.lag.to_numpy().astype(np.int64), "g": g})

    return responses.select("symbol", "lag", "c", "r").groupBy("symbol").applyInPandas(run, "symbol string, lag long, g double")


def response_curve(moves: DataFrame, size: str, move: str, keys: list[str]) -> DataFrame:
    """By keys: exponent and scale of |move| ~ size^b on class means, log-log, net of the control mean of the same keys."""
    base = moves.groupBy(*keys).agg(F.avg(move).alias("__c"))
    net = moves.join(base, keys).withColumn("__n", F.col(move) - F.col("__c")) if keys else moves.withColumn("__n", F.col(move))
    cls = net.groupBy(*keys, size).agg(F.avg(F.abs("__n")).alias("m"), F.count("*").alias("n")).where("m > 0")
    return cls.groupBy(*keys).agg(F.regr_slope(F.ln("m"), F.ln(F.col(size))).alias("exponent"), F.exp(F.regr_intercept(F.ln("m"), F.ln(F.col(size)))).alias("scale"), F.sum("n").alias("n"))


def slippage(fills: DataFrame, decisions: DataFrame) -> DataFrame:
    """By symbol and side: mean cost in bp of fills against the price at the last decision before them, and the delay."""
    from tidewright.operators.asof import asof

    j = asof(fills, decisions, "symbol", "ts_ms", ["price"], strict=True).where("price IS NOT NULL")
    return j.groupBy("symbol", "side").agg(F.avg(1e4 * F.col("side") * (F.col("tick") - F.col("price")) / F.col("price")).alias("bp"), F.avg(F.col("ts_ms") - F.col("ts_ms_matched")).alias("delay_ms"), F.count("*").alias("n"))


def vol_target(daily: DataFrame, target: float = 0.10, n: int = 60, cap: float = 3.0, least: int = 20) -> DataFrame:
    """Returns scaled by yesterday's target over rolling volatility, at most ``cap`` times what the volatility of all days so far would give. One series."""
    w = Window.orderBy("date")
    frame, whole = w.rowsBetween(-n, -1), w.rowsBetween(Window.unboundedPreceding, -1)
    year = 252**0.5
    sd = F.when(F.count("net").over(frame) >= least, F.stddev_samp("net").over(frame) * year)
    long = F.when(F.count("net").over(whole) >= least, F.stddev_samp("net").over(whole) * year)
    lever = F.least(divide(F.lit(target), sd), cap * divide(F.lit(target), long))
    return daily.select("date", F.when(sd.isNotNull(), lever).alias("leverage"), (F.when(sd.isNotNull(), lever) * F.col("net")).alias("r"))


def irregular_average(bars: DataFrame, tau_ms: float) -> DataFrame:
    """Exponential average over irregular times, Σ x exp(t / τ) / Σ exp(t / τ), within each symbol and day: times are counted from the day's start, so the weights stay finite."""
    day = F.expr(f"start_ms div {DAY}")
    w = Window.partitionBy("symbol", "day").orderBy("start_ms", "bar").rowsBetween(Window.unboundedPreceding, 0)
    x = bars.withColumn("day", day).withColumn("e", F.exp((F.col("start_ms") - F.col("day") * DAY) / tau_ms))
    return x.select("symbol", "bar", "start_ms", divide(F.sum(F.col("close") * F.col("e")).over(w), F.sum("e").over(w)).alias("average"))
