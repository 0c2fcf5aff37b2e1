"""Rolling, expanding and cross-sectional operators over a daily panel, all as windows that Catalyst plans.

Windows by asset need one shuffle on the asset, windows by date one on the date; operators that share a spec share the shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import by_asset, by_date, divide, rolling, trailing, upto, warm


def simple_return(p: Column, k: int = 1) -> Column:
    return divide(p, F.lag(p, k).over(by_asset())) - 1


def log_return(p: Column) -> Column:
    return F.ln(p) - F.ln(F.lag(p).over(by_asset()))


def row_index() -> Column:
    return F.row_number().over(by_asset()) - 1


def trend_t(y: Column, i: Column, n: int) -> Column:
    """t statistic of the slope of y on its row index over n rows; 0 where the fit is exact."""
    frame = trailing(by_asset(), n)
    s = lambda x: F.sum(x).over(frame)
    sxx = n * (n * n - 1) / 12.0
    sxy = s(i * y) - s(i) * s(y) / n
    syy = s(y * y) - s(y) * s(y) / n
    slope = sxy / sxx
    left = F.greatest(syy - slope * sxy, F.lit(0.0))
    se = F.sqrt(left / (n - 2) / sxx)
    return warm(F.when(se > 0, slope / se).otherwise(0.0), y, frame, n)


def trend_r2(y: Column, i: Column, n: int) -> Column:
    """Share of variance that a line explains over n rows; 0 where y is flat."""
    frame = trailing(by_asset(), n)
    s = lambda x: F.sum(x).over(frame)
    sxx = n * (n * n - 1) / 12.0
    sxy = s(i * y) - s(i) * s(y) / n
    syy = s(y * y) - s(y) * s(y) / n
    return warm(F.when(syy > 1e-15, sxy * sxy / (sxx * syy)).otherwise(0.0), y, frame, n)


def weighted_average(x: Column, i: Column, n: int) -> Column:
    """Linear weights 1 … n, the newest heaviest, from two frame sums."""
    frame = trailing(by_asset(), n)
    newest = F.max(i).over(frame)
    return warm((F.sum(i * x).over(frame) - (newest - n) * F.sum(x).over(frame)) / (n * (n + 1) / 2), x, frame, n)


def efficiency_ratio(p: Column, moved: Column, n: int) -> Column:
    """Net change over n rows by the path's length; ``moved`` is the absolute change of each row. 0 where undefined."""
    return F.coalesce(divide(F.abs(p - F.lag(p, n).over(by_asset())), F.sum(moved).over(trailing(by_asset(), n))), F.lit(0.0))


def rolling_table(panel: DataFrame, n: int = 20) -> DataFrame:
    """asset, date and rolling statistics of the close: mean, std, var, min, max, sum, median, quartile, correlation with volume, beta, skew, t, R²."""
    w, c = by_asset(), F.col("close")
    base = panel.select("asset", "date", "close", "volume", row_index().cast("double").alias("i"), simple_return(c).alias("r"), (divide(F.col("volume"), F.lag("volume").over(w)) - 1).alias("v"))
    frame = trailing(w, n)
    m = lambda k: F.sum(F.pow(F.col("r"), F.lit(float(k)))).over(frame)
    mean = m(1) / n
    m2 = m(2) / n - mean * mean
    m3 = m(3) / n - 3 * mean * m(2) / n + 2 * mean * mean * mean
    g1 = divide(m3, F.pow(F.greatest(m2, F.lit(0.0)), F.lit(1.5)))
    sums = lambda a, b: F.sum(a * b).over(frame) - F.sum(a).over(frame) * F.sum(b).over(frame) / n
    r, v = F.col("r"), F.col("v")
    both = F.count(r * v).over(frame) >= n
    return base.select(
        "asset",
        "date",
        rolling(F.avg, c, w, n).alias("mean"),
        rolling(F.stddev_samp, c, w, n).alias("sd"),
        rolling(F.var_samp, c, w, n).alias("variance"),
        rolling(F.min, c, w, n).alias("low"),
        rolling(F.max, c, w, n).alias("high"),
        rolling(F.sum, c, w, n, lag=1).alias("sum_before"),
        warm(F.percentile("close", F.lit(0.5)).over(frame), c, frame, n).alias("median"),
        warm(F.percentile("close", F.lit(0.25)).over(frame), c, frame, n).alias("quartile"),
        F.when(both, divide(sums(r, v), F.sqrt(sums(r, r) * sums(v, v)))).alias("corr"),
        F.when(both, divide(sums(r, v), sums(v, v))).alias("beta"),
        F.when(F.count(r).over(frame) >= n, g1 * (n * (n - 1)) ** 0.5 / (n - 2)).alias("skew"),
        trend_t(F.ln(c), F.col("i"), n).alias("t"),
        trend_r2(F.ln(c), F.col("i"), n).alias("r2"),
        weighted_average(c, F.col("i"), n).alias("wma"),
    )


def expanding_table(panel: DataFrame, least: int = 30) -> DataFrame:
    """Expanding mean, std and count, cumulative growth, its peak, drawdown and days since the last peak, by asset."""
    w = by_asset()
    r = simple_return(F.col("close"))
    base = panel.select("asset", "date", "close", r.alias("r"))
    grown = base.select("*", F.exp(F.sum(F.ln(1 + F.coalesce("r", F.lit(0.0)))).over(upto(w))).alias("growth"))
    peaks = grown.select("*", F.max("growth").over(upto(w)).alias("peak"))
    frame = upto(w)
    return peaks.select(
        "asset",
        "date",
        warm(F.avg("r").over(frame), F.col("r"), frame, least).alias("mean"),
        warm(F.stddev_samp("r").over(frame), F.col("r"), frame, least).alias("sd"),
        F.count("r").over(frame).alias("n"),
        F.col("growth"),
        (F.col("growth") / F.col("peak") - 1).alias("drawdown"),
        F.col("peak"),
    )


def time_range_sum(panel: DataFrame, days: int = 60) -> DataFrame:
    """Sum of volume and number of bars in the last ``days`` calendar days, today included."""
    w = Window.partitionBy("asset").orderBy(F.datediff("date", F.lit("1970-01-01"))).rangeBetween(-(days - 1), 0)
    return panel.select("asset", "date", F.sum("volume").over(w).alias("volume"), F.count("*").over(w).alias("bars"))


def fill_forward(x: Column, limit: int | None = None) -> Column:
    """Last non-null value, at most ``limit`` rows old."""
    w = by_asset()
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def persist(state: Column) -> Column:
    """The last non-null state, 0 before the first."""
    return F.coalesce(fill_forward(state), F.lit(0))


def hold_every(x: Column, i: Column, k: int) -> Column:
    """The value of each k-th row, held until the next."""
    return fill_forward(F.when(i % k == 0, x))


def average_rank(x: Column, descending: bool = False) -> Column:
    """Rank by date with ties averaged; nulls have none."""
    w = by_date().orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last())
    ties = Window.partitionBy("date", x)
    return F.when(x.isNotNull(), F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)


def cross_section(panel: DataFrame, lookback: int = 20, k: int = 2) -> DataFrame:
    """By date: rank, centred rank, z-score, long-short weights of the best and worst k, dual-momentum weights, inverse-volatility weights."""
    w = by_asset()
    r = simple_return(F.col("close"))
    base = panel.select("asset", "date", "close", r.alias("r")).select("asset", "date", simple_return(F.col("close"), lookback).alias("score"), rolling(F.stddev_samp, F.col("r"), w, lookback).alias("vol"))
    d = by_date()
    x = F.col("score")
    n = F.count(x).over(d)
    first = lambda descending: F.row_number().over(d.orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last(), "asset"))
    ranked = base.select(
        "*",
        average_rank(x).alias("rank"),
        n.alias("n"),
        F.when(x.isNotNull(), first(True)).alias("from_top"),
        F.when(x.isNotNull(), first(False)).alias("from_bottom"),
        divide(x - F.avg(x).over(d), F.stddev_pop(x).over(d)).alias("z"),
        divide(F.lit(1.0), F.col("vol")).alias("inverse"),
    )
    top = F.when((F.col("from_top") <= k) & F.col("inverse").isNotNull(), F.col("inverse"))
    low = F.when((F.col("from_bottom") <= k) & F.col("inverse").isNotNull(), F.col("inverse"))
    return ranked.select(
        "asset",
        "date",
        "rank",
        F.when(F.col("n") >= 2, 2 * (F.col("rank") - 1) / (F.col("n") - 1) - 1).alias("centred"),
        F.when(F.col("n") >= 2, F.col("z")).alias("z"),
        divide(F.col("inverse"), F.sum("inverse").over(d)).alias("base_weight"),
        (F.coalesce(0.5 * divide(top, F.sum(top).over(d)), F.lit(0.0)) - F.coalesce(0.5 * divide(low, F.sum(low).over(d)), F.lit(0.0))).alias("long_short"),
        F.when((F.col("from_top") <= k) & (x > 0), F.lit(1.0) / k).otherwise(0.0).alias("dual"),
    )


def breadth(panel: DataFrame, n: int = 60) -> DataFrame:
    """By date: mean absolute correlation of all pairs over the last n common dates, and the share of pairs that moved alike."""
    r = panel.select("asset", "date", simple_return(F.col("close")).alias("r")).where("r IS NOT NULL")
    a, b = r.select(F.col("asset").alias("a"), "date", F.col("r").alias("x")), r.select(F.col("asset").alias("b"), "date", F.col("r").alias("y"))
    pairs = a.join(b, "date").where("a < b")
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(-(n - 1), 0)
    s = lambda c: F.sum(c).over(w)
    x, y = F.col("x"), F.col("y")
    cov = s(x * y) - s(x) * s(y) / n
    corr = divide(cov, F.sqrt((s(x * x) - s(x) * s(x) / n) * (s(y * y) - s(y) * s(y) / n)))
    each = pairs.select("date", F.when(F.count("*").over(w) >= n, corr).alias("rho"), F.avg((F.signum(x) == F.signum(y)).cast("double")).over(w).alias("same"))
    return each.where("rho IS NOT NULL").groupBy("date").agg(F.avg(F.abs("rho")).alias("mean_abs_corr"), F.avg(F.greatest("same", 1 - F.col("same"))).alias("concordance"), F.count("*").alias("pairs"))
