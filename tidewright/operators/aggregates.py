"""Aggregations: exact and binned quantiles, concentration, moments, mergeable correlations and AUC, calendar buckets, top-k, shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import divide


def nearest_quantiles(df: DataFrame, keys: list[str], x: str, qs: list[float]) -> DataFrame:
    """Quantiles by the nearest rank, round(q (n - 1)). Values are counted first, so ranks run over distinct values, not rows."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(x)
    ranked = counts.select(*keys, x, F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))
    # half ranks go up: floor(q (n - 1) + 0.5) is the zero-based rank
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("n") - 1) + 0.5), F.col(x))).alias(f"q{str(q).replace('0.', '')}") for q in qs])


def log_bin(x: Column, width: float = 0.05, top: float = 8.999) -> Column:
    return F.floor(F.least(F.greatest(F.log10(x), F.lit(0.0)), F.lit(top)) / width)


def binned(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, bin, n, total): a histogram on a log scale that adds up across months or partitions."""
    return df.groupBy(*keys, log_bin(F.col(x)).alias("bin")).agg(F.count("*").alias("n"), F.sum(x).alias("total"))


def binned_quantile(bins: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Lower edge of the bin in which the q-th of the counts falls."""
    w = Window.partitionBy(*keys)
    run = bins.select(*keys, "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    return run.where(F.col("upto") >= q * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("bin"))


def concentration(bins: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """Share of the total in the largest ``share`` of counts, interpolated within the bin, and the tail exponent: minus the slope of ln survival on the log size."""
    w = Window.partitionBy(*keys)
    run = bins.select(*keys, "bin", "n", "total", F.sum("n").over(w.orderBy(F.desc("bin"))).alias("above"), F.sum("total").over(w.orderBy(F.desc("bin"))).alias("t_above"), F.sum("n").over(w).alias("all"), F.sum("total").over(w).alias("t_all"))
    want = share * F.col("all")
    part = F.least(F.greatest((want - (F.col("above") - F.col("n"))) / F.col("n"), F.lit(0.0)), F.lit(1.0))
    return run.groupBy(*keys).agg(
        divide(F.sum(part * F.col("total")), F.max("t_all").cast("double")).alias("top_share"),
        (-F.regr_slope(F.ln(F.col("above") / F.col("all")), F.col("bin") * 0.05 * 2.302585092994046)).alias("tail"),
    )


def shape(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Bias-adjusted skewness and excess kurtosis, and the robust ones of Bowley (quartiles) and Moors (octiles)."""
    n = F.count(x).cast("double")
    s = lambda k: F.sum(F.pow(F.col(x), F.lit(float(k))))
    m = F.avg(x)
    m2 = s(2) / n - m * m
    m3 = s(3) / n - 3 * m * s(2) / n + 2 * m * m * m
    m4 = s(4) / n - 4 * m * s(3) / n + 6 * m * m * s(2) / n - 3 * m * m * m * m
    o = F.percentile(x, F.array(*[F.lit(k / 8) for k in range(1, 8)]))
    p = lambda i: o[i - 1]
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        (F.sqrt(n * (n - 1)) / (n - 2) * divide(m3, F.pow(m2, F.lit(1.5)))).alias("skew"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (divide(m4, m2 * m2) - 3) + 6)).alias("kurtosis"),
        divide(p(6) + p(2) - 2 * p(4), p(6) - p(2)).alias("bowley"),
        divide(p(7) - p(5) + p(3) - p(1), p(6) - p(2)).alias("moors"),
    )


def lag_sums(df: DataFrame, keys: list[str], order: list[str], x: str, lags: list[int]) -> DataFrame:
    """(keys, lag, n, sx, sy, sxx, syy, sxy) of values and their lags: partials that add up across days."""
    w = Window.partitionBy(*keys).orderBy(*order)
    lagged = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag(x, k).over(w).cast("double").alias("y")) for k in lags])
    each = df.select(*keys, F.col(x).cast("double").alias("x"), lagged.alias("ls")).select(*keys, "x", F.inline("ls"))
    there = each.where("y IS NOT NULL AND x IS NOT NULL")
    return there.groupBy(*keys, "lag").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))


def lag_correlation(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation at each lag, from added partial sums."""
    t = sums.groupBy(*keys, "lag").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    sd = F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n))
    return t.select(*keys, "lag", "n", divide(cov, sd).alias("corr"))


def auc_from_bins(df: DataFrame, keys: list[str], score: str, up: str, bins: int = 4000) -> DataFrame:
    """AUC of a score in [0, 1] from counts by bin, which add up across days: ties within a bin count half."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    counts = df.groupBy(*keys, b.alias("b")).agg(F.count_if(F.col(up)).alias("u"), F.count_if(~F.col(up)).alias("d"))
    w = Window.partitionBy(*keys).orderBy("b")
    below = F.sum("d").over(w) - F.col("d")
    each = counts.select(*keys, "u", "d", (F.col("u") * (below + 0.5 * F.col("d"))).alias("won"))
    return each.groupBy(*keys).agg(divide(F.sum("won"), (F.sum("u") * F.sum("d")).cast("double")).alias("auc"), F.sum("u").alias("n_up"), F.sum("d").alias("n_down"))


def friday_week(date: Column) -> Column:
    """The Friday that ends a date's week."""
    return F.date_add(F.trunc(F.date_add(date, 2), "week"), 4)


def resample(panel: DataFrame, bucket: Column) -> DataFrame:
    """Open, high, low, close, volume and bars by asset and calendar bucket."""
    return panel.groupBy("asset", bucket.alias("bucket")).agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("bars"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key. The rank filter is pushed below the shuffle, so each task sends k rows a key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def shuffled(df: DataFrame, block: list[str], id_col: str, value: str, seed: int = 0) -> DataFrame:
    """``value`` permuted within each block by an arithmetic hash of the ids, the same on every engine and run."""
    mixed = (F.col(id_col) * 1103515245 + 12345 + seed) % 2147483648
    a = df.withColumn("__i", F.row_number().over(Window.partitionBy(*block).orderBy(id_col)))
    b = df.select(*block, F.row_number().over(Window.partitionBy(*block).orderBy(mixed, id_col)).alias("__i"), F.col(value).alias("shuffled"))
    return a.join(b, [*block, "__i"]).drop("__i")
