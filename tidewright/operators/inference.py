"""Tests and resampling. Draws come from arithmetic hashes of (seed, replicate, position), so results are the same on every engine and run."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import normal
from tidewright.functions.windows import divide

MODULUS = 2147483648


def draw(*parts: Column | int) -> Column:
    """A pseudorandom integer below 2^31 from integers, by a linear congruential chain."""
    out = F.lit(12345).cast("long")
    for p in parts:
        p = F.lit(p) if isinstance(p, int) else p
        out = ((out + p.cast("long") * 40503) % MODULUS * 1103515245 + 12345) % MODULUS
    return F.shiftright(out, 7)


def draw_sql(*parts: str) -> str:
    out = "12345::BIGINT"
    for p in parts:
        out = f"((({out} + ({p})::BIGINT * 40503) % {MODULUS} * 1103515245 + 12345) % {MODULUS})"
    return f"({out} >> 7)"


def ols(df: DataFrame, y: str, x: str, lags: int = 6, order: str = "date") -> DataFrame:
    """Intercept and slope with Newey-West t statistics (Bartlett weights), R², from one pass of sums over rows joined to their residuals.

    One series; residuals and lagged products are windows over days.
    """
    there = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(F.col(order).alias("o"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    n, s = F.count("*"), lambda c: F.sum(c)
    fit = there.agg(n.alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_r2("y", "x").alias("r2"), s("x").alias("sx"), s(F.col("x") * F.col("x")).alias("sxx"))
    w = Window.orderBy("o")
    e = there.crossJoin(F.broadcast(fit)).select("o", "x", (F.col("y") - F.col("a") - F.col("b") * F.col("x")).alias("e"))  # one row
    # meat: Σ_k w_k Σ_t (s_t s_{t-k}' + s_{t-k} s_t') of scores s = (e, e x)
    scored = e.select("o", F.col("e").alias("u"), (F.col("e") * F.col("x")).alias("v"))
    lagged = F.array(*[F.struct(F.lit(1.0 if k == 0 else 2 * (1 - k / (lags + 1))).alias("w"), F.lag("u", k).over(w).alias("lu"), F.lag("v", k).over(w).alias("lv")) for k in range(lags + 1)])
    each = scored.select("u", "v", lagged.alias("l")).select("u", "v", F.inline("l"))
    meat = each.agg(s(F.col("w") * F.col("u") * F.col("lu")).alias("m11"), s(F.col("w") * (F.col("u") * F.col("lv") + F.col("v") * F.col("lu")) / 2).alias("m12"), s(F.col("w") * F.col("v") * F.col("lv")).alias("m22"))
    c = F.col
    both = fit.crossJoin(meat)  # one row each
    det = c("n") * c("sxx") - c("sx") * c("sx")
    i11, i12, i22 = c("sxx") / det, -c("sx") / det, c("n") / det
    va = i11 * i11 * c("m11") + 2 * i11 * i12 * c("m12") + i12 * i12 * c("m22")
    vb = i12 * i12 * c("m11") + 2 * i12 * i22 * c("m12") + i22 * i22 * c("m22")
    return both.select("n", "a", "b", "r2", divide(c("a"), F.sqrt(va)).alias("t_a"), divide(c("b"), F.sqrt(vb)).alias("t_b"))


def ols_several(df: DataFrame, y: str, xs: list[str], lags: int = 6, order: str = "date") -> DataFrame:
    """(name, coef, t, n, r2): least squares of y on several columns with Newey-West t statistics, the intercept first; no rows where they are not defined.

    One series. Two aggregations give the sums of products and those of the lagged scores; these, whose number is the square of that of the columns, reach the driver.
    """
    spark, names = df.sparkSession, ["intercept", *xs]
    k = len(names)
    rows = df.select(F.col(order).alias("o"), F.col(y).cast("double").alias("y"), *[F.col(x).cast("double").alias(f"x{j}") for j, x in enumerate(xs, 1)]).dropna().withColumn("x0", F.lit(1.0))
    X = [F.col(f"x{j}") for j in range(k)]
    got = rows.agg(F.count("*"), F.sum(F.col("y") * F.col("y")), *[F.sum(c * F.col("y")) for c in X], *[F.sum(a * b) for a in X for b in X]).first()
    schema = "name string, coef double, t double, n long, r2 double"
    n = int(got[0])
    if n <= k:
        return spark.createDataFrame([], schema)
    v, m = np.array(got[2 : 2 + k], float), np.array(got[2 + k :], float).reshape(k, k)
    inverse = np.linalg.pinv(m)
    b = inverse @ v
    left = F.col("y") - sum((float(b[j]) * X[j] for j in range(1, k)), F.lit(float(b[0])))
    w = Window.orderBy("o")  # one row a period
    scores = rows.select("o", *[(left * X[j]).alias(f"s{j}") for j in range(k)])
    lagged = scores.select("*", *[F.lag(f"s{j}", d).over(w).alias(f"l{d}_{j}") for d in range(1, lags + 1) for j in range(k)])
    meat = lagged.agg(*[F.coalesce(F.sum(F.col(f"s{i}") * F.col(f"s{j}" if d == 0 else f"l{d}_{j}")), F.lit(0.0)) for d in range(lags + 1) for i in range(k) for j in range(k)]).first()
    g = np.array(meat, float).reshape(lags + 1, k, k)
    s = g[0] + sum((1 - d / (lags + 1)) * (g[d] + g[d].T) for d in range(1, lags + 1))
    error = np.sqrt(np.diag(inverse @ s @ inverse))
    total = float(got[1]) - v[0] ** 2 / n
    r2 = float((b @ v - v[0] ** 2 / n) / total) if total > 0 else None
    return spark.createDataFrame([(x, float(c), float(c / e) if e > 0 else None, n, r2) for x, c, e in zip(names, b, error, strict=True)], schema)


def clustered_mean(df: DataFrame, keys: list[str], x: str, cluster: str) -> DataFrame:
    """Mean with a standard error clustered by ``cluster``, G / (G - 1) corrected, from sums per cluster."""
    per = df.where(F.col(x).isNotNull()).groupBy(*keys, cluster).agg(F.sum(x).alias("s"), F.count(x).alias("k"))
    n, g, mean = F.sum("k"), F.count("*"), F.sum("s") / F.sum("k")
    # Σ (s - k m)² = Σ s² - 2 m Σ s k + m² Σ k²
    squares = F.sum(F.col("s") * F.col("s")) - 2 * mean * F.sum(F.col("s") * F.col("k")) + mean * mean * F.sum(F.col("k") * F.col("k"))
    return per.groupBy(*keys).agg(mean.alias("mean"), (F.sqrt(F.greatest(squares, F.lit(0.0)) * g / (g - 1)) / n).alias("se"), g.alias("clusters"), n.alias("n"))


def benjamini_hochberg(df: DataFrame, p: str, level: float = 0.05) -> DataFrame:
    """Adds q, the monotone adjusted p, and whether it is within the level."""
    n = F.count(p).over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy(F.col(p).asc_nulls_last(), *[c for c in df.columns if c != p]))
    ranked = df.withColumn("__q", F.least(F.col(p) * n / i, F.lit(1.0))).withColumn("__i", i)
    q = F.min("__q").over(Window.orderBy(F.desc("__i")))
    return ranked.withColumn("q", q).withColumn("rejected", F.col("q") <= level).drop("__q", "__i")


#: Up to so many values the binomial tail is summed term by term; beyond it the normal approximation is closer than a thousandth of p.
EXACT_SIGNS = 10_000


def binomial_tail(n: Column, k: Column) -> Column:
    """P(X <= k) of n fair tosses: terms as multiples of the k-th, downwards and upwards, so none is too small to count."""
    n, k = n.cast("double"), k.cast("double")
    step = lambda ratio: lambda s, i: F.struct((s["t"] * ratio(i)).alias("t"), (s["sum"] + s["t"] * ratio(i)).alias("sum"))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("sum"))
    count = lambda m: F.when(m > 0, F.sequence(F.lit(1), m.cast("int"))).otherwise(F.array().cast("array<int>"))
    below = F.aggregate(count(k), start, step(lambda i: (k - i + 1) / (n - k + i)))["sum"]
    above = F.aggregate(count(n - k), start, step(lambda i: (n - k - i + 1) / (k + i)))["sum"]
    return (1 + below) / (1 + below + above)


def sign_test(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Two-sided binomial p of the number of positive values: exact up to ``EXACT_SIGNS`` values, by the normal approximation with continuity correction beyond."""
    n, k = F.col("n"), F.col("positive")
    counts = df.groupBy(*keys).agg(F.count_if(F.col(x) != 0).alias("n"), F.count_if(F.col(x) > 0).alias("positive"))
    z = divide(F.abs(k - n / 2) - 0.5, F.sqrt(n) / 2)
    p = F.when(n <= EXACT_SIGNS, binomial_tail(n, F.least(k, n - k))).otherwise(1 - normal.cdf(F.greatest(z, F.lit(0.0))))
    return counts.withColumn("p", F.least(2 * p, F.lit(1.0)))


def bucket_of(df: DataFrame, x: str, n: int = 64) -> Column:
    """Index of the bucket that holds x, from at most n approximate quantiles: larger x never has a smaller index. Only the bounds reach the driver."""
    bounds = df.agg(F.percentile_approx(x, F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(2000))).first()[0] or []
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))) if bounds else F.array().cast("array<double>"), lambda b: b < F.col(x)))


def rank_auc(df: DataFrame, score: str, up: str) -> DataFrame:
    """Exact AUC by rank sum, ties averaged: values are counted first, then counted up within buckets of the scores and over the buckets, so no task holds all scores."""
    c = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(up)).alias("u"), F.count_if(~F.col(up)).alias("d")).withColumn("b", bucket_of(df, score))
    within = F.sum("d").over(Window.partitionBy("b").orderBy(score)) - F.col("d")
    starts = c.groupBy("b").agg(F.sum("d").alias("s")).select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("start"))
    won = c.withColumn("within", within).join(F.broadcast(starts), "b")  # one row a bucket
    return won.select("u", "d", (F.col("u") * (F.col("start") + F.col("within") + 0.5 * F.col("d"))).alias("won")).agg(divide(F.sum("won"), (F.sum("u") * F.sum("d")).cast("double")).alias("auc"), F.sum("u").alias("n_up"), F.sum("d").alias("n_down"))


def bootstrap_means(df: DataFrame, cluster: str, x: str, replicates: int, seed: int = 0) -> DataFrame:
    """Means of ``x`` over clusters drawn with replacement. Only sums per cluster are resampled: replicates times clusters rows."""
    spark = df.sparkSession
    sums = df.where(F.col(x).isNotNull()).groupBy(cluster).agg(F.sum(x).alias("s"), F.count(x).alias("k"))
    numbered = sums.select((F.row_number().over(Window.orderBy(cluster)) - 1).alias("i"), "s", "k")
    size = numbered.agg(F.count("*").alias("g"))
    reps = spark.range(replicates).select(F.col("id").alias("rep")).crossJoin(F.broadcast(size)).where("g > 0")  # one row
    picks = reps.select("rep", "g", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j")).select("rep", (draw(F.lit(seed), F.col("rep"), F.col("j")) % F.col("g")).cast("int").alias("i"))
    return picks.join(numbered, "i").groupBy("rep").agg((F.sum("s") / F.sum("k")).alias("mean"))


def block_bootstrap(df: DataFrame, order: str, x: str, block: int, replicates: int, seed: int = 0) -> DataFrame:
    """Means over contiguous blocks of ``block`` rows drawn with replacement, through sums of each block that could be drawn."""
    spark = df.sparkSession
    w = Window.orderBy(order)
    rows = df.where(F.col(x).isNotNull()).select((F.row_number().over(w) - 1).alias("i"), F.sum(x).over(w.rowsBetween(0, block - 1)).alias("s"), F.count(x).over(w.rowsBetween(0, block - 1)).alias("k")).where(F.col("k") == block)
    size = rows.agg(F.count("*").alias("g"))
    reps = spark.range(replicates).select(F.col("id").alias("rep")).crossJoin(F.broadcast(size)).where("g > 0")  # one row
    picks = reps.select("rep", "g", F.explode(F.sequence(F.lit(0), F.ceil(F.col("g") / block) - 1)).alias("j")).select("rep", (draw(F.lit(seed), F.col("rep"), F.col("j")) % F.col("g")).cast("int").alias("i"))
    return picks.join(rows, "i").groupBy("rep").agg((F.sum("s") / F.sum("k")).alias("mean"))


def permutation_p(df: DataFrame, position: str, ret: str, order: str, replicates: int, seed: int = 0) -> DataFrame:
    """Share of rotations of the position against the returns that do at least as well: (1 + wins) / (1 + replicates)."""
    spark = df.sparkSession
    w = Window.orderBy(order)
    rows = df.where(F.col(position).isNotNull() & F.col(ret).isNotNull()).select((F.row_number().over(w) - 1).alias("i"), F.col(position).cast("double").alias("p"), F.col(ret).alias("r"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.col("p") * F.col("r")).alias("own"))
    reps = spark.range(replicates).select(F.col("id").alias("rep")).crossJoin(F.broadcast(size)).select("rep", "n", "own", (draw(F.lit(seed), F.col("rep")) % (F.col("n") - 1) + 1).alias("k"))
    moved = rows.select("i", "p").crossJoin(F.broadcast(reps)).select("rep", "own", ((F.col("i") + F.col("k")) % F.col("n")).cast("int").alias("i"), "p")  # replicates is a fixed, small number
    scored = moved.join(rows.select("i", "r"), "i").groupBy("rep").agg(F.sum(F.col("p") * F.col("r")).alias("score"), F.max("own").alias("own"))
    return scored.agg(F.max("own").alias("own"), ((1 + F.count_if(F.col("score") >= F.col("own"))) / (1.0 + replicates)).alias("p"))


def overfitting(streams: DataFrame, blocks: int = 6) -> DataFrame:
    """Probability of backtest overfitting: of all halves of the blocks, the share in which the best stream of one half is below the median of the other; and the mean logit of its rank.

    Block sums are joined to the table of splits, C(blocks, blocks / 2) rows, so the series are read once.
    """
    spark = streams.sparkSession
    dates = streams.select("date").distinct().select("date", (F.ntile(blocks).over(Window.orderBy("date")) - 1).alias("block"))
    sums = streams.join(dates, "date").groupBy("stream", "block").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.count("r").alias("n"))
    splits = [(i, b, b in inside) for i, inside in enumerate(itertools.combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    table = spark.createDataFrame(splits, "split int, block int, inside boolean")
    half = sums.join(F.broadcast(table), "block").groupBy("split", "stream", "inside").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    sharpe = divide(F.col("s") / F.col("n"), F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))))
    wide = half.select("split", "stream", "inside", sharpe.alias("x")).groupBy("split", "stream").agg(F.max(F.when(F.col("inside"), F.col("x"))).alias("a"), F.max(F.when(~F.col("inside"), F.col("x"))).alias("b"))
    w = Window.partitionBy("split")
    ranked = wide.select("split", "stream", F.row_number().over(w.orderBy(F.desc("a"), "stream")).alias("best"), (F.rank().over(w.orderBy("b")) / (F.count("*").over(w) + 1.0)).alias("omega")).where("best = 1")
    return ranked.agg(F.avg((F.col("omega") <= 0.5).cast("double")).alias("pbo"), F.avg(F.ln(F.col("omega") / (1 - F.col("omega")))).alias("logit"), F.count("*").alias("splits"))


def deflated_sharpe(streams: DataFrame) -> DataFrame:
    """The best stream's Sharpe ratio against what the best of as many tries without skill would show."""
    r = F.col("r")
    n, m = F.count("r"), F.avg("r")
    m2 = F.avg(r * r) - m * m
    m3 = F.avg(r * r * r) - 3 * m * F.avg(r * r) + 2 * m * m * m
    m4 = F.avg(r * r * r * r) - 4 * m * F.avg(r * r * r) + 6 * m * m * F.avg(r * r) - 3 * m * m * m * m
    per = streams.groupBy("stream").agg(n.alias("n"), divide(m, F.sqrt(m2)).alias("sr"), divide(m3, F.pow(m2, F.lit(1.5))).alias("g3"), divide(m4, m2 * m2).alias("g4"))
    t = F.count("*").cast("double")
    top = per.agg(F.max_by(F.struct("stream", "n", "sr", "g3", "g4"), F.struct("sr", "stream")).alias("b"), F.stddev_samp("sr").alias("sd"), t.alias("tries"))
    euler = 0.5772156649015329
    base = F.col("sd") * ((1 - euler) * normal.inverse(1 - 1 / F.col("tries")) + euler * normal.inverse(1 - 1 / (F.col("tries") * 2.718281828459045)))
    z = (F.col("b.sr") - base) * F.sqrt(F.col("b.n") - 1) / F.sqrt(1 - F.col("b.g3") * F.col("b.sr") + (F.col("b.g4") - 1) / 4 * F.col("b.sr") * F.col("b.sr"))
    return top.select("b.stream", F.col("b.sr").alias("sharpe"), base.alias("expected"), normal.cdf(z).alias("dsr"), F.col("tries").cast("long").alias("tries"))


def smile(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least squares of y on x and x² from sums (Cramer's rule), and R²."""
    X, Y = F.col(x), F.col(y)
    there = df.where(X.isNotNull() & Y.isNotNull())
    s = {k: F.sum(F.pow(X, F.lit(float(k)))) for k in range(1, 5)}
    sums = there.agg(F.count("*").cast("double").alias("n"), *[e.alias(f"x{k}") for k, e in s.items()], F.sum(Y).alias("y0"), F.sum(X * Y).alias("y1"), F.sum(X * X * Y).alias("y2"), F.sum(Y * Y).alias("yy"))
    c = F.col
    det = lambda a, b, d: a[0] * (b[1] * d[2] - d[1] * b[2]) - b[0] * (a[1] * d[2] - d[1] * a[2]) + d[0] * (a[1] * b[2] - b[1] * a[2])
    k0, k1, k2, rhs = (c("n"), c("x1"), c("x2")), (c("x1"), c("x2"), c("x3")), (c("x2"), c("x3"), c("x4")), (c("y0"), c("y1"), c("y2"))
    d = det(k0, k1, k2)
    b0, b1, b2 = det(rhs, k1, k2) / d, det(k0, rhs, k2) / d, det(k0, k1, rhs) / d
    explained = b0 * c("y0") + b1 * c("y1") + b2 * c("y2") - c("y0") * c("y0") / c("n")
    return sums.select(b0.alias("b0"), b1.alias("b1"), b2.alias("b2"), divide(explained, c("yy") - c("y0") * c("y0") / c("n")).alias("r2"))


def out_of_sample_r2(df: DataFrame, y: str, forecast: str, inside: Column) -> DataFrame:
    """1 - SSE / Σ (y - mean of the first part)² over the second part."""
    m = df.where(inside).agg(F.avg(y).alias("m"))
    return df.where(~inside).crossJoin(F.broadcast(m)).agg((1 - divide(F.sum(F.pow(F.col(y) - F.col(forecast), F.lit(2.0))), F.sum(F.pow(F.col(y) - F.col("m"), F.lit(2.0))))).alias("r2"), F.count("*").alias("n"))


def logit(df: DataFrame, y: str, xs: list[str], rounds: int = 12) -> DataFrame:
    """Logistic regression by Newton's method; each round is one aggregation of the k² sums, and only those reach the driver."""
    import numpy as np

    k = len(xs) + 1
    b = np.zeros(k)
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    there = df.where(F.col(y).isNotNull())
    for x in xs:
        there = there.where(F.col(x).isNotNull())
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((c * float(v) for c, v in zip(cols[1:], b[1:], strict=True)), F.lit(float(b[0])))))
        w = p * (1 - p)
        row = there.agg(*[F.sum(c * (F.col(y) - p)) for c in cols], *[F.sum(w * cols[i] * cols[j]) for i in range(k) for j in range(k)]).first()
        g, h = np.array(row[:k], float), np.array(row[k:], float).reshape(k, k)
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        b += step
        if np.abs(step).max() < 1e-10:
            break
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(h)), 0))
    return df.sparkSession.createDataFrame([(n, float(v), float(v / s) if s > 0 else None) for n, v, s in zip(["intercept", *xs], b, se, strict=True)], "term string, coefficient double, z double")


def split_pass_share(streams: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """Share of random halves of the streams whose mean is positive in both halves: sums per stream joined to a hash per replicate."""
    sums = streams.groupBy("stream").agg(F.sum("r").alias("s"))
    ranked = sums.select((F.row_number().over(Window.orderBy("stream")) - 1).alias("i"), "s")
    half = ranked.select("s", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"), "i").select("rep", "s", (draw(F.lit(seed), F.col("rep"), F.col("i")) % 2 == 0).alias("left"))
    per = half.groupBy("rep").agg(F.coalesce(F.sum(F.when(F.col("left"), F.col("s"))), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(~F.col("left"), F.col("s"))), F.lit(0.0)).alias("b"))
    return per.agg(F.avg(((F.col("a") > 0) & (F.col("b") > 0)).cast("double")).alias("share"), F.count("*").alias("splits"))
