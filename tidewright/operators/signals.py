"""Trend and breakout signals that windows can express. Each takes the panel (asset, date, open, high, low, close, …)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import by_asset, divide, rolling, trailing, upto, warm
from tidewright.operators.rolling import efficiency_ratio, fill_forward, persist, row_index, simple_return, trend_t, weighted_average


def past_return(p: Column, lookback: int, skip: int = 0) -> Column:
    w = by_asset()
    return divide(F.lag(p, skip).over(w) if skip else p, F.lag(p, skip + lookback).over(w)) - 1


def momentum_table(panel: DataFrame, lookback: int = 60, skip: int = 5, fast: int = 10, slow: int = 40, horizons: tuple[int, ...] = (20, 60, 120)) -> DataFrame:
    """Past return with a skip, risk-adjusted return, mean sign of several horizons, price against its mean, two means, range position, efficiency ratio."""
    w, c = by_asset(), F.col("close")
    base = panel.select("asset", "date", "high", "low", "close", simple_return(c).alias("r"), F.abs(c - F.lag(c).over(w)).alias("moved"))
    past = past_return(c, lookback, skip)
    vol = rolling(F.stddev_samp, F.col("r"), w, lookback, lag=skip)
    multi = sum((F.signum(past_return(c, h)) for h in horizons[1:]), F.signum(past_return(c, horizons[0]))) / len(horizons)
    high, low = rolling(F.max, F.col("high"), w, lookback), rolling(F.min, F.col("low"), w, lookback)
    return base.select(
        "asset",
        "date",
        past.alias("past"),
        divide(past, vol * lookback**0.5).alias("risk_adjusted"),
        multi.alias("multi_sign"),
        F.signum(c / rolling(F.avg, c, w, slow) - 1).alias("sma_sign"),
        F.signum(rolling(F.avg, c, w, fast) - rolling(F.avg, c, w, slow)).alias("cross"),
        (2 * divide(c - low, high - low) - 1).alias("range_position"),
        efficiency_ratio(c, F.col("moved"), fast).alias("efficiency"),
    )


def hull(panel: DataFrame, n: int = 16) -> DataFrame:
    """Hull average, WMA(2 WMA(n/2) - WMA(n), sqrt n), and the sign of its change."""
    base = panel.select("asset", "date", F.col("close").alias("x"), row_index().cast("double").alias("i"))
    inner = base.select("asset", "date", "i", (2 * weighted_average(F.col("x"), F.col("i"), n // 2) - weighted_average(F.col("x"), F.col("i"), n)).alias("y"))
    out = inner.select("asset", "date", weighted_average(F.col("y"), F.col("i"), round(n**0.5)).alias("hull"))
    return out.select("asset", "date", "hull", F.signum(F.col("hull") - F.lag("hull").over(by_asset())).alias("signal"))


def bollinger_state(panel: DataFrame, n: int = 20, k: float = 1.0) -> DataFrame:
    """+1 after a close above mean + k sd, -1 after one below mean - k sd, kept until the other; 0 before."""
    w, c = by_asset(), F.col("close")
    base = panel.select("asset", "date", "close", rolling(F.avg, c, w, n).alias("m"), rolling(F.stddev_samp, c, w, n).alias("s"))
    state = F.when(c > F.col("m") + k * F.col("s"), 1).when(c < F.col("m") - k * F.col("s"), -1)
    return base.select("asset", "date", persist(state).alias("state"))


def pivot_breakout(panel: DataFrame, k: int = 3) -> DataFrame:
    """A swing high (highest of k bars on either side) counts k bars later; a close above the last one gives +1, below the last swing low -1; kept."""
    w = by_asset()
    around = w.rowsBetween(-k, k)
    full = F.count("*").over(around) == 2 * k + 1
    base = panel.select("asset", "date", "close", F.when(full & (F.col("high") == F.max("high").over(around)), F.col("high")).alias("top"), F.when(full & (F.col("low") == F.min("low").over(around)), F.col("low")).alias("bottom"))
    known = base.select("asset", "date", "close", F.lag("top", k).over(w).alias("top"), F.lag("bottom", k).over(w).alias("bottom"))
    last = known.select("asset", "date", "close", fill_forward(F.col("top")).alias("top"), fill_forward(F.col("bottom")).alias("bottom"))
    return last.select("asset", "date", "top", "bottom", persist(F.when(F.col("close") > F.col("top"), 1).when(F.col("close") < F.col("bottom"), -1)).alias("state"))


def darvas(panel: DataFrame, lookback: int = 40, confirm: int = 3) -> DataFrame:
    """Box top: the high ``confirm`` bars ago that was the highest of ``lookback`` and is unexceeded since; box bottom: the lowest low since. A close outside sets the state."""
    w = by_asset()
    then = trailing(w, lookback, confirm)
    since = w.rowsBetween(-(confirm - 1), 0)
    old = F.lag("high", confirm).over(w)
    is_top = (F.count("high").over(then) >= lookback) & (old == F.max("high").over(then)) & (F.max("high").over(since) < old)
    base = panel.select("asset", "date", "close", F.when(is_top, old).alias("top"), F.when(is_top, F.min("low").over(w.rowsBetween(-confirm, 0))).alias("bottom"))
    box = base.select("asset", "date", "close", fill_forward(F.col("top")).alias("top"), fill_forward(F.col("bottom")).alias("bottom"))
    return box.select("asset", "date", "top", "bottom", persist(F.when(F.col("close") > F.col("top"), 1).when(F.col("close") < F.col("bottom"), -1)).alias("state"))


def runs(df: DataFrame, signal: str = "signal") -> DataFrame:
    """Adds ``run``: a number that changes with the signal, by asset."""
    w = by_asset()
    changed = F.coalesce((F.col(signal) != F.lag(signal).over(w)).cast("int"), F.lit(1))
    return df.withColumn("__c", changed).withColumn("run", F.sum("__c").over(upto(w))).drop("__c")


def attach_filters(df: DataFrame) -> DataFrame:
    """(asset, date, signal, filter 0/1): the filter attached independently (a), at the run's first day (b), from its first day in the run (c), and runs skipped that begin with it (skip)."""
    w = Window.partitionBy("asset", "run").orderBy("date")
    f = F.col("filter")
    first = F.first(f).over(upto(w))
    return runs(df).select(
        "asset",
        "date",
        "signal",
        (F.col("signal") * f).alias("a"),
        (F.col("signal") * first).alias("b"),
        (F.col("signal") * F.max(f).over(upto(w))).alias("c"),
        (F.col("signal") * (1 - first)).alias("skip"),
    )


def take_profit(df: DataFrame, k: float = 3.0, horizon: int = 20) -> DataFrame:
    """(asset, date, close, signal, vol): flat from the day after the gain since the signal's last change reaches k units of the vol at entry over sqrt(horizon), until the signal changes."""
    w = Window.partitionBy("asset", "run").orderBy("date")
    base = runs(df.withColumn("r", simple_return(F.col("close"))))
    entry = F.first("vol").over(upto(w))
    gain = F.coalesce(F.sum(F.col("signal") * F.col("r")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) - F.coalesce(F.first(F.col("signal") * F.col("r")).over(upto(w)), F.lit(0.0))
    scored = base.select("asset", "date", "signal", "run", (gain >= k * entry * horizon**0.5).cast("int").alias("hit"), gain.alias("gain"))
    done = F.coalesce(F.max("hit").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return scored.select("asset", "date", "signal", "gain", F.when(done == 1, 0).otherwise(F.col("signal")).alias("position"))


def vote(df: DataFrame, members: list[str]) -> DataFrame:
    """Mean of the members that are not null, and the sign of the sum of their signs."""
    x = [F.col(m) for m in members]
    there = sum((m.isNotNull().cast("int") for m in x[1:]), x[0].isNotNull().cast("int"))
    total = sum((F.coalesce(m, F.lit(0.0)) for m in x[1:]), F.coalesce(x[0], F.lit(0.0)))
    signs = sum((F.coalesce(F.signum(m), F.lit(0.0)) for m in x[1:]), F.coalesce(F.signum(x[0]), F.lit(0.0)))
    return df.select("asset", "date", divide(total, there.cast("double")).alias("mean"), F.when(there > 0, F.signum(signs)).alias("majority"))


#: Time frames of the full catalogue in trading days: one to twelve months.
TIME_FRAMES = (21, 42, 63, 84, 126, 189, 252)


def full_catalogue(panel: DataFrame, frames: tuple[int, ...] = TIME_FRAMES) -> DataFrame:
    """(asset, date, family, frame, kind, signal): fourteen families of trend signals on one grid of time frames, and the past year without its last month.

    A family's other parameters follow from the frame. ``kind`` is sign, continuous (within -1 and 1) or state (0 is flat). Windows express most; averages that adapt and states that
    depend on themselves run once an asset, all frames together. Rows without a signal are left out.
    """
    from tidewright.operators import kernels as k

    w, c = by_asset(), F.col("close")
    base = panel.select("asset", "date", "high", "low", "close", F.ln("close").alias("y"), row_index().cast("double").alias("i"), simple_return(c).alias("r"))
    half = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x / 2, F.lit(-1.0)), F.lit(1.0)))
    adjusted = lambda n, skip=0: divide(past_return(c, n, skip), rolling(F.stddev_samp, F.col("r"), w, n, lag=skip) * n**0.5)
    made = [("pure_momentum_skip", 252, "sign", F.signum(past_return(c, 252, 21))), ("risk_adjusted_skip", 252, "continuous", half(adjusted(252, 21)))]
    for n in frames:
        high, low, mean = rolling(F.max, c, w, n), rolling(F.min, c, w, n), rolling(F.avg, c, w, n)
        made += [
            ("pure_momentum", n, "sign", F.signum(past_return(c, n))),
            ("risk_adjusted", n, "continuous", half(adjusted(n))),
            ("trend_t", n, "continuous", half(trend_t(F.col("y"), F.col("i"), n))),
            ("price_sma", n, "sign", F.signum(c - mean)),
            ("dual_sma", n, "sign", F.signum(rolling(F.avg, c, w, max(5, n // 4)) - mean)),
            ("range_position", n, "continuous", 2 * divide(c - low, high - low) - 1),
        ]
    wide = base.select("asset", "date", *[s.alias(f"s{j}") for j, (*_, s) in enumerate(made)])
    named = lambda j: F.struct(F.lit(made[j][0]).alias("family"), F.lit(made[j][1]).alias("frame"), F.lit(made[j][2]).alias("kind"), F.col(f"s{j}").alias("signal"))
    out = wide.select("asset", "date", F.inline(F.array(*map(named, range(len(made))))))

    def recursions(n: int) -> dict:
        a = lambda d: tuple(d[x].to_numpy(float) for x in ("high", "low", "close"))
        average = lambda d, half_life: k.ema(np.log(d["close"].to_numpy(float)), k.halflife_alpha(half_life), adjust=True)
        fast, slow = max(5, round(n / 5)), max(10, round(n / 2))
        return {
            ("ewma_cross", "sign"): lambda d: np.sign(average(d, max(3, n / 8)) - average(d, n / 2)),
            ("kama_cross", "sign"): lambda d: np.nan_to_num(np.sign(d["close"].to_numpy(float) - k.kama(d["close"].to_numpy(float), fast, 2, slow))),
            ("donchian", "state"): lambda d: k.donchian(*a(d), n, max(5, n // 3)),
            ("supertrend", "sign"): lambda d: k.supertrend(*a(d), max(7, round(n / 5)), 3.0),
            ("chandelier", "state"): lambda d: k.chandelier(*a(d), n, 3.0, 20),
            ("kama_filter", "sign"): lambda d: k.kama_state(d["close"].to_numpy(float), 0.5, 20, fast, slow),
        }

    kinds = [(*name, n, f) for n in frames for name, f in recursions(n).items()]
    each = k.per_asset(panel.select("asset", "date", "high", "low", "close"), {f"s{j}": x[3] for j, x in enumerate(kinds)})
    rows = F.array(*[F.struct(F.lit(x[0]).alias("family"), F.lit(x[2]).alias("frame"), F.lit(x[1]).alias("kind"), F.col(f"s{j}").alias("signal")) for j, x in enumerate(kinds)])
    out = out.unionByName(each.select("asset", "date", F.inline(rows)))
    for n in frames:
        for family, df in (("pivot", pivot_breakout(panel, max(3, round(n / 10)))), ("darvas", darvas(panel, n, max(3, round(n / 20))))):
            out = out.unionByName(df.select("asset", "date", F.lit(family).alias("family"), F.lit(n).alias("frame"), F.lit("state").alias("kind"), F.col("state").cast("double").alias("signal")))
    return out.where("signal IS NOT NULL AND NOT isnan(signal)")


def catalogue(panel: DataFrame, lookbacks: tuple[int, ...] = (10, 20, 40, 60, 120)) -> DataFrame:
    """(asset, date, family, lookback, signal): families of simple signals times lookbacks, as rows."""
    w, c = by_asset(), F.col("close")
    base = panel.select("asset", "date", "high", "low", "close")
    made = []
    for n in lookbacks:
        high, low = rolling(F.max, F.col("high"), w, n), rolling(F.min, F.col("low"), w, n)
        made += [
            ("tsmom", n, F.signum(past_return(c, n))),
            ("sma", n, F.signum(c / rolling(F.avg, c, w, n) - 1)),
            ("range", n, F.signum(2 * divide(c - low, high - low) - 1)),
        ]
    wide = base.select("asset", "date", *[s.alias(f"{f}_{n}") for f, n, s in made])
    entries = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("lookback"), F.col(f"{f}_{n}").alias("signal")) for f, n, _ in made])
    return wide.select("asset", "date", F.inline(entries)).where("signal IS NOT NULL")
