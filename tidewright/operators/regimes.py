"""Macro regimes, carry streams, funding and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import by_asset, divide, rolling, upto

YEAR = 252


def on_hold(changes: DataFrame, days: int = 183) -> DataFrame:
    """(series, date, target): whether the target has not changed in the last ``days`` days."""
    w = Window.partitionBy("series").orderBy("date")
    moved = changes.withColumn("moved", F.coalesce((F.col("target") != F.lag("target").over(w)).cast("int"), F.lit(0))).withColumn("d", F.datediff("date", F.lit("1970-01-01")))
    span = Window.partitionBy("series").orderBy("d").rangeBetween(-days, 0)
    return moved.select("series", "date", "target", (F.sum("moved").over(span) == 0).alias("hold"))


def real_time(vintages: DataFrame, q: float = 0.8) -> DataFrame:
    """(vintage, month, value): |12-month change of the yearly growth|, against the quantile of the vintage's own history."""
    w = Window.partitionBy("vintage").orderBy("month")
    yoy = vintages.withColumn("yoy", divide(F.col("value"), F.lag("value", 12).over(w)) - 1)
    change = yoy.withColumn("x", F.abs(F.col("yoy") - F.lag("yoy", 12).over(w)))
    limit = change.groupBy("vintage").agg(F.percentile("x", F.lit(q)).alias("limit"))
    last = change.groupBy("vintage").agg(F.max_by(F.struct("month", "x"), "month").alias("s"))
    return last.join(limit, "vintage").select("vintage", "s.month", "s.x", "limit", (F.col("s.x") > F.col("limit")).alias("alarm"))


def switches(df: DataFrame, flags: list[str], least: int) -> DataFrame:
    """On where at least ``least`` of the flags are set; null flags are not set. Also: any and all."""
    n = sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags[1:]), F.coalesce(F.col(flags[0]).cast("int"), F.lit(0)))
    return df.withColumn("on", n >= least).withColumn("any", n >= 1).withColumn("all", n == len(flags))


def blend(base: DataFrame, add: DataFrame, weight: float) -> DataFrame:
    """(1 - w) base + w add, with ``add`` scaled to the volatility of ``base`` over the common days."""
    j = base.select("date", F.col("r").alias("b")).join(add.select("date", F.col("r").alias("a")), "date")
    k = j.agg(divide(F.stddev_samp("b"), F.stddev_samp("a")).alias("k"))
    return j.crossJoin(F.broadcast(k)).select("date", ((1 - weight) * F.col("b") + weight * F.col("k") * F.col("a")).alias("r"))  # one row


def fx_carry(spot: Column, foreign: Column, home: Column, days: Column) -> Column:
    """Spot return plus the interest difference over the calendar gap; yields are those of the day before, as rates."""
    return spot + (foreign - home) * days / 365.0


def bond_return(y0: Column, y1: Column, cash: Column) -> Column:
    """Monthly excess return of a ten-year par bond from its yields, by duration."""
    duration = (1 - F.pow(1 + y0, F.lit(-10.0))) / y0
    return y0 / 12 - duration * (y1 - y0) - cash / 12


def funding_rate(premium: Column, interest: float = 0.0001, clamp: float = 0.0005) -> Column:
    return premium + F.least(F.greatest(F.lit(interest) - premium, F.lit(-clamp)), F.lit(clamp))


def funding_paid(positions: DataFrame, rates: DataFrame, hours: int = 8) -> DataFrame:
    """A position open at a settlement pays its rate: the position of the last row before each settlement, joined on the settlement's time."""
    step = hours * 3_600_000
    due = positions.withColumn("settle_ms", (F.floor(F.col("ts_ms") / step) + 1) * step)
    held = due.groupBy("symbol", "settle_ms").agg(F.max_by("position", F.struct("ts_ms", "id")).alias("position"))
    return held.join(rates, ["symbol", "settle_ms"]).select("symbol", "settle_ms", "position", "rate", (-F.col("position") * F.col("rate")).alias("paid"))


def cash_and_carry(basis: DataFrame, cash: float = 0.0) -> DataFrame:
    """(asset, date, basis, funding): daily funding less the change of the basis less cash, and its sum."""
    w = by_asset()
    r = F.coalesce("funding", F.lit(0.0)) - F.coalesce(F.col("basis") - F.lag("basis").over(w), F.lit(0.0)) - cash / YEAR
    return basis.select("asset", "date", r.alias("r")).select("asset", "date", "r", F.sum("r").over(upto(w)).alias("total"))


def decision_hours(tape: DataFrame, hours: int = 6) -> DataFrame:
    """One row per symbol and decision time: price just before, next closes, highs and lows of the two periods after, and activity against the median of 28 before."""
    step = hours * 3_600_000
    at = F.struct("ts_ms", "id")
    bar = tape.groupBy("symbol", F.floor(F.col("ts_ms") / step).alias("h")).agg(F.max_by("tick", at).alias("close"), F.min("tick").alias("low"), F.max("tick").alias("high"), F.count("*").alias("n"))
    w = Window.partitionBy("symbol").orderBy("h")
    before = F.percentile("n", F.lit(0.5)).over(w.rowsBetween(-28, -1))
    return bar.select("symbol", ((F.col("h") + 1) * step).alias("decide_ms"), F.col("close").alias("price"), *[F.lead(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in ("close", "low", "high")], divide(F.col("n").cast("double"), before).alias("activity"))


def target_positions(panel: DataFrame, lookbacks: tuple[int, ...] = (20, 60, 120), target: float = 0.10, vol: int = 20, cap: float = 2.0) -> DataFrame:
    """Mean of the signs of several speeds times target over annual volatility, capped."""
    w = by_asset()
    c = F.col("close")
    base = panel.select("asset", "date", "close", (divide(c, F.lag(c).over(w)) - 1).alias("r"), *[F.signum(divide(c, F.lag(c, n).over(w)) - 1).alias(f"s{n}") for n in lookbacks])
    blend_ = sum((F.col(f"s{n}") for n in lookbacks[1:]), F.col(f"s{lookbacks[0]}")) / len(lookbacks)
    size = divide(F.lit(target), rolling(F.stddev_samp, F.col("r"), w, vol) * YEAR**0.5)
    return base.select("asset", "date", (blend_ * F.least(size, F.lit(cap))).alias("position"))
