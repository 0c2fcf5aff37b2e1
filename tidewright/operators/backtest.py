"""Positions, backtests and performance of weight panels (asset, date, weight, ret)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewright.functions.windows import by_asset, by_date, divide, upto

YEAR = 252


def long_flat(signal: Column, base: Column) -> Column:
    """The base weight where the signal is positive, 0 where not, null where there is no signal."""
    return F.when(signal.isNotNull(), F.when(signal > 0, base).otherwise(0.0))


def long_short(signal: Column, base: Column) -> Column:
    return F.when(signal.isNotNull(), F.signum(signal) * base)


def envelopes(score: Column) -> dict[str, Column]:
    """Maps of a score to a position in [-1, 1]."""
    return {"sign": F.signum(score), "clip": F.least(F.greatest(score, F.lit(-1.0)), F.lit(1.0)), "tanh": F.tanh(score)}


def random_gate(i: Column, on_share: float, spell: float, seed: int, w: WindowSpec) -> Column:
    """1 or 0 along ``w``: a chain of two states that is on for ``on_share`` of the time, in spells of ``spell`` rows on average, off until it first changes.

    Row ``i`` draws a number that switches on, switches off or does nothing, whatever the state; so the state is the last switch, and no row waits for another.
    """
    off = 1.0 / spell
    on = off * on_share / (1 - on_share)
    u = F.pmod((i + seed * 7919) * 1103515245 + 12345, F.lit(2147483648)) / 2147483648.0
    switch = F.when(u < on, 1).when(u >= 1 - off, 0)
    return F.coalesce(F.last(switch, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def excess_index(panel: DataFrame) -> DataFrame:
    """Index of the daily return less the rate ``rf``, from the first close on, with high and low scaled alike (asset, date, index, high, low). A loss of all leaves 1e-12 of it."""
    w = by_asset()
    r = F.col("close") / F.lag("close").over(w) - 1 - F.col("rf")
    x = panel.withColumn("step", F.ln(F.greatest(1 + F.coalesce(r, F.lit(0.0)), F.lit(1e-12)))).withColumn("index", F.first("close").over(upto(w)) * F.exp(F.sum("step").over(upto(w))))
    scale = F.col("index") / F.col("close")
    return x.select("asset", "date", "index", (F.col("high") * scale).alias("high"), (F.col("low") * scale).alias("low"))


def contributions(weights: DataFrame, cost: float = 0.0005, borrow: float = 0.02) -> DataFrame:
    """By asset and day: the weight held (yesterday's), gross return, turnover, cost, borrowing and net. Null weights are 0; the first row trades nothing."""
    w = by_asset()
    held = F.coalesce(F.lag(F.coalesce("weight", F.lit(0.0))).over(w), F.lit(0.0))
    base = weights.select("asset", "date", "ret", held.alias("held"))
    base = base.select("*", F.coalesce(F.abs(F.col("held") - F.lag("held").over(w)), F.lit(0.0)).alias("moved"))
    gross = F.col("held") * F.coalesce("ret", F.lit(0.0))
    fee, lent = F.col("moved") * cost / 2, F.greatest(-F.col("held"), F.lit(0.0)) * borrow / YEAR
    return base.select("asset", "date", "held", gross.alias("gross"), (F.col("moved") / 2).alias("turnover"), fee.alias("cost"), lent.alias("borrow"), (gross - fee - lent).alias("net"))


def backtest(weights: DataFrame, cost: float = 0.0005, borrow: float = 0.02, cash: float = 0.0, threshold: float = 0.01) -> DataFrame:
    """By day: gross (with cash on what is not invested), turnover, costs, net, exposures and trades of at least ``threshold``."""
    each = contributions(weights, cost, borrow)
    total = lambda c: F.sum(c)
    idle = (1 - total("held")) * cash / YEAR
    return each.groupBy("date").agg(
        (total("gross") + idle).alias("gross"),
        total("turnover").alias("turnover"),
        (total("cost") + total("borrow")).alias("costs"),
        (total("net") + idle).alias("net"),
        total(F.abs("held")).alias("exposure"),
        F.count_if(2 * F.col("turnover") >= threshold).alias("trades"),
    )


def equity(daily: DataFrame, ret: str = "net", keep: tuple[str, ...] = ()) -> DataFrame:
    """date, equity, peak, drawdown and the run of days under water, and the columns ``keep``. One series: a single window over days, not over assets."""
    w = Window.orderBy("date")
    grown = daily.select("date", *keep, F.col(ret).alias("r"), F.exp(F.sum(F.ln(1 + F.col(ret))).over(w)).alias("equity"))
    peaks = grown.select("*", F.greatest(F.max("equity").over(w), F.lit(1.0)).alias("peak"))
    dd = peaks.select("*", (F.col("equity") / F.col("peak") - 1).alias("drawdown"), F.sum((F.col("equity") >= F.col("peak")).cast("int")).over(w).alias("episode"))
    under = F.sum((F.col("drawdown") < 0).cast("int")).over(Window.partitionBy("episode").orderBy("date"))
    return dd.select("date", *keep, "r", "equity", "peak", "drawdown", F.coalesce(under, F.lit(0)).alias("under_water"))


def summary(daily: DataFrame) -> DataFrame:
    """One row: days, mean, vol, Sharpe, CAGR, max drawdown, longest time under water, Omega, Sortino, Calmar, turnover."""
    e = equity(daily, keep=("turnover", "trades", "exposure"))
    r = F.col("r")
    n = F.count("*")
    growth = F.exp(F.sum(F.ln(1 + r)))
    cagr = F.pow(growth, F.lit(float(YEAR)) / n) - 1
    vol = F.stddev_samp("r") * YEAR**0.5
    down = F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0)))) * YEAR**0.5
    return e.agg(
        n.alias("days"),
        F.avg("r").alias("mean"),
        vol.alias("vol"),
        divide(F.avg("r") * YEAR, vol).alias("sharpe"),
        cagr.alias("cagr"),
        F.min("drawdown").alias("max_drawdown"),
        F.max("under_water").cast("long").alias("longest_under_water"),
        divide(F.sum(F.greatest(r, F.lit(0.0))), -F.sum(F.least(r, F.lit(0.0)))).alias("omega"),
        divide(F.avg("r") * YEAR, down).alias("sortino"),
        divide(cagr, -F.min("drawdown")).alias("calmar"),
        (F.avg("turnover") * YEAR).alias("turnover"),
        F.sum("trades").alias("trades"),
        F.avg("exposure").alias("exposure"),
    )


def monthly(daily: DataFrame, ret: str = "net") -> DataFrame:
    """month, compounded return, days."""
    return daily.groupBy(F.trunc("date", "MM").alias("month")).agg((F.exp(F.sum(F.ln(1 + F.col(ret)))) - 1).alias("ret"), F.count(ret).alias("days"))


def spells(df: DataFrame) -> DataFrame:
    """(asset, date, signal, ret): runs of one sign with first day, last day, days, and the P&L from the day after the entry."""
    w = by_asset()
    changed = F.coalesce((F.col("signal") != F.lag("signal").over(w)).cast("int"), F.lit(1))
    numbered = df.select("*", changed.alias("c"), F.coalesce(F.lag("signal").over(w), F.lit(0)).alias("held")).select("*", F.sum("c").over(upto(w)).alias("run"))
    pnl = F.sum(F.when(F.col("c") == 0, F.col("held") * F.coalesce("ret", F.lit(0.0))).otherwise(0.0))
    return numbered.groupBy("asset", "run", "signal").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days"), pnl.alias("pnl")).drop("run")


def drift_timing(df: DataFrame) -> DataFrame:
    """By asset: mean(s r) = cov(s, r) + mean(s) mean(r)."""
    s, r = F.col("held").cast("double"), F.col("ret")
    there = df.where("held IS NOT NULL AND ret IS NOT NULL")
    return there.groupBy("asset").agg(F.avg(s * r).alias("total"), F.covar_pop(s, r).alias("timing"), (F.avg(s) * F.avg(r)).alias("drift"), divide(2 * F.avg(F.abs(s)), F.avg("moved")).alias("holding_days"), divide(F.avg(s * r), F.avg("moved")).alias("break_even_cost"))


def yearly_scaled(daily: DataFrame, target: float = 0.10, years: int = 3, least: int = 250) -> DataFrame:
    """Each calendar year scaled by target / vol of the ``years`` before, where these have ``least`` days; days of other years drop."""
    base = daily.select("date", F.year("date").alias("year"), F.col("net").alias("r"))
    sums = base.groupBy("year").agg(F.count("*").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    spread = sums.select(F.explode(F.sequence(F.col("year") + 1, F.col("year") + years)).alias("year"), "n", "s", "q").groupBy("year").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    sd = F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)) * YEAR**0.5
    scale = spread.where(F.col("n") >= least).select("year", (target / sd).alias("scale"))
    return base.join(F.broadcast(scale), "year").select("date", (F.col("r") * F.col("scale")).alias("r"), "scale")


def walk_forward(streams: DataFrame) -> DataFrame:
    """(stream, date, r): each year the stream with the best Sharpe of all earlier years, and its return in that year."""
    sums = streams.groupBy("stream", F.year("date").cast("long").alias("year")).agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    past = Window.partitionBy("stream").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    n, s, q = (F.sum(c).over(past) for c in ("n", "s", "q"))
    scored = sums.select("stream", "year", F.col("s").alias("now"), divide(s / n, F.sqrt((q - s * s / n) / (n - 1))).alias("score")).where("score IS NOT NULL")
    return scored.groupBy("year").agg(F.max_by(F.struct("stream", F.col("now").alias("traded")), F.struct(F.col("score"), F.col("stream"))).alias("best")).select("year", "best.stream", "best.traded")


def pareto(df: DataFrame, measures: list[str], key: str) -> DataFrame:
    """Rows that no other row matches or beats in all measures and beats in one (larger is better)."""
    a, b = df.alias("a"), df.select(*[F.col(c).alias(f"_{c}") for c in [key, *measures]]).alias("b")
    all_ge = F.expr(" AND ".join(f"_{m} >= {m}" for m in measures))
    one_gt = F.expr(" OR ".join(f"_{m} > {m}" for m in measures))
    return a.join(b, (F.col(f"_{key}") != F.col(key)) & all_ge & one_gt, "left_anti")


def crises(daily: DataFrame, depth: float = 0.15) -> DataFrame:
    """Falls of at least ``depth`` from a peak until it is regained: peak, date of the low, depth."""
    w = Window.orderBy("date")
    e = equity(daily).withColumn("episode", F.sum((F.col("drawdown") >= 0).cast("int")).over(w))
    return e.groupBy("episode").agg(F.min("date").alias("peak_date"), F.min_by("date", "drawdown").alias("low_date"), F.min("drawdown").alias("depth")).where(F.col("depth") <= -depth).drop("episode")


def quadrants(daily: DataFrame, level: str = "turnover", least: int = 250) -> DataFrame:
    """Sharpe by regime: yesterday's level against its expanding mean, times the sign of its change over 63 days.

    Levels are compared as whole numbers of 1e-9, so that the order in which they were summed decides nothing. One row a day: the window has no key.
    """
    w = Window.orderBy("date")
    base = daily.select("date", F.col("net").alias("r"), F.round(F.lag(level).over(w) * 1e9).cast("long").alias("x"))
    n = F.count("x").over(upto(w))
    high = F.when(n >= least, F.col("x") * n > F.sum("x").over(upto(w)))
    marked = base.select("r", high.alias("high"), (F.col("x") > F.lag("x", 63).over(w)).alias("rising")).where("high IS NOT NULL AND rising IS NOT NULL")
    return marked.groupBy("high", "rising").agg(F.count("*").alias("days"), divide(F.avg("r"), F.stddev_samp("r")).alias("sharpe"))
