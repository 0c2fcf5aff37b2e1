"""Queries of positions, backtests and performance; among them the flagship, panel to daily net returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import by_asset, by_date, divide, r6_sql, rolling, rounded
from tidewright.operators import backtest, signals
from tidewright.operators.rolling import simple_return
from tidewright.registry import query

P = f"WITH {views.PANEL_SQL}"
W = "PARTITION BY asset ORDER BY date"
#: Gross exposure. The panel's prices jump by multiples from day to day, so a full position could lose more than all.
EXPOSURE = 0.0002


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


def weights(spark: SparkSession, sf_dir: str, lookback: int = 60, vol: int = 20) -> DataFrame:
    """(asset, date, close, ret, signal, weight): sign of the past return times inverse-volatility weights."""
    c = F.col("close")
    base = views.panel_bars(spark, sf_dir).select("asset", "date", "close", simple_return(c).alias("ret"), signals.past_return(c, lookback).alias("past"))
    base = base.select("*", divide(F.lit(1.0), rolling(F.stddev_samp, F.col("ret"), by_asset(), vol)).alias("inverse"))
    share = divide(F.col("inverse"), F.sum("inverse").over(by_date()))
    return base.select("asset", "date", "close", "ret", F.signum("past").cast("int").alias("signal"), backtest.long_short(F.col("past"), share * EXPOSURE).alias("weight"))


_F20 = f"({W} ROWS 19 PRECEDING)"
WEIGHTS = f"""a_ AS (SELECT asset, date, close, close / lag(close) OVER ({W}) - 1 ret, close / lag(close, 60) OVER ({W}) - 1 past FROM panel_bars),
    b_ AS (SELECT *, 1 / nullif(CASE WHEN count(ret) OVER {_F20} >= 20 THEN stddev_samp(ret) OVER {_F20} END, 0) inverse FROM a_),
    weights AS (SELECT asset, date, close, ret, sign(past) signal, sign(past) * (inverse / sum(inverse) OVER (PARTITION BY date) * {EXPOSURE}) weight FROM b_)"""
DAILY = f"""{WEIGHTS}, h_ AS (SELECT asset, date, ret, coalesce(lag(coalesce(weight, 0)) OVER ({W}), 0) held FROM weights), m_ AS (SELECT *, coalesce(abs(held - lag(held) OVER ({W})), 0) moved FROM h_),
    each AS (SELECT asset, date, held, held * coalesce(ret, 0) gross, moved / 2 turnover, moved * 0.0005 / 2 AS "cost", greatest(-held, 0) * 0.02 / 252 borrow, held * coalesce(ret, 0) - moved * 0.0005 / 2 - greatest(-held, 0) * 0.02 / 252 net FROM m_),
    daily AS (SELECT date, sum(gross) gross, sum(turnover) turnover, sum("cost") + sum(borrow) costs, sum(net) net, sum(abs(held)) exposure, count(*) FILTER (2 * turnover >= {EXPOSURE / 20}) trades FROM each GROUP BY date)"""
EQUITY = f"""{DAILY}, g_ AS (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY date)) equity FROM daily), k_ AS (SELECT *, greatest(max(equity) OVER (ORDER BY date), 1.0) peak FROM g_),
    d_ AS (SELECT *, equity / peak - 1 drawdown, sum(cast(equity >= peak AS INT)) OVER (ORDER BY date) episode FROM k_),
    equity AS (SELECT *, coalesce(sum(cast(drawdown < 0 AS INT)) OVER (PARTITION BY episode ORDER BY date), 0) under_water FROM d_)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.backtest(weights(spark, sf_dir), threshold=EXPOSURE / 20)


@query(f"{P}, {DAILY} SELECT date, {r('gross', 'gross')}, {r('turnover', 'turnover')}, {r('costs', 'costs')}, {r('net', 'net')}, {r('exposure', 'exposure')}, trades FROM daily")
def trend_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(daily(spark, sf_dir))


@query(f"{P}, {DAILY} SELECT asset, date, " + ", ".join(r(c, c) for c in ("held", "gross", "turnover")) + f", {r('\"cost\"', '\"cost\"')}, {r('borrow', 'borrow')}, {r('net', 'net')} FROM each")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.contributions(weights(spark, sf_dir)))


@query(f"{P}, {DAILY} SELECT year(date) AS \"year\", CASE WHEN asset LIKE 'N%' THEN 'open' ELSE 'closed' END AS \"class\", {r('sum(net)', 'net')}, {r('sum(gross)', 'gross')} FROM each GROUP BY 1, 2")
def group_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = spark.createDataFrame([("AF", "closed"), ("NF", "open"), ("NO", "open"), ("RF", "closed"), ("AO", "closed"), ("RO", "closed")], "asset string, class string")
    each = backtest.contributions(weights(spark, sf_dir)).join(F.broadcast(classes), "asset")
    return rounded(each.groupBy(F.year("date").cast("long").alias("year"), "class").agg(F.sum("net").alias("net"), F.sum("gross").alias("gross")))


@query(f"{P}, {EQUITY} SELECT date, {r('net', 'r')}, {r('equity', 'equity')}, {r('peak', 'peak')}, {r('drawdown', 'drawdown')}, cast(under_water AS BIGINT) under_water FROM equity")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.equity(daily(spark, sf_dir)))


_CAGR = "(exp(sum(ln(1 + net))) ** (252.0 / count(*)) - 1)"


@query(
    f"""{P}, {EQUITY} SELECT count(*) AS "days", {r('avg(net)', 'mean')}, {r('stddev_samp(net) * sqrt(252.0)', 'vol')}, {r('avg(net) * 252 / (stddev_samp(net) * sqrt(252.0))', 'sharpe')}, {r(_CAGR, 'cagr')}, {r('min(drawdown)', 'max_drawdown')},
      cast(max(under_water) AS BIGINT) longest_under_water, {r('sum(greatest(net, 0)) / -sum(least(net, 0))', 'omega')}, {r('avg(net) * 252 / (sqrt(avg(least(net, 0) ** 2)) * sqrt(252.0))', 'sortino')}, {r(f'{_CAGR} / -min(drawdown)', 'calmar')},
      {r('avg(turnover) * 252', 'turnover')}, cast(sum(trades) AS BIGINT) trades, {r('avg(exposure)', 'exposure')} FROM equity"""
)
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.summary(daily(spark, sf_dir)))


@query(f"{P}, {DAILY} SELECT cast(date_trunc('month', date) AS DATE) AS \"month\", {r('exp(sum(ln(1 + net))) - 1', 'ret')}, count(net) AS \"days\" FROM daily GROUP BY 1")
def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.monthly(daily(spark, sf_dir)))


@query(
    f"""{P}, {WEIGHTS}, s AS (SELECT asset, date, cast(coalesce(signal, 0) AS INT) signal, ret FROM weights), c AS (SELECT *, coalesce(cast(signal <> lag(signal) OVER ({W}) AS INT), 1) c, coalesce(lag(signal) OVER ({W}), 0) held FROM s),
    n AS (SELECT *, sum(c) OVER ({W}) run FROM c) SELECT asset, signal, min(date) AS "first", max(date) AS "last", count(*) AS "days", {r('sum(CASE WHEN c = 0 THEN held * coalesce(ret, 0) ELSE 0 END)', 'pnl')} FROM n GROUP BY asset, run, signal"""
)
def trade_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.spells(weights(spark, sf_dir).select("asset", "date", F.coalesce("signal", F.lit(0)).alias("signal"), "ret")))


@query(
    f"""{P}, {WEIGHTS}, s AS (SELECT asset, lag(signal) OVER ({W}) held, ret, abs(signal - lag(signal) OVER ({W})) moved FROM weights)
    SELECT asset, {r('avg(held * ret)', 'total')}, {r('covar_pop(held, ret)', 'timing')}, {r('avg(held) * avg(ret)', 'drift')}, {r('2 * avg(abs(held)) / avg(moved)', 'holding_days')}, {r('avg(held * ret) / avg(moved)', 'break_even_cost')} FROM s WHERE held IS NOT NULL AND ret IS NOT NULL GROUP BY asset"""
)
def drift_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_asset()
    base = weights(spark, sf_dir).select("asset", F.lag("signal").over(w).alias("held"), "ret", F.abs(F.col("signal") - F.lag("signal").over(w)).alias("moved"))
    return rounded(backtest.drift_timing(base))


@query(
    f"""{P}, {DAILY}, y AS (SELECT year(date) y, count(*) n, sum(net) s, sum(net * net) q FROM daily GROUP BY 1), z AS (SELECT y + k y, sum(n) n, sum(s) s, sum(q) q FROM y, range(1, 4) t(k) GROUP BY 1),
    sc AS (SELECT y, 0.1 / (sqrt((q - s * s / n) / (n - 1)) * sqrt(252.0)) scale FROM z WHERE n >= 250) SELECT date, {r('net * scale', 'r')}, {r('scale', 'scale')} FROM daily JOIN sc ON y = year(date)"""
)
def yearly_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.yearly_scaled(daily(spark, sf_dir)))


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, date, r): six assets by three horizons, yesterday's sign times today's return."""
    c, w = F.col("close"), by_asset()
    base = views.panel_bars(spark, sf_dir).select("asset", "date", simple_return(c).alias("ret"), *[F.signum(signals.past_return(c, h)).alias(f"s{h}") for h in (20, 60, 120)])
    each = F.array(*[F.struct(F.concat("asset", F.lit(f"-{h}")).alias("stream"), (F.lag(f"s{h}").over(w) * F.col("ret")).alias("r")) for h in (20, 60, 120)])
    return base.select("date", each.alias("e")).select("date", F.inline("e")).where("r IS NOT NULL")


STREAMS = "streams AS (" + " UNION ALL ".join(f"SELECT concat(asset, '-{h}') stream, date, lag(s) OVER ({W}) * ret r FROM (SELECT asset, date, close / lag(close) OVER ({W}) - 1 ret, sign(close / lag(close, {h}) OVER ({W}) - 1) s FROM panel_bars) QUALIFY lag(s) OVER ({W}) * ret IS NOT NULL" for h in (20, 60, 120)) + ")"


@query(
    f"""{P}, {STREAMS}, y AS (SELECT stream, year(date) AS "year", count(r) n, sum(r) s, sum(r * r) q FROM streams GROUP BY 1, 2),
    p AS (SELECT stream, "year", s now, sum(n) OVER w n, sum(s) OVER w s, sum(q) OVER w q FROM y WINDOW w AS (PARTITION BY stream ORDER BY "year" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, (s / n) / nullif(sqrt((q - s * s / n) / (n - 1)), 0) score FROM p)
    SELECT "year", stream, {r('now', 'traded')} FROM z WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "year" ORDER BY score DESC, stream DESC) = 1"""
)
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.walk_forward(_streams(spark, sf_dir)))


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streams(spark, sf_dir).groupBy("stream").agg(F.avg("r").alias("mean"), (-F.stddev_samp("r")).alias("calm"), F.min("r").alias("worst"))


@query(
    f"""{P}, {STREAMS}, m AS (SELECT stream, avg(r) mean, -stddev_samp(r) calm, min(r) worst FROM streams GROUP BY 1)
    SELECT stream, {r('mean', 'mean')}, {r('calm', 'calm')}, {r('worst', 'worst')} FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.stream <> a.stream AND b.mean >= a.mean AND b.calm >= a.calm AND b.worst >= a.worst AND (b.mean > a.mean OR b.calm > a.calm OR b.worst > a.worst))"""
)
def pareto_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.pareto(_measures(spark, sf_dir), ["mean", "calm", "worst"], "stream"))


@query(f"{P}, {EQUITY}, e AS (SELECT date, drawdown, sum(cast(drawdown >= 0 AS INT)) OVER (ORDER BY date) ep FROM equity) SELECT min(date) peak_date, min_by(date, drawdown) low_date, {r('min(drawdown)', 'depth')} FROM e GROUP BY ep HAVING min(drawdown) <= -0.02")
def crisis_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.crises(daily(spark, sf_dir), 0.02))


@query(
    f"""{P}, {DAILY}, a AS (SELECT date, net, cast(round(lag(turnover) OVER (ORDER BY date) * 1e9) AS BIGINT) x FROM daily), b AS (SELECT net, CASE WHEN count(x) OVER (ORDER BY date) >= 250 THEN x * count(x) OVER (ORDER BY date) > sum(x) OVER (ORDER BY date) END high, x > lag(x, 63) OVER (ORDER BY date) rising FROM a)
    SELECT high, rising, count(*) AS "days", {r('avg(net) / stddev_samp(net)', 'sharpe')} FROM b WHERE high IS NOT NULL AND rising IS NOT NULL GROUP BY 1, 2"""
)
def regime_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(backtest.quadrants(daily(spark, sf_dir)))
