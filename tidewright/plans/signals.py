"""Queries of signals that windows express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import by_asset, r6_sql, rolling, rounded
from tidewright.operators import signals
from tidewright.operators.rolling import simple_return
from tidewright.registry import query

P = f"WITH {views.PANEL_SQL}"
W = "PARTITION BY asset ORDER BY date"


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


def on(f: str, x: str, n: int, lag: int = 0) -> str:
    """SQL of a rolling function that is null until its frame is full."""
    frame = f"({W} ROWS BETWEEN {n - 1 + lag} PRECEDING AND {f'{lag} PRECEDING' if lag else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) OVER {frame} >= {n} THEN {f}({x}) OVER {frame} END"


def past(n: int, skip: int = 0) -> str:
    return f"({f'lag(close, {skip}) OVER ({W})' if skip else 'close'} / lag(close, {n + skip}) OVER ({W}) - 1)"


@query(
    f"""{P}, b AS (SELECT asset, date, high, low, close, close / lag(close) OVER ({W}) - 1 r, abs(close - lag(close) OVER ({W})) moved FROM panel_bars)
    SELECT asset, date, {r(past(60, 5), 'past')}, {r(f"{past(60, 5)} / nullif(({on('stddev_samp', 'r', 60, 5)}) * sqrt(60.0), 0)", 'risk_adjusted')},
      {r(f'(sign{past(20)} + sign{past(60)} + sign{past(120)}) / 3.0', 'multi_sign')}, {r(f"sign(close / ({on('avg', 'close', 40)}) - 1)", 'sma_sign')},
      {r(f"sign(({on('avg', 'close', 10)}) - ({on('avg', 'close', 40)}))", '"cross"')}, {r(f"2 * (close - ({on('min', 'low', 60)})) / nullif(({on('max', 'high', 60)}) - ({on('min', 'low', 60)}), 0) - 1", 'range_position')},
      {r(f"coalesce(abs(close - lag(close, 10) OVER ({W})) / nullif(sum(moved) OVER ({W} ROWS 9 PRECEDING), 0), 0)", 'efficiency')} FROM b"""
)
def momentum_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.momentum_table(views.panel_bars(spark, sf_dir)))


def wma(x: str, n: int) -> str:
    f = f"({W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {f} >= {n} THEN (sum(i * {x}) OVER {f} - (max(i) OVER {f} - {n}) * sum({x}) OVER {f}) / {n * (n + 1) / 2} END"


@query(
    f"""{P}, b AS (SELECT asset, date, close x, cast(row_number() OVER ({W}) - 1 AS DOUBLE) i FROM panel_bars),
    c AS (SELECT asset, date, i, 2 * ({wma('x', 8)}) - ({wma('x', 16)}) y FROM b), d AS (SELECT asset, date, {wma('y', 4)} hull FROM c)
    SELECT asset, date, {r('hull', 'hull')}, {r(f'sign(hull - lag(hull) OVER ({W}))', 'signal')} FROM d"""
)
def hull_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signals.hull(views.panel_bars(spark, sf_dir)))


STATE = f"coalesce(last_value(st IGNORE NULLS) OVER ({W}), 0) state"


@query(f"""{P}, b AS (SELECT asset, date, close, {on('avg', 'close', 20)} m, {on('stddev_samp', 'close', 20)} s FROM panel_bars), c AS (SELECT *, CASE WHEN close > m + s THEN 1 WHEN close < m - s THEN -1 END st FROM b) SELECT asset, date, {STATE} FROM c""")
def bollinger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.bollinger_state(views.panel_bars(spark, sf_dir))


LAST = lambda x: f"last_value({x} IGNORE NULLS) OVER ({W}) {x}"


@query(
    f"""{P}, b AS (SELECT asset, date, close, CASE WHEN count(*) OVER w = 7 AND high = max(high) OVER w THEN high END t, CASE WHEN count(*) OVER w = 7 AND low = min(low) OVER w THEN low END l FROM panel_bars WINDOW w AS ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    c AS (SELECT asset, date, close, lag(t, 3) OVER ({W}) top, lag(l, 3) OVER ({W}) bottom FROM b), d AS (SELECT asset, date, close, {LAST('top')}, {LAST('bottom')} FROM c),
    e AS (SELECT *, CASE WHEN close > top THEN 1 WHEN close < bottom THEN -1 END st FROM d) SELECT asset, date, top, bottom, {STATE} FROM e"""
)
def pivot_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.pivot_breakout(views.panel_bars(spark, sf_dir))


@query(
    f"""{P}, a AS (SELECT *, lag(high, 3) OVER ({W}) old, count(high) OVER u n, max(high) OVER u mx, max(high) OVER ({W} ROWS 2 PRECEDING) now, min(low) OVER ({W} ROWS 3 PRECEDING) lo FROM panel_bars WINDOW u AS ({W} ROWS BETWEEN 42 PRECEDING AND 3 PRECEDING)),
    b AS (SELECT asset, date, close, CASE WHEN n >= 40 AND old = mx AND now < old THEN old END top, CASE WHEN n >= 40 AND old = mx AND now < old THEN lo END bottom FROM a),
    d AS (SELECT asset, date, close, {LAST('top')}, {LAST('bottom')} FROM b), e AS (SELECT *, CASE WHEN close > top THEN 1 WHEN close < bottom THEN -1 END st FROM d) SELECT asset, date, top, bottom, {STATE} FROM e"""
)
def darvas_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.darvas(views.panel_bars(spark, sf_dir))


_SIGNAL = f"cast(coalesce(sign(close / lag(close, 20) OVER ({W}) - 1), 0) AS INT) signal"
_RUN = f"sum(c) OVER ({W}) run"
_CHANGED = f"coalesce(cast(signal <> lag(signal) OVER ({W}) AS INT), 1) c"


def _signal() -> F.Column:
    return F.coalesce(F.signum(signals.past_return(F.col("close"), 20)), F.lit(0.0)).cast("int")


@query(
    f"""{P}, a AS (SELECT asset, date, {_SIGNAL}, CASE WHEN volume > lag(volume) OVER ({W}) THEN 1 ELSE 0 END f FROM panel_bars), b AS (SELECT *, {_CHANGED} FROM a), d AS (SELECT *, {_RUN} FROM b),
    e AS (SELECT *, first_value(f) OVER w ff, max(f) OVER w mf FROM d WINDOW w AS (PARTITION BY asset, run ORDER BY date)) SELECT asset, date, signal, signal * f a, signal * ff b, signal * mf c, signal * (1 - ff) skip FROM e"""
)
def filter_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rises = F.when(F.col("volume") > F.lag("volume").over(by_asset()), 1).otherwise(0)
    return signals.attach_filters(views.panel_bars(spark, sf_dir).select("asset", "date", _signal().alias("signal"), rises.alias("filter")))


@query(
    f"""{P}, z AS (SELECT asset, date, close, close / lag(close) OVER ({W}) - 1 r FROM panel_bars), a AS (SELECT asset, date, r, {_SIGNAL}, {on('stddev_samp', 'r', 20)} vol FROM z), b AS (SELECT *, {_CHANGED} FROM a), d AS (SELECT *, {_RUN} FROM b),
    e AS (SELECT *, coalesce(sum(signal * r) OVER w, 0) - coalesce(first_value(signal * r) OVER w, 0) gain, first_value(vol) OVER w entry FROM d WINDOW w AS (PARTITION BY asset, run ORDER BY date)),
    g AS (SELECT *, cast(gain >= 0.2 * entry * sqrt(20.0) AS INT) hit FROM e),
    h AS (SELECT *, coalesce(max(hit) OVER (PARTITION BY asset, run ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) done FROM g)
    SELECT asset, date, signal, {r('gain', 'gain')}, CASE WHEN done = 1 THEN 0 ELSE signal END "position" FROM h"""
)
def take_profit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = views.panel_bars(spark, sf_dir).select("asset", "date", "close", simple_return(F.col("close")).alias("r"), _signal().alias("signal"))
    vol = rolling(F.stddev_samp, F.col("r"), by_asset(), 20)
    return rounded(signals.take_profit(base.select("asset", "date", "close", "signal", vol.alias("vol")), k=0.2, horizon=20))


@query(
    f"""{P}, a AS (SELECT asset, date, {past(20)} x, {past(60)} y, close / ({on('avg', 'close', 40)}) - 1 z FROM panel_bars)
    SELECT asset, date, {r('(coalesce(x, 0) + coalesce(y, 0) + coalesce(z, 0)) / nullif(cast(x IS NOT NULL AS INT) + cast(y IS NOT NULL AS INT) + cast(z IS NOT NULL AS INT), 0)', 'mean')},
      CASE WHEN coalesce(x, y, z) IS NOT NULL THEN cast(sign(coalesce(sign(x), 0) + coalesce(sign(y), 0) + coalesce(sign(z), 0)) AS DOUBLE) END majority FROM a"""
)
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("close")
    base = views.panel_bars(spark, sf_dir).select("asset", "date", signals.past_return(c, 20).alias("x"), signals.past_return(c, 60).alias("y"), (c / rolling(F.avg, c, by_asset(), 40) - 1).alias("z"))
    return rounded(signals.vote(base, ["x", "y", "z"]))


@query(
    f"{P}, a AS ("
    + " UNION ALL ".join(
        f"SELECT asset, date, '{f}' family, {n} lookback, cast({e} AS DOUBLE) signal FROM panel_bars"
        for n in (10, 20, 40, 60, 120)
        for f, e in (("tsmom", f"sign{past(n)}"), ("sma", f"sign(close / ({on('avg', 'close', n)}) - 1)"), ("range", f"sign(2 * (close - ({on('min', 'low', n)})) / nullif(({on('max', 'high', n)}) - ({on('min', 'low', n)}), 0) - 1)"))
    )
    + ") SELECT * FROM a WHERE signal IS NOT NULL"
)
def signal_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.catalogue(views.panel_bars(spark, sf_dir))


@query()
def trend_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen families of trend signals on seven time frames. Tests hold them against pandas and the kernels over the whole panel."""
    return rounded(signals.full_catalogue(views.panel_bars(spark, sf_dir)))
