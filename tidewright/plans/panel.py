"""Queries of returns, rolling and expanding windows, and cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import by_asset, r6_sql, rounded
from tidewright.operators import rolling
from tidewright.registry import query

P = f"WITH {views.PANEL_SQL}"
W = "PARTITION BY asset ORDER BY date"


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


@query(f"{P} SELECT * FROM panel_bars")
def panel_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.panel_bars(spark, sf_dir)


@query(f"{P} SELECT asset, date, {r(f'close / lag(close) OVER ({W}) - 1', 'simple')}, {r(f'ln(close) - ln(lag(close) OVER ({W}))', 'log')}, {r(f'close / lag(close, 5) OVER ({W}) - 1', 'five')} FROM panel_bars")
def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("close")
    return rounded(views.panel_bars(spark, sf_dir).select("asset", "date", rolling.simple_return(c).alias("simple"), rolling.log_return(c).alias("log"), rolling.simple_return(c, 5).alias("five")))


N = 20
_F = f"({W} ROWS {N - 1} PRECEDING)"
_ON = lambda x, e, c="close": f"CASE WHEN count({c}) OVER {_F} >= {N} THEN {e} END"
_S = lambda e: f"sum({e}) OVER {_F}"
_SXX = N * (N * N - 1) / 12.0
_SXY, _SYY = f"({_S('i * y')} - {_S('i')} * {_S('y')} / {N})", f"({_S('y * y')} - {_S('y')} * {_S('y')} / {N})"
_LEFT = f"greatest({_SYY} - {_SXY} / {_SXX} * {_SXY}, 0)"
_M = lambda a, b: f"({_S(f'{a} * {b}')} - {_S(a)} * {_S(b)} / {N})"
_G2, _G3 = f"({_S('r * r')} / {N} - ({_S('r')} / {N}) ** 2)", f"({_S('r * r * r')} / {N} - 3 * {_S('r')} / {N} * {_S('r * r')} / {N} + 2 * ({_S('r')} / {N}) ** 3)"


@query(
    f"""{P}, b AS (SELECT asset, date, close, volume, cast(row_number() OVER ({W}) - 1 AS DOUBLE) i, ln(close) y, close / lag(close) OVER ({W}) - 1 r, volume / lag(volume) OVER ({W}) - 1 v FROM panel_bars),
    c AS (SELECT * REPLACE (CASE WHEN v IS NULL THEN NULL ELSE r END AS r) FROM b)
    SELECT asset, date, {r(_ON('', f'avg(close) OVER {_F}'), 'mean')}, {r(_ON('', f'stddev_samp(close) OVER {_F}'), 'sd')}, {r(_ON('', f'var_samp(close) OVER {_F}'), 'variance')},
      {r(_ON('', f'min(close) OVER {_F}'), 'low')}, {r(_ON('', f'max(close) OVER {_F}'), 'high')},
      {r(f'CASE WHEN count(close) OVER ({W} ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING) >= {N} THEN sum(close) OVER ({W} ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING) END', 'sum_before')},
      {r(_ON('', f'quantile_cont(close, 0.5) OVER {_F}'), 'median')}, {r(_ON('', f'quantile_cont(close, 0.25) OVER {_F}'), 'quartile')},
      {r(f'CASE WHEN count(r * v) OVER {_F} >= {N} THEN ' + _M('r', 'v') + '/ sqrt(' + _M('r', 'r') + ' * ' + _M('v', 'v') + ') END', 'corr')},
      {r(f'CASE WHEN count(r * v) OVER {_F} >= {N} THEN ' + _M('r', 'v') + '/ ' + _M('v', 'v') + ' END', 'beta')},
      {r(f'CASE WHEN count(r) OVER {_F} >= {N} THEN {_G3} / greatest({_G2}, 0) ** 1.5 * {(N * (N - 1)) ** 0.5 / (N - 2)} END', 'skew')},
      {r(_ON('', f'CASE WHEN {_LEFT} > 0 THEN {_SXY} / {_SXX} / sqrt({_LEFT} / {N - 2} / {_SXX}) ELSE 0 END'), 't')},
      {r(_ON('', f'CASE WHEN {_SYY} > 1e-15 THEN {_SXY} * {_SXY} / ({_SXX} * {_SYY}) ELSE 0 END'), 'r2')},
      {r(_ON('', f"({_S('i * close')} - (max(i) OVER {_F} - {N}) * {_S('close')}) / {N * (N + 1) / 2}"), 'wma')} FROM c"""
)
def rolling_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.rolling_table(views.panel_bars(spark, sf_dir), N))


@query(
    f"""{P}, b AS (SELECT asset, date, close / lag(close) OVER ({W}) - 1 r FROM panel_bars), g AS (SELECT *, exp(sum(ln(1 + coalesce(r, 0))) OVER ({W})) growth FROM b), k AS (SELECT *, max(growth) OVER ({W}) peak FROM g)
    SELECT asset, date, {r(f'CASE WHEN count(r) OVER ({W}) >= 30 THEN avg(r) OVER ({W}) END', 'mean')}, {r(f'CASE WHEN count(r) OVER ({W}) >= 30 THEN stddev_samp(r) OVER ({W}) END', 'sd')},
      count(r) OVER ({W}) n, {r('growth', 'growth')}, {r('growth / peak - 1', 'drawdown')}, {r('peak', 'peak')} FROM k"""
)
def expanding_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.expanding_table(views.panel_bars(spark, sf_dir)))


@query(f"{P} SELECT asset, date, sum(volume) OVER w volume, count(*) OVER w bars FROM panel_bars WINDOW w AS (PARTITION BY asset ORDER BY date RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND CURRENT ROW)")
def time_range_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.time_range_sum(views.panel_bars(spark, sf_dir))


@query(
    f"""{P}, b AS (SELECT asset, date, close, cast(row_number() OVER ({W}) - 1 AS BIGINT) i, close / lag(close) OVER ({W}) - 1 r FROM panel_bars),
    s AS (SELECT *, CASE WHEN r > 0.05 THEN 1 WHEN r < -0.05 THEN -1 END st, CASE WHEN i % 3 = 0 THEN close END third, CASE WHEN i % 5 = 0 THEN close END fifth FROM b)
    SELECT asset, date, coalesce(last_value(st IGNORE NULLS) OVER ({W}), 0) state, last_value(third IGNORE NULLS) OVER ({W} ROWS 1 PRECEDING) filled, last_value(fifth IGNORE NULLS) OVER ({W}) held FROM s"""
)
def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("close")
    base = views.panel_bars(spark, sf_dir).select("asset", "date", "close", rolling.row_index().alias("i"), rolling.simple_return(c).alias("r"))
    state = F.when(F.col("r") > 0.05, 1).when(F.col("r") < -0.05, -1)
    return base.select("asset", "date", rolling.persist(state).alias("state"), rolling.fill_forward(F.when(F.col("i") % 3 == 0, c), 1).alias("filled"), rolling.hold_every(c, F.col("i"), 5).alias("held"))


_K = 2
_LEG = lambda side: f"CASE WHEN from_{side} <= {_K} AND inverse IS NOT NULL THEN inverse END"


@query(
    f"""{P}, a AS (SELECT asset, date, close, close / lag(close) OVER ({W}) - 1 r FROM panel_bars),
    b AS (SELECT asset, date, close / lag(close, {N}) OVER ({W}) - 1 x, CASE WHEN count(r) OVER {_F} >= {N} THEN stddev_samp(r) OVER {_F} END vol FROM a),
    c AS (SELECT *, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0::DOUBLE END rk, count(x) OVER (PARTITION BY date) n,
      CASE WHEN x IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY x DESC NULLS LAST, asset) END from_top, CASE WHEN x IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY x NULLS LAST, asset) END from_bottom,
      (x - avg(x) OVER (PARTITION BY date)) / nullif(stddev_pop(x) OVER (PARTITION BY date), 0) z, 1 / nullif(vol, 0) inverse FROM b),
    d AS (SELECT *, {_LEG('top')} t, {_LEG('bottom')} l FROM c)
    SELECT asset, date, {r('rk', 'rank')}, {r('CASE WHEN n >= 2 THEN 2 * (rk - 1) / (n - 1) - 1 END', 'centred')}, {r('CASE WHEN n >= 2 THEN z END', 'z')}, {r('inverse / sum(inverse) OVER (PARTITION BY date)', 'base_weight')},
      {r('coalesce(0.5 * t / sum(t) OVER (PARTITION BY date), 0) - coalesce(0.5 * l / sum(l) OVER (PARTITION BY date), 0)', 'long_short')}, {r(f'CASE WHEN from_top <= {_K} AND x > 0 THEN 1.0 / {_K} ELSE 0 END', 'dual')} FROM d"""
)
def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.cross_section(views.panel_bars(spark, sf_dir), N, _K))


_B = 60
_BS = lambda e: f"sum({e}) OVER w"


@query(
    f"""{P}, q AS (SELECT asset, date, close / lag(close) OVER ({W}) - 1 r FROM panel_bars),
    p AS (SELECT a.asset a, b.asset b, date, a.r x, b.r y FROM q a JOIN q b USING (date) WHERE a.asset < b.asset AND a.r IS NOT NULL AND b.r IS NOT NULL),
    e AS (SELECT date, CASE WHEN count(*) OVER w >= {_B} THEN ({_BS('x * y')} - {_BS('x')} * {_BS('y')} / {_B}) / sqrt(({_BS('x * x')} - {_BS('x')} * {_BS('x')} / {_B}) * ({_BS('y * y')} - {_BS('y')} * {_BS('y')} / {_B})) END rho,
      avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0 END) OVER w same FROM p WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS {_B - 1} PRECEDING))
    SELECT date, {r('avg(abs(rho))', 'mean_abs_corr')}, {r('avg(greatest(same, 1 - same))', 'concordance')}, count(*) pairs FROM e WHERE rho IS NOT NULL GROUP BY date"""
)
def breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.breadth(views.panel_bars(spark, sf_dir), _B))
