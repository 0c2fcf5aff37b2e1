"""Queries of recursive kernels. The SQL folds each history with a recursive query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import r6_sql, rounded
from tidewright.operators import kernels as k
from tidewright.registry import query

P, T = views.PANEL_SQL, views.TAPE_SQL
W = "PARTITION BY asset ORDER BY date"
DAY = 86_400_000


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


def fold(source: str, init: dict[str, str], step: dict[str, str], select: str, key: str = "asset", order: str = "date") -> str:
    """SQL that folds ``source`` (a CTE ``b`` with key, order, i and inputs). In ``step``, s.x is the state before, b.x the row."""
    first = ", ".join(f"cast({e} AS DOUBLE) {n}" for n, e in init.items())
    then = ", ".join(f"cast({e} AS DOUBLE)" for e in step.values())
    return f"""WITH RECURSIVE {source}, f AS (SELECT b.{key}, b.{order}, b.i, {first} FROM b WHERE i = 1 UNION ALL SELECT b.{key}, b.{order}, b.i, {then} FROM f s JOIN b ON b.{key} = s.{key} AND b.i = s.i + 1) SELECT {select} FROM f"""


BASE = f"b AS (SELECT asset, date, high, low, close, row_number() OVER ({W}) i, close / lag(close) OVER ({W}) - 1 r, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) tr FROM panel_bars)"


def ewm(x: str, alpha: float, name: str) -> tuple[dict[str, str], dict[str, str]]:
    return {name: f"b.{x}"}, {name: f"s.{name} + {alpha!r}::DOUBLE * (b.{x} - s.{name})"}


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.panel_bars(spark, sf_dir)


_E = [ewm("close", 0.1, "wilder"), ewm("close", 2 / 13, "fast"), ewm("close", 2 / 27, "slow"), ewm("tr", 1 / 14, "atr")]


@query(fold(f"{P}, {BASE}", {n: e for i, _ in _E for n, e in i.items()}, {n: e for _, s in _E for n, e in s.items()}, f"asset, date, {r('wilder', 'wilder')}, {r('fast - slow', 'macd')}, {r('atr', 'atr')}"))
def exponential_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda d: d["close"].to_numpy()
    return rounded(
        k.per_asset(
            panel(spark, sf_dir).select("asset", "date", "high", "low", "close"),
            {"wilder": lambda d: k.ema(c(d), 0.1), "macd": lambda d: k.ema(c(d), 2 / 13) - k.ema(c(d), 2 / 27), "atr": lambda d: k.atr(d["high"].to_numpy(), d["low"].to_numpy(), c(d), 14)},
        )
    )


_A = k.halflife_alpha(10)


@query(
    fold(f"{P}, {BASE}", {"n": "b.close", "w": "1"}, {"n": f"s.n * {1 - _A!r}::DOUBLE + b.close", "w": f"s.w * {1 - _A!r}::DOUBLE + 1"}, f"asset, date, {r('n / w', 'ew')}")
)
def adjusted_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.per_asset(panel(spark, sf_dir).select("asset", "date", "close"), {"ew": lambda d: k.ema(d["close"].to_numpy(), _A, adjust=True)}))


_TARGET = f"{P}, x AS (SELECT asset, date, row_number() OVER ({W}) i, sign(close / lag(close, 20) OVER ({W}) - 1)::DOUBLE t FROM panel_bars), b AS (SELECT *, coalesce(t, 0) t0 FROM x)"


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.signals import past_return

    return panel(spark, sf_dir).select("asset", "date", F.signum(past_return(F.col("close"), 20)).alias("t"))


@query(fold(_TARGET, {"p": "0"}, {"p": "CASE WHEN b.t IS NULL THEN s.p ELSE s.p + 0.1::DOUBLE * (b.t - s.p) END"}, f"asset, date, {r('p', '\"position\"')}"))
def partial_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.per_asset(_target(spark, sf_dir), {"position": lambda d: k.partial_adjustment(d["t"].to_numpy(float), 0.1)}))


_SCORE = f"{P}, b AS (SELECT asset, date, row_number() OVER ({W}) i, CASE WHEN lag(close, 20) OVER ({W}) IS NOT NULL THEN least(greatest(close / lag(close, 20) OVER ({W}) - 1, -1), 1) END t FROM panel_bars)"
_N, _S0 = "(s.n + CASE WHEN b.t IS NULL THEN 0 ELSE 1 END)", "(s.m + coalesce(abs(b.t), 0))"


@query(
    fold(
        _SCORE,
        {"m": "coalesce(abs(b.t), 0)", "n": "CASE WHEN b.t IS NULL THEN 0 ELSE 1 END", "p": "0"},
        {"m": _S0, "n": _N, "p": f"CASE WHEN b.t IS NOT NULL AND abs(b.t - s.p) > 0.5 * {_S0} / {_N} THEN b.t ELSE s.p END"},
        f"asset, date, {r('p', '\"position\"')}",
    )
)
def no_trade_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.operators.signals import past_return

    score = F.least(F.greatest(past_return(F.col("close"), 20), F.lit(-1.0)), F.lit(1.0))
    score = F.when(past_return(F.col("close"), 20).isNotNull(), score)
    return rounded(k.per_asset(panel(spark, sf_dir).select("asset", "date", score.alias("t")), {"position": lambda d: k.no_trade_buffer(d["t"].to_numpy(float), 0.5)}))


def _channel(n: int, f: str, x: str, name: str) -> str:
    w = f"({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) OVER {w} >= {n} THEN {f}({x}) OVER {w} END {name}"


_DON = f"{P}, b AS (SELECT asset, date, close c, row_number() OVER ({W}) i, {_channel(20, 'max', 'high', 'hi')}, {_channel(20, 'min', 'low', 'lo')}, {_channel(10, 'max', 'high', 'oh')}, {_channel(10, 'min', 'low', 'ol')} FROM panel_bars)"
_LEFT = "(s.p = 1 AND b.c < b.ol OR s.p = -1 AND b.c > b.oh)"
_ENTRY = "CASE WHEN b.c > b.hi THEN 1 WHEN b.c < b.lo THEN -1 ELSE 0 END"


@query(
    fold(
        _DON,
        {"p": "0", "q": "0", "o": "0"},
        {
            "p": f"CASE WHEN b.hi IS NULL THEN s.p WHEN {_LEFT} THEN 0 WHEN s.p = 0 THEN {_ENTRY} ELSE s.p END",
            "q": f"CASE WHEN b.hi IS NULL THEN 0 WHEN {_LEFT.replace('s.p', 's.q')} OR s.q = 0 THEN {_ENTRY} ELSE s.q END",
            "o": f"CASE WHEN b.hi IS NULL THEN 0 WHEN {_LEFT} THEN 0 WHEN s.p = 0 THEN {_ENTRY} ELSE s.p END",
        },
        "asset, date, o state, q flipped",
    )
)
def donchian(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lambda d: (d["high"].to_numpy(), d["low"].to_numpy(), d["close"].to_numpy())
    return k.per_asset(panel(spark, sf_dir).select("asset", "date", "high", "low", "close"), {"state": lambda d: k.donchian(*a(d), 20, 10), "flipped": lambda d: k.donchian(*a(d), 20, 10, flip=True)})


_ATR = "(s.a + 0.1::DOUBLE * (b.tr - s.a))"
_UP, _LOW = f"((b.high + b.low) / 2 + 3 * {_ATR})", f"((b.high + b.low) / 2 - 3 * {_ATR})"
_FU, _FL = f"CASE WHEN b.i <= 10 OR b.pc > s.fu THEN {_UP} ELSE least({_UP}, s.fu) END", f"CASE WHEN b.i <= 10 OR b.pc < s.fl THEN {_LOW} ELSE greatest({_LOW}, s.fl) END"


@query(
    fold(
        f"{P}, b AS (SELECT asset, date, high, low, close, row_number() OVER ({W}) i, lag(close) OVER ({W}) pc, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) tr FROM panel_bars)",
        {"a": "b.tr", "fu": "0", "fl": "0", "t": "0"},
        {"a": _ATR, "fu": _FU, "fl": _FL, "t": f"CASE WHEN b.i < 10 THEN 0 WHEN b.i = 10 THEN 1 WHEN b.close > {_FU} THEN 1 WHEN b.close < {_FL} THEN -1 ELSE s.t END"},
        "asset, date, t trend",
    )
)
def supertrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.per_asset(panel(spark, sf_dir).select("asset", "date", "high", "low", "close"), {"trend": lambda d: k.supertrend(d["high"].to_numpy(), d["low"].to_numpy(), d["close"].to_numpy())})


@query(fold(f"{P}, x AS (SELECT asset, date, row_number() OVER ({W}) i, close / lag(close) OVER ({W}) - 1 r FROM panel_bars), b AS (SELECT *, avg(r * r) FILTER (i BETWEEN 2 AND 21) OVER (PARTITION BY asset) v0, coalesce(lag(r) OVER ({W}), 0) q FROM x)", {"v": "b.v0"}, {"v": "0.94::DOUBLE * s.v + 0.06::DOUBLE * b.q * b.q"}, f"asset, date, {r('sqrt(v)', 'vol')}"))
def ewma_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.per_asset(panel(spark, sf_dir).select("asset", "date", "close"), {"vol": lambda d: np.sqrt(k.risk_metrics(k.returns(d["close"].to_numpy())))}))


@query()
def state_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals whose state is too rich for a short SQL fold; unit tests hold their hand cases."""
    a = lambda d: (d["high"].to_numpy(), d["low"].to_numpy(), d["close"].to_numpy())
    c = lambda d: d["close"].to_numpy()
    base = panel(spark, sf_dir).select("asset", "date", "high", "low", "close")
    return rounded(
        k.per_asset(
            base,
            {
                "kama": lambda d: k.kama(c(d)), "chandelier": lambda d: k.chandelier(*a(d)), "keltner": lambda d: k.keltner(*a(d)), "sar": lambda d: k.parabolic_sar(*a(d)), "adx": lambda d: k.adx(*a(d)),
                "kalman": lambda d: k.kalman_trend(np.log(c(d))), "hurst": lambda d: k.hurst(c(d)), "ew_std": lambda d: k.ew_std(k.returns(c(d)), 20),
                "reentry": lambda d: k.take_profit_reentry(k.returns(c(d)), np.sign(c(d) - np.concatenate([np.full(min(20, len(d)), np.nan), c(d)[:-20]])), np.full(len(d), 0.02), 3.0, 20),
            },
        )
    )


@query()
def garch_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(k.per_asset(panel(spark, sf_dir).select("asset", "date", "close"), {"vol": lambda d: np.sqrt(k.garch(np.clip(k.returns(d["close"].to_numpy()), -1, 1)))}))


_TAPE = f"{T}, t AS (SELECT id, symbol || '/' || ts_ms // {DAY} g, ts_ms, ln(tick) p, CASE WHEN is_buyer_maker THEN -lots ELSE lots END::DOUBLE v FROM tape), b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ts_ms, id) i, p - lag(p) OVER (PARTITION BY g ORDER BY ts_ms, id) d FROM t)"
_UPS, _DOWNS = "greatest(0, s.u + b.d)", "least(0, s.w + b.d)"
_CROSS = "(greatest(s.h, b.p) - least(s.l, b.p) >= 0.003)"


@query(
    fold(
        _TAPE,
        {"h": "b.p", "l": "b.p", "rb": "0", "rc": "0", "u": "0", "w": "0", "cb": "0", "cc": "0", "x": "b.v", "ib": "0", "ic": "CASE WHEN abs(b.v) >= 60 THEN 1 ELSE 0 END"},
        {
            "h": f"CASE WHEN {_CROSS} THEN b.p ELSE greatest(s.h, b.p) END", "l": f"CASE WHEN {_CROSS} THEN b.p ELSE least(s.l, b.p) END", "rb": "s.rb + s.rc", "rc": f"CASE WHEN {_CROSS} THEN 1 ELSE 0 END",
            "u": f"CASE WHEN {_UPS} >= 0.002 OR {_DOWNS} <= -0.002 THEN 0 ELSE {_UPS} END", "w": f"CASE WHEN {_UPS} >= 0.002 OR {_DOWNS} <= -0.002 THEN 0 ELSE {_DOWNS} END", "cb": "s.cb + s.cc", "cc": f"CASE WHEN {_UPS} >= 0.002 OR {_DOWNS} <= -0.002 THEN 1 ELSE 0 END",
            "x": "CASE WHEN s.ic = 1 THEN b.v ELSE s.x + b.v END", "ib": "s.ib + s.ic", "ic": "CASE WHEN abs(CASE WHEN s.ic = 1 THEN b.v ELSE s.x + b.v END) >= 60 THEN 1 ELSE 0 END",
        },
        "split_part(g, '/', 1) symbol, cast(split_part(g, '/', 2) AS BIGINT) AS \"day\", id, cast(rb AS BIGINT) range_bar, cast(cb AS BIGINT) cusum_bar, cast(ib AS BIGINT) imbalance_bar",
        key="g",
        order="id",
    )
)
def stateful_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda d: d["tick"].to_numpy(float)
    v = lambda d: np.where(d["is_buyer_maker"], -d["lots"], d["lots"]).astype(float)
    return k.per_symbol_day(views.tape(spark, sf_dir), {"range_bar": lambda d: k.range_bars(p(d), 0.003), "cusum_bar": lambda d: k.cusum_bars(p(d), 0.002), "imbalance_bar": lambda d: k.imbalance_bars(v(d), 60.0)})


@query()
def adaptive_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda d: d["tick"].to_numpy(float)
    v = lambda d: np.where(d["is_buyer_maker"], -d["lots"], d["lots"]).astype(float)
    return k.per_symbol_day(views.tape(spark, sf_dir), {"bar": lambda d: k.adaptive_imbalance_bars(v(d), 60.0), "steps": lambda d: k.ladder_steps(p(d), 0.001)})


_AD = f"""{P}, x AS (SELECT asset, date, high, low, close c, row_number() OVER ({W}) i, ln(close) y, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) tr, abs(close - lag(close) OVER ({W})) mv,
    abs(close - lag(close, 10) OVER ({W})) net, high - lag(high) OVER ({W}) up, lag(low) OVER ({W}) - low dn FROM panel_bars),
  b AS (SELECT *, coalesce(net / nullif(sum(mv) OVER ({W} ROWS 9 PRECEDING), 0), 0) er, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END pl, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END mi FROM x)"""
_FAST, _SLOW = 2 / 3, 2 / 31
_P11, _P12, _P22 = "(s.p11 + 2 * s.p12 + s.p22 + 0.001)", "(s.p12 + s.p22)", "(s.p22 + 0.00001)"
_S = f"({_P11} + 0.01)"
_A14, _N20 = f"{1 / 14!r}::DOUBLE", f"{2 / 21!r}::DOUBLE"
_ATR, _PL, _MI, _EMA, _A20 = f"(s.a + {_A14} * (b.tr - s.a))", f"(s.ep + {_A14} * (b.pl - s.ep))", f"(s.em + {_A14} * (b.mi - s.em))", f"(s.k + {_N20} * (b.c - s.k))", "(s.a20 + 0.05::DOUBLE * (b.tr - s.a20))"
_DX = f"CASE WHEN {_PL} + {_MI} > 0 THEN 100 * abs({_PL} - {_MI}) / ({_PL} + {_MI}) ELSE 0 END"


@query(
    fold(
        _AD,
        {"kama": "NULL", "l": "b.y", "m": "0", "p11": "1 - 1 / 1.01::DOUBLE", "p12": "0", "p22": "1", "a": "b.tr", "ep": "0", "em": "0", "adx": "0", "k": "b.c", "a20": "b.tr", "st": "0"},
        {
            "kama": f"CASE WHEN b.i < 11 THEN NULL WHEN b.i = 11 THEN b.c ELSE s.kama + (b.er * {_FAST - _SLOW!r}::DOUBLE + {_SLOW!r}::DOUBLE) ** 2 * (b.c - s.kama) END",
            "l": f"s.l + s.m + {_P11} / {_S} * (b.y - s.l - s.m)", "m": f"s.m + {_P12} / {_S} * (b.y - s.l - s.m)",
            "p11": f"{_P11} * (1 - {_P11} / {_S})", "p12": f"{_P12} * (1 - {_P11} / {_S})", "p22": f"{_P22} - {_P12} / {_S} * {_P12}",
            "a": _ATR, "ep": _PL, "em": _MI, "adx": f"s.adx + {_A14} * ({_DX} - s.adx)", "k": _EMA, "a20": _A20, "st": f"CASE WHEN b.c > {_EMA} + {_A20} THEN 1 WHEN b.c < {_EMA} - {_A20} THEN -1 ELSE s.st END",
        },
        f"asset, date, {r('kama', 'kama')}, {r('m', 'slope')}, {r('adx', 'adx')}, st keltner",
    )
)
def adaptive_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lambda d: (d["high"].to_numpy(), d["low"].to_numpy(), d["close"].to_numpy())
    c = lambda d: d["close"].to_numpy()
    base = panel(spark, sf_dir).select("asset", "date", "high", "low", "close")
    return rounded(k.per_asset(base, {"kama": lambda d: k.kama(c(d)), "slope": lambda d: k.kalman_trend(np.log(c(d))), "adx": lambda d: k.adx(*a(d)), "keltner": lambda d: k.keltner(*a(d))}))


_ST = f"""{P}, b AS (SELECT asset, date, high h, low l, close c, row_number() OVER ({W}) i, {_channel(20, 'max', 'high', 'hi')}, {_channel(20, 'min', 'low', 'lo')}, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) tr,
    lag(high) OVER ({W}) h1, lag(low) OVER ({W}) l1, lag(close) OVER ({W}) c1, lag(high, 2) OVER ({W}) h2, lag(low, 2) OVER ({W}) l2 FROM panel_bars)"""
_CA = "(s.a + 0.05::DOUBLE * (b.tr - s.a))"
_BEST = "(CASE WHEN s.p = 1 THEN greatest(s.best, b.c) ELSE least(s.best, b.c) END)"
_STOP = f"(CASE WHEN s.p = 1 THEN greatest(s.stop, {_BEST} - 3 * {_CA}) ELSE least(s.stop, {_BEST} + 3 * {_CA}) END)"
_POS = f"CASE WHEN s.p <> 0 THEN CASE WHEN s.p * (b.c - {_STOP}) < 0 THEN 0 ELSE s.p END WHEN b.c > b.hi THEN 1 WHEN b.c < b.lo THEN -1 ELSE 0 END"
_SAR = "(CASE WHEN s.up = 1 THEN least(s.sar + s.af * (s.ep - s.sar), b.l1, b.l2) ELSE greatest(s.sar + s.af * (s.ep - s.sar), b.h1, b.h2) END)"
_FLIP = f"(s.up = 1 AND b.l < {_SAR} OR s.up = 0 AND b.h > {_SAR})"
_NEW = "(s.up = 1 AND b.h > s.ep OR s.up = 0 AND b.l < s.ep)"


@query(
    fold(
        _ST,
        {"a": "b.tr", "p": "0", "best": "0", "stop": "0", "o": "0", "up": "0", "sar": "0", "ep": "0", "af": "0.02"},
        {
            "a": _CA, "p": f"CASE WHEN b.hi IS NULL THEN s.p ELSE {_POS} END", "best": f"CASE WHEN b.hi IS NULL THEN s.best WHEN s.p <> 0 THEN {_BEST} ELSE b.c END",
            "stop": f"CASE WHEN b.hi IS NULL THEN s.stop WHEN s.p <> 0 THEN {_STOP} WHEN b.c > b.hi THEN b.c - 3 * {_CA} WHEN b.c < b.lo THEN b.c + 3 * {_CA} ELSE s.stop END", "o": f"CASE WHEN b.hi IS NULL THEN 0 ELSE {_POS} END",
            "up": f"CASE WHEN b.i = 2 THEN CASE WHEN b.c >= b.c1 THEN 1 ELSE 0 END WHEN {_FLIP} THEN 1 - s.up ELSE s.up END",
            "sar": f"CASE WHEN b.i = 2 THEN CASE WHEN b.c >= b.c1 THEN b.l1 ELSE b.h1 END WHEN {_FLIP} THEN s.ep ELSE {_SAR} END",
            "ep": f"CASE WHEN b.i = 2 THEN CASE WHEN b.c >= b.c1 THEN b.h ELSE b.l END WHEN {_FLIP} THEN CASE WHEN s.up = 1 THEN b.l ELSE b.h END WHEN {_NEW} THEN CASE WHEN s.up = 1 THEN b.h ELSE b.l END ELSE s.ep END",
            "af": f"CASE WHEN b.i = 2 OR {_FLIP} THEN 0.02 WHEN {_NEW} THEN least(0.2, s.af + 0.02) ELSE s.af END",
        },
        "asset, date, o chandelier, CASE WHEN i = 1 THEN 0 WHEN up = 1 THEN 1 ELSE -1 END::DOUBLE sar",
    )
)
def trailing_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lambda d: (d["high"].to_numpy(), d["low"].to_numpy(), d["close"].to_numpy())
    return k.per_asset(panel(spark, sf_dir).select("asset", "date", "high", "low", "close"), {"chandelier": lambda d: k.chandelier(*a(d)), "sar": lambda d: k.parabolic_sar(*a(d))})
