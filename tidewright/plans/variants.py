"""Queries of further forms of operators: deeper books, other impact slopes, contract rolls, tails and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import by_asset, r6_sql, rounded, trailing, upto, warm
from tidewright.operators import backtest, book, flow, kernels, risk, rolling
from tidewright.plans.book import UPDATES
from tidewright.plans.joins import HOURLY, hourly
from tidewright.plans.kernels import _FAST, _SLOW, fold
from tidewright.registry import query

P, T, B = f"WITH {views.PANEL_SQL}", f"WITH {views.TAPE_SQL}", f"WITH {views.BOOK_SQL}"
W = "PARTITION BY asset ORDER BY date"
HOUR, DAY = 3_600_000, 86_400_000
SIDE = "CASE WHEN is_buyer_maker THEN -1 ELSE 1 END"


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


_E = "CASE WHEN side = 1 THEN CASE WHEN tick >= pt THEN size ELSE 0 END - CASE WHEN tick <= pt THEN ps ELSE 0 END ELSE CASE WHEN tick >= pt THEN ps ELSE 0 END - CASE WHEN tick <= pt THEN size ELSE 0 END END"


@query(
    f"""{B}, {UPDATES}, t_ AS (SELECT * FROM g_ WHERE k <= 10), z_ AS (SELECT u FROM t_ GROUP BY 1 HAVING count(*) = 20), p_ AS (SELECT ts_ms, side, k, tick, size, lag(tick) OVER w pt, lag(size) OVER w ps FROM t_ JOIN z_ USING (u) WINDOW w AS (PARTITION BY ts_ms // {DAY}, side, k ORDER BY u))
    SELECT ts_ms // {HOUR} * {HOUR} moment, k AS "level", {r(f'sum({_E})', 'ofi')}, count(*) // 2 n FROM p_ WHERE pt IS NOT NULL GROUP BY 1, 2"""
)
def ten_level_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.level_flow(book.fold_levels(views.book_deltas(spark, sf_dir), 10, 6 * HOUR), HOUR))


@query(
    f"""{B}, {UPDATES}, t AS (SELECT epoch_us(ts) // 1000 ts_ms, 19999 - user_id % 3 tick, cast(user_id % 50 + 1 AS DOUBLE) size FROM events), s AS (SELECT tick, ts_ms, sum(sum(size)) OVER (PARTITION BY tick, ts_ms // {DAY} ORDER BY ts_ms) upto FROM t GROUP BY 1, 2),
    a AS (SELECT us.*, coalesce(s.upto, 0) upto FROM us ASOF LEFT JOIN (SELECT *, ts_ms // {DAY} d FROM s) s ON us.bid = s.tick AND us.ts_ms // {DAY} = s.d AND us.ts_ms >= s.ts_ms WHERE bid IS NOT NULL),
    l AS (SELECT ts_ms // {DAY} AS "day", bid = lag(bid) OVER w same, q_bid - lag(q_bid) OVER w dq, upto - lag(upto) OVER w tr FROM a WINDOW w AS (PARTITION BY ts_ms // {DAY} ORDER BY u))
    SELECT "day", count(*) n, {r('sum(tr)', 'traded')}, {r('sum(least(greatest(dq + tr, 0), tr))', 'hidden')}, {r('sum(greatest(dq + tr, 0))', 'added')}, {r('sum(greatest(-dq - tr, 0))', 'cancelled')} FROM l WHERE same GROUP BY 1"""
)
def hidden_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades at the three best prices that the book can have, one an event."""
    d = views.table(spark, sf_dir, "events")
    trades = d.select(F.expr("unix_micros(cast(ts AS timestamp)) div 1000").alias("ts_ms"), (19999 - F.col("user_id") % 3).alias("tick"), (F.col("user_id") % 50 + 1).cast("double").alias("size"))
    return rounded(book.hidden_flow(book.fold_states(views.book_deltas(spark, sf_dir), 6 * HOUR), trades))


@query(
    f"""{T}, {HOURLY}, m AS (SELECT *, (min(ts_ms) OVER (PARTITION BY symbol) + max(ts_ms) OVER (PARTITION BY symbol)) / 2 split, abs(tick - lag(tick) OVER (PARTITION BY symbol ORDER BY ts_ms)) move FROM hourly), g AS (SELECT symbol, max(move) FILTER (ts_ms < split) largest FROM m GROUP BY 1),
    f AS (SELECT m.symbol, m.ts_ms, m.move FROM m JOIN g USING (symbol) WHERE m.ts_ms >= split AND m.move > largest QUALIFY row_number() OVER (PARTITION BY m.symbol ORDER BY m.ts_ms) = 1) SELECT g.symbol, largest, f.ts_ms, f.move FROM g LEFT JOIN f USING (symbol)"""
)
def cascade_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hour of the second half of the tape with a larger move than any of the first half."""
    h = hourly(spark, sf_dir)
    edges = h.groupBy("symbol").agg(((F.min("ts_ms") + F.max("ts_ms")) / 2).alias("split"))
    return flow.first_beyond(h.join(edges, "symbol"), F.col("split"))


_D = lambda x, y, z: f"({x[0]} * ({y[1]} * {z[2]} - {y[2]} * {z[1]}) - {y[0]} * ({x[1]} * {z[2]} - {x[2]} * {z[1]}) + {z[0]} * ({x[1]} * {y[2]} - {x[2]} * {y[1]}))"
_X = [["c11", "c12", "c13"], ["c12", "c22", "c23"], ["c13", "c23", "c33"]]
_Y = ["c1y", "c2y", "c3y"]


@query(
    f"""{T}, b AS (SELECT symbol, ts_ms // {6 * HOUR} b, sum({SIDE} * sqrt(lots * tick / 10.0::DOUBLE)) x, ln(max_by(tick, (ts_ms, id))) - ln(min_by(tick, (ts_ms, id))) rr FROM tape GROUP BY 1, 2), h AS (SELECT symbol, 10000 * sum(x * rr) / sum(x * x) root_value FROM b GROUP BY 1),
    t AS (SELECT symbol, tick - lag(tick) OVER w y, greatest({SIDE} * lots, 0) x1, least({SIDE} * lots, 0) x2, {SIDE} - lag({SIDE}) OVER w x3 FROM tape WINDOW w AS (PARTITION BY symbol, ts_ms // {DAY} ORDER BY ts_ms, id)),
    m AS (SELECT symbol, count(*) n, covar_pop(x1, x1) c11, covar_pop(x1, x2) c12, covar_pop(x1, x3) c13, covar_pop(x2, x2) c22, covar_pop(x2, x3) c23, covar_pop(x3, x3) c33, covar_pop(x1, y) c1y, covar_pop(x2, y) c2y, covar_pop(x3, y) c3y FROM t WHERE y IS NOT NULL GROUP BY 1)
    SELECT h.symbol, {r('root_value', 'root_value')}, n, {r(f'{_D(_Y, _X[1], _X[2])} / {_D(*_X)}', 'bought')}, {r(f'{_D(_X[0], _Y, _X[2])} / {_D(*_X)}', 'sold')}, {r(f'{_D(_X[0], _X[1], _Y)} / {_D(*_X)}', 'spread')} FROM h JOIN m USING (symbol)"""
)
def kyle_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.kyle_variants(views.tape(spark, sf_dir), 6 * HOUR))


_RK = lambda c, n: f"rank() OVER (PARTITION BY symbol ORDER BY {c}) + (count(*) OVER (PARTITION BY symbol, {c}) - 1) / 2.0::DOUBLE {n}"


@query(
    f"""{T}, {HOURLY}, a AS (SELECT symbol, ts_ms, lots, (ts_ms // {HOUR}) % 24 h, tick - lag(tick) OVER (PARTITION BY symbol ORDER BY ts_ms) d FROM hourly), k AS (SELECT symbol, {_RK('lots', 'a')}, {_RK('d', 'b')}, {_RK('h', 'c')} FROM a WHERE d IS NOT NULL),
    q AS (SELECT symbol, corr(a, b) ab, corr(a, c) ac, corr(b, c) bc, count(*) n FROM k GROUP BY 1) SELECT symbol, {r('(ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc))', 'partial')}, {r('ab', 'rho')}, n FROM q"""
)
def partial_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    h = hourly(spark, sf_dir).withColumn("h", F.expr(f"ts_ms div {HOUR}") % 24)
    return rounded(flow.partial_spearman(h.withColumn("d", F.col("tick") - F.lag("tick").over(Window.partitionBy("symbol").orderBy("ts_ms"))), ["symbol"], "lots", "d", "h"))


N = 60
_F = f"({W} ROWS {N - 1} PRECEDING)"
_S = lambda k: f"(sum(x ** {k}) OVER {_F} / {N})"
_M2 = f"({_S(2)} - {_S(1)} ** 2)"
_M4 = f"({_S(4)} - 4 * {_S(1)} * {_S(3)} + 6 * {_S(1)} ** 2 * {_S(2)} - 3 * {_S(1)} ** 4)"


@query(
    f"""{P}, b AS (SELECT asset, date, 10 * (close / lag(close) OVER ({W}) - 1) x FROM panel_bars)
    SELECT asset, date, {r(f'CASE WHEN count(x) OVER {_F} >= {N} THEN {(N - 1) / (N - 2) / (N - 3)!r}::DOUBLE * ({N + 1} * {_M4} / {_M2} ** 2 - {3 * (N - 1)}) END', 'kurtosis')},
      {r(f'CASE WHEN count(x) OVER ({W}) >= 30 THEN quantile_cont(x, 0.9) OVER ({W}) END', 'upper')}, {r(f'CASE WHEN count(x) OVER ({W}) >= 30 THEN quantile_cont(x, 0.1) OVER ({W}) END', 'lower')} FROM b"""
)
def tail_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling kurtosis, corrected for bias, and expanding quantiles of ten times the daily return."""
    base = views.panel_bars(spark, sf_dir).select("asset", "date", (10 * rolling.simple_return(F.col("close"))).alias("x"))
    w, x = by_asset(), F.col("x")
    m = lambda k: F.sum(F.pow(x, F.lit(float(k)))).over(trailing(w, N)) / N
    m2 = m(2) - m(1) * m(1)
    m4 = m(4) - 4 * m(1) * m(3) + 6 * m(1) * m(1) * m(2) - 3 * F.pow(m(1), F.lit(4.0))
    kurtosis = (N - 1) / (N - 2) / (N - 3) * ((N + 1) * m4 / (m2 * m2) - 3 * (N - 1))
    quantile = lambda q: warm(F.percentile(x, q).over(upto(w)), x, upto(w), 30)
    return rounded(base.select("asset", "date", warm(kurtosis, x, trailing(w, N), N).alias("kurtosis"), quantile(0.9).alias("upper"), quantile(0.1).alias("lower")))


@query(
    f"""{P}, {views.MACRO_SQL}, c AS (SELECT asset, date, high, low, close, {r6_sql('m.value')} / 1e10 rf, close / lag(close) OVER ({W}) - 1 r FROM panel_bars p ASOF LEFT JOIN macro m ON p.date >= m.available),
    g AS (SELECT *, first_value(close) OVER ({W}) * exp(sum(ln(greatest(1 + coalesce(r - coalesce(rf, 0), 0), 1e-12))) OVER ({W})) x FROM c) SELECT asset, date, {r('x', '"index"')}, {r('high * x / close', 'high')}, {r('low * x / close', 'low')} FROM g"""
)
def excess_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the return over cash, high and low scaled by the same factor; the cash rate is the last public macro value."""
    from tidewright.plans.joins import publication_lag

    cash = publication_lag(spark, sf_dir).select("asset", "date", (F.coalesce("value", F.lit(0.0)) / 1e10).alias("rf"))
    return rounded(backtest.excess_index(views.panel_bars(spark, sf_dir).join(cash, ["asset", "date"])))


@query(f"{P}, b AS (SELECT asset, date, 20 * (close / lag(close, 20) OVER ({W}) - 1) x FROM panel_bars) SELECT asset, date, {r('sign(x)', 'sign')}, {r('least(greatest(x, -1), 1)', 'clip')}, {r('tanh(x)', 'tanh')} FROM b WHERE x IS NOT NULL")
def position_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("close")
    base = views.panel_bars(spark, sf_dir).select("asset", "date", (20 * (c / F.lag(c, 20).over(by_asset()) - 1)).alias("x")).where("x IS NOT NULL")
    return rounded(base.select("asset", "date", *[v.alias(k) for k, v in backtest.envelopes(F.col("x")).items()]))


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.plans.risk import _contracts as quoted

    c = quoted(spark, sf_dir)
    left = F.datediff("expiry", "date")
    return c.withColumn("volume", F.when(left <= 31, left).otherwise(F.lit(12) + F.datediff("date", F.trunc("date", "MM")) % 5))


_CONTRACTS = """x0 AS (SELECT asset, date, close, k, year(date) * 12 + month(date) - 1 + k m, last_day(cast(date_trunc('month', date) + to_months(cast(k AS INT)) AS DATE)) expiry FROM panel_bars, (VALUES (0), (1)) t(k)),
    c AS (SELECT asset, date, 'c' || m contract, close + m - k cl, expiry, expiry - date lf, CASE WHEN expiry - date <= 31 THEN expiry - date ELSE 12 + (day(date) - 1) % 5 END v FROM x0),
    n AS (SELECT *, lead(v) OVER (PARTITION BY asset, date ORDER BY expiry) nv FROM c), rolls AS (SELECT asset, contract, min(date) FILTER (nv IS NOT NULL AND (lf <= 2 OR lf <= 40 AND nv > v)) roll FROM n GROUP BY 1, 2)"""


@query(
    f"""{P}, {_CONTRACTS}, h AS (SELECT c.asset, date, c.contract, cl FROM c JOIN rolls USING (asset, contract) WHERE roll IS NULL OR date < roll QUALIFY row_number() OVER (PARTITION BY c.asset, date ORDER BY expiry) = 1),
    b AS (SELECT *, coalesce(lag(contract) OVER ({W}), contract) hb FROM h), s AS (SELECT asset, date, contract, ln(cl / lag(cl) OVER (PARTITION BY asset, contract ORDER BY date)) st FROM c),
    j AS (SELECT b.*, coalesce(st, 0) st FROM b LEFT JOIN s ON b.asset = s.asset AND b.date = s.date AND b.hb = s.contract)
    SELECT asset, date, contract, cl AS "close", {r('first_value(cl) OVER (PARTITION BY asset ORDER BY date DESC) * exp(-coalesce(sum(st) OVER (PARTITION BY asset ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))', 'adjusted')} FROM j"""
)
def volume_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts rolled where the next one trades more, and their prices chained by ratio."""
    c = _contracts(spark, sf_dir)
    held = risk.held_contracts(c, risk.roll_dates(c))
    return rounded(risk.ratio_adjusted(c, held).withColumn("close", F.col("close").cast("double")))


_KAMA = fold(
    f"""{views.PANEL_SQL}, x AS (SELECT asset, date, close c, row_number() OVER ({W}) i, abs(close - lag(close) OVER ({W})) mv, abs(close - lag(close, 10) OVER ({W})) net FROM panel_bars), b AS (SELECT *, coalesce(net / nullif(sum(mv) OVER ({W} ROWS 9 PRECEDING), 0), 0) er FROM x)""",
    {"kama": "NULL"},
    {"kama": f"CASE WHEN b.i < 11 THEN NULL WHEN b.i = 11 THEN b.c ELSE s.kama + (b.er * {_FAST - _SLOW!r}::DOUBLE + {_SLOW!r}::DOUBLE) ** 2 * (b.c - s.kama) END"},
    "asset, date, kama",
)


@query(
    f"""WITH k AS ({_KAMA}), d AS (SELECT asset, date, kama, kama - lag(kama) OVER ({W}) d FROM k), e AS (SELECT *, CASE WHEN count(d) OVER ({W} ROWS 19 PRECEDING) >= 20 THEN 0.5::DOUBLE * stddev_samp(d) OVER ({W} ROWS 19 PRECEDING) END e FROM d),
    t AS (SELECT asset, date, kama, CASE WHEN d > e THEN 1.0::DOUBLE WHEN d < -e THEN -1.0::DOUBLE END t FROM e), p AS ({P} SELECT asset, date, close FROM panel_bars)
    SELECT t.asset, t.date, coalesce(sign(close - kama), 0)::DOUBLE AS "cross", coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY t.asset ORDER BY t.date), 0) filtered FROM t JOIN p ON t.asset = p.asset AND t.date = p.date"""
)
def kama_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda d: d["close"].to_numpy()
    base = views.panel_bars(spark, sf_dir).select("asset", "date", "close")
    return kernels.per_asset(base, {"cross": lambda d: kernels.kama_state(c(d), None), "filtered": lambda d: kernels.kama_state(c(d))})


_U = lambda seed: f"((i + {seed * 7919}) * 1103515245 + 12345) % 2147483648 / 2147483648.0::DOUBLE"
_GATE = lambda seed: f"coalesce(last_value(CASE WHEN {_U(seed)} < {0.1 * 0.4 / (1 - 0.4)!r}::DOUBLE THEN 1 WHEN {_U(seed)} >= {1 - 0.1!r}::DOUBLE THEN 0 END IGNORE NULLS) OVER ({W}), 0)"


@query(f"{P}, b AS (SELECT asset, date, row_number() OVER ({W}) i FROM panel_bars) SELECT asset, date, {_GATE(1)} AS one, {_GATE(2)} AS two FROM b")
def random_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two gates that are on 40 % of the time, in spells of ten days."""
    w = by_asset()
    base = views.panel_bars(spark, sf_dir).select("asset", "date", F.row_number().over(w).cast("long").alias("i"))
    return base.select("asset", "date", *[backtest.random_gate(F.col("i"), 0.4, 10.0, k, w).alias(name) for k, name in ((1, "one"), (2, "two"))])


@query()
def hedged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past returns as scores, without the common components of the three years before each day. Tests hold whole results against numpy."""
    from tidewright.operators import selection
    from tidewright.plans.selection import LEAST, returns

    c = F.col("close")
    s = views.panel_bars(spark, sf_dir).select("date", "asset", (c / F.lag(c, 20).over(by_asset()) - 1).alias("score"))
    return rounded(selection.trailing_hedge(s, selection.scaled_returns(returns(spark, sf_dir)), least=LEAST))


@query()
def factor_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy's net return on the market's return and its square, with Newey-West errors. Tests hold the operator against numpy."""
    from tidewright.operators import inference
    from tidewright.plans.positions import daily

    market = views.panel_bars(spark, sf_dir).select("date", rolling.simple_return(F.col("close")).alias("r")).groupBy("date").agg(F.avg("r").alias("m"))
    x = daily(spark, sf_dir).join(market, "date").select("date", "net", "m", (F.col("m") * F.col("m")).alias("m2"))
    return rounded(inference.ols_several(x, "net", ["m", "m2"]))
