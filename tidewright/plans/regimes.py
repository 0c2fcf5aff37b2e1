"""Queries of regimes, carry, funding, decisions and resting orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import by_asset, r6_sql, rounded
from tidewright.operators import flow, kernels, regimes, tape
from tidewright.plans.book import LEVELS, levels
from tidewright.plans.joins import HOURLY, hourly
from tidewright.plans.positions import DAILY, daily
from tidewright.plans.tape import ORDERS
from tidewright.registry import query

P, T = f"WITH {views.PANEL_SQL}", f"WITH {views.TAPE_SQL}"
W = "PARTITION BY asset ORDER BY date"
HOUR, DAY = 3_600_000, 86_400_000


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


@query(
    f"""{P}, t AS (SELECT asset series, date, floor(close / 500) target FROM panel_bars), m AS (SELECT *, coalesce(cast(target <> lag(target) OVER (PARTITION BY series ORDER BY date) AS INT), 0) moved FROM t)
    SELECT series, date, cast(target AS BIGINT) target, sum(moved) OVER (PARTITION BY series ORDER BY date RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND CURRENT ROW) = 0 hold FROM m"""
)
def policy_on_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.panel_bars(spark, sf_dir).select(F.col("asset").alias("series"), "date", F.floor(F.col("close") / 500).alias("target"))
    return regimes.on_hold(t, 5)


VINT = 'all_v AS (SELECT y AS vintage, m."month", m.value FROM macro m, (SELECT DISTINCT year(available) y FROM macro) WHERE m.available < make_date(y + 1, 1, 1))'


@query(
    f"""WITH {views.MACRO_SQL}, {VINT}, g AS (SELECT *, value / lag(value, 12) OVER w - 1 yoy FROM all_v WINDOW w AS (PARTITION BY vintage ORDER BY "month")), x AS (SELECT *, abs(yoy - lag(yoy, 12) OVER w) x FROM g WINDOW w AS (PARTITION BY vintage ORDER BY "month")),
    s AS (SELECT vintage, max("month") AS "month", quantile_cont(x, 0.8) lim FROM x GROUP BY 1)
    SELECT vintage, "month", {r('(SELECT x.x FROM x WHERE x.vintage = s.vintage AND x."month" = s."month")', 'x')}, {r('lim', '"limit"')}, (SELECT x.x FROM x WHERE x.vintage = s.vintage AND x."month" = s."month") > lim alarm FROM s"""
)
def real_time_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's vintage holds what was published by its end."""
    m = views.macro(spark, sf_dir)
    years = m.select(F.year("available").cast("long").alias("vintage")).distinct()
    v = m.crossJoin(F.broadcast(years)).where(F.col("available") < F.make_date((F.col("vintage") + 1).cast("int"), F.lit(1), F.lit(1)))  # a few years
    return rounded(regimes.real_time(v.select("vintage", "month", "value")))


@query(
    f"""{P}, {DAILY}, f AS (SELECT date, net > 0 a, turnover > 0.00015 b, trades > 3 c FROM daily) SELECT date, coalesce(a::INT, 0) + coalesce(b::INT, 0) + coalesce(c::INT, 0) >= 2 AS "on", coalesce(a::INT, 0) + coalesce(b::INT, 0) + coalesce(c::INT, 0) >= 1 AS "any", coalesce(a::INT, 0) + coalesce(b::INT, 0) + coalesce(c::INT, 0) = 3 AS "all" FROM f"""
)
def composite_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    f = d.select("date", (F.col("net") > 0).alias("a"), (F.col("turnover") > 0.00015).alias("b"), (F.col("trades") > 3).alias("c"))
    return regimes.switches(f, ["a", "b", "c"], 2).select("date", "on", "any", "all")


@query(f"{P}, {DAILY}, j AS (SELECT date, net b, gross * 3 a FROM daily WHERE trades > 2), k AS (SELECT stddev_samp(b) / stddev_samp(a) k FROM j) SELECT date, {r('0.7 * b + 0.3 * k * a', 'r')} FROM j, k")
def equal_vol_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).where("trades > 2")
    return rounded(regimes.blend(d.select("date", F.col("net").alias("r")), d.select("date", (F.col("gross") * 3).alias("r")), 0.3))


@query(
    f"""{P}, x AS (SELECT asset, date, lag(close) OVER ({W}) p, close, date - lag(date) OVER ({W}) gap, volume / 10000.0 y1, lag(volume) OVER ({W}) / 10000.0 y0 FROM panel_bars)
    SELECT asset, date, {r('close / p - 1 + (0.05 - 0.02) * gap / 365.0', 'fx')}, {r('y0 / 12 - (1 - (1 + y0) ** -10) / y0 * (y1 - y0) - 0.02 / 12', 'bond')} FROM x"""
)
def carry_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = by_asset()
    x = views.panel_bars(spark, sf_dir).select("asset", "date", (F.col("close") / F.lag("close").over(w) - 1).alias("s"), F.datediff("date", F.lag("date").over(w)).alias("gap"), (F.col("volume") / 10000.0).alias("y1"), (F.lag("volume").over(w) / 10000.0).alias("y0"))
    return rounded(x.select("asset", "date", regimes.fx_carry(F.col("s"), F.lit(0.05), F.lit(0.02), F.col("gap")).alias("fx"), regimes.bond_return(F.col("y0"), F.col("y1"), F.lit(0.02)).alias("bond")))


@query(
    f"""{T}, p AS (SELECT symbol, (ts_ms // {8 * HOUR} + 1) * {8 * HOUR} settle_ms, max_by(CASE WHEN is_buyer_maker THEN -lots ELSE lots END, (ts_ms, id)) AS pos FROM tape GROUP BY 1, 2), h AS (SELECT symbol, ts_ms // {8 * HOUR} * {8 * HOUR} settle_ms, (max_by(tick, (ts_ms, id)) - 20000) / 1e6::DOUBLE prem FROM tape GROUP BY 1, 2)
    SELECT symbol, settle_ms, pos AS "position", {r('prem + least(greatest(0.0001 - prem, -0.0005), 0.0005)', 'rate')}, {r('-pos * (prem + least(greatest(0.0001 - prem, -0.0005), 0.0005))', 'paid')} FROM p JOIN h USING (symbol, settle_ms)"""
)
def funding_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tape(spark, sf_dir)
    prem = t.groupBy("symbol", (F.floor(F.col("ts_ms") / (8 * HOUR)) * 8 * HOUR).alias("settle_ms")).agg(((F.max_by("tick", F.struct("ts_ms", "id")) - 20000) / 1e6).alias("prem"))
    rates = prem.select("symbol", "settle_ms", regimes.funding_rate(F.col("prem")).alias("rate"))
    held = t.select("symbol", "ts_ms", "id", F.when(F.col("is_buyer_maker"), -F.col("lots")).otherwise(F.col("lots")).alias("position"))
    return rounded(regimes.funding_paid(held, rates))


@query(f"{P}, x AS (SELECT asset, date, 0.001 - coalesce(volume / 1e5 - lag(volume / 1e5) OVER ({W}), 0) - 0.02 / 252 r FROM panel_bars) SELECT asset, date, {r('r', 'r')}, {r(f'sum(r) OVER ({W})', 'total')} FROM x")
def cash_and_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.panel_bars(spark, sf_dir).select("asset", "date", (F.col("volume") / 1e5).alias("basis"), F.lit(0.001).alias("funding"))
    return rounded(regimes.cash_and_carry(b, 0.02))


@query(
    f"""{T}, b AS (SELECT symbol, ts_ms // {6 * HOUR} h, max_by(tick, (ts_ms, id)) c, min(tick) l, max(tick) hi, count(*) n FROM tape GROUP BY 1, 2)
    SELECT symbol, (h + 1) * {6 * HOUR} decide_ms, c price, lead(c, 1) OVER w close1, lead(l, 1) OVER w low1, lead(hi, 1) OVER w high1, lead(c, 2) OVER w close2, lead(l, 2) OVER w low2, lead(hi, 2) OVER w high2, {r('n / quantile_cont(n, 0.5) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)', 'activity')} FROM b WINDOW w AS (PARTITION BY symbol ORDER BY h)"""
)
def decision_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regimes.decision_hours(views.tape(spark, sf_dir)))


_SD = f"CASE WHEN count(r) OVER ({W} ROWS 19 PRECEDING) >= 20 THEN stddev_samp(r) OVER ({W} ROWS 19 PRECEDING) END"


@query(
    f"""{P}, x AS (SELECT asset, date, close / lag(close) OVER ({W}) - 1 r, (sign(close / lag(close, 20) OVER ({W}) - 1) + sign(close / lag(close, 60) OVER ({W}) - 1) + sign(close / lag(close, 120) OVER ({W}) - 1)) / 3.0 s FROM panel_bars), y AS (SELECT *, {_SD} sd FROM x)
    SELECT asset, date, {r('s * CASE WHEN sd IS NULL THEN 2.0 ELSE least(0.1 / (sd * sqrt(252.0)), 2.0) END', '"position"')} FROM y"""
)
def target_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regimes.target_positions(views.panel_bars(spark, sf_dir)))


CUT = "(SELECT (min(ts_ms) + max(ts_ms)) // 2 FROM hourly)"


@query(
    f"""{T}, {HOURLY}, x AS (SELECT *, abs(tick - lag(tick) OVER (PARTITION BY symbol ORDER BY ts_ms)) move FROM hourly), l AS (SELECT symbol, quantile_cont(lots, 0.95) a, quantile_cont(move, 0.95) b FROM x WHERE ts_ms < {CUT} GROUP BY 1),
    f AS (SELECT x.symbol, ts_ms, lots > a active, move > b event FROM x JOIN l USING (symbol) WHERE ts_ms >= {CUT}), n AS (SELECT *, min(CASE WHEN event THEN ts_ms END) OVER (PARTITION BY symbol ORDER BY ts_ms ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) nx FROM f)
    SELECT symbol, ts_ms, event, {r('(nx - ts_ms) / 3600000', 'lead_hours')} FROM n WHERE active"""
)
def early_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    ends = h.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    return rounded(flow.early_warning(h, (ends[0] + ends[1]) // 2))


@query(
    f"""{T}, {HOURLY}, b AS (SELECT * FROM (SELECT symbol, ts_ms, lots, abs(tick - lag(tick) OVER (PARTITION BY symbol ORDER BY ts_ms)) move FROM hourly) WHERE move IS NOT NULL),
    v AS (SELECT symbol, ts_ms, CASE WHEN ntile(5) OVER (PARTITION BY symbol ORDER BY lots, ts_ms) = 5 THEN 1.0::DOUBLE ELSE 0 END x, CASE WHEN ntile(5) OVER (PARTITION BY symbol ORDER BY move, ts_ms) = 5 THEN 1.0::DOUBLE ELSE 0 END m FROM b),
    xy AS (SELECT * FROM (SELECT symbol, ts_ms // {DAY} d, x, lead(m) OVER (PARTITION BY symbol ORDER BY ts_ms) y FROM v) WHERE y IS NOT NULL), f AS (SELECT symbol, regr_slope(y, x) b, regr_intercept(y, x) a, avg(x) mx, count(*) n, var_pop(x) vx FROM xy GROUP BY 1),
    s AS (SELECT xy.symbol, d, sum((x - mx) * (y - a - b * x)) s FROM xy JOIN f USING (symbol) GROUP BY 1, 2) SELECT symbol, {r('max(b)', 'slope')}, {r('sqrt(sum(s * s) * count(*) / (count(*) - 1)) / max(n * vx)', 'se')}, max(n) n FROM s JOIN f USING (symbol) GROUP BY 1"""
)
def cascade_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.cascades(hourly(spark, sf_dir)))


@query(
    f"""{T}, o AS (SELECT id, symbol, ts_ms, CASE WHEN is_buyer_maker THEN tick - 2 ELSE tick + 2 END tick, CASE WHEN is_buyer_maker THEN 1 ELSE -1 END side FROM tape)
    SELECT o.id, o.symbol, o.ts_ms, o.tick, o.side, min(t.ts_ms) FILTER ((t.tick - o.tick) * o.side <= 0) q0_ms, min(t.ts_ms) FILTER ((t.tick - o.tick) * o.side < 0) q1_ms FROM o LEFT JOIN tape t ON t.symbol = o.symbol AND t.ts_ms > o.ts_ms AND t.ts_ms <= o.ts_ms + {6 * HOUR} GROUP BY 1, 2, 3, 4, 5"""
)
def resting_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tape(spark, sf_dir)
    side = F.when(F.col("is_buyer_maker"), 1).otherwise(-1)
    o = t.select("id", "symbol", "ts_ms", (F.col("tick") - 2 * side).alias("tick"), side.alias("side"))
    return flow.queue_fills(o, t, 6 * HOUR)


@query(
    f"""WITH {views.BOOK_SQL}, {LEVELS}, t AS (SELECT moment, tick, least(size, greatest(500 - coalesce(sum(size) OVER (PARTITION BY moment ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) take FROM levels WHERE side = -1),
    s AS (SELECT moment, CASE WHEN sum(take) >= 500 - 1e-9 THEN sum(take * tick) / sum(take) END p FROM t GROUP BY 1), l AS (SELECT moment, p, lead(p) OVER (ORDER BY moment) m FROM s) SELECT moment, {r('p', 'price')}, {r('m', 'met')}, {r('m - p', 'slip')} FROM l"""
)
def latency_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.latency_walk(levels(spark, sf_dir), 500.0))


@query(
    f"""{T}, {ORDERS}, x AS (SELECT *, ts_ms // {DAY} AS "day", ts_ms - lag(ts_ms) OVER (PARTITION BY symbol, ts_ms // {DAY}, side, lots ORDER BY ts_ms, n) gap FROM orders), g AS (SELECT symbol, "day", side, lots, count(*) orders, avg(gap) gap_ms, stddev_pop(gap) sd FROM x GROUP BY 1, 2, 3, 4)
    SELECT symbol, "day", side, lots, orders, {r('gap_ms', 'gap_ms')} FROM g WHERE orders >= 3 AND sd < 0.8 * gap_ms"""
)
def repeated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.repeated_orders(tape.orders(views.tape(spark, sf_dir))))


_M = lambda n: f"CASE WHEN count(tick) OVER (w ROWS {n - 1} PRECEDING) >= {n} THEN avg(tick) OVER (w ROWS {n - 1} PRECEDING) END"


@query(
    f"""{T}, {HOURLY}, x AS (SELECT symbol, ts_ms, lots, sign(({_M(6)}) - ({_M(24)})) s FROM hourly WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)), y AS (SELECT symbol, (ts_ms // {HOUR}) % 24 h, lead(lots) OVER w nx, s <> lag(s) OVER w c FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)),
    q AS (SELECT symbol, h, avg(nx) b FROM y WHERE nx IS NOT NULL AND NOT c GROUP BY 1, 2) SELECT y.symbol, {r('avg(nx - b)', 'excess')}, count(*) n FROM y JOIN q ON y.symbol = q.symbol AND y.h = q.h WHERE nx IS NOT NULL AND c GROUP BY 1"""
)
def crossing_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.crossing_flow(hourly(spark, sf_dir)))


@query()
def hawkes_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.branching(views.tape(spark, sf_dir)))


@query()
def stream_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kernels.stream_factory(views.panel_bars(spark, sf_dir)))


@query()
def account_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-contract accounts and a grid on hourly prices, one column a variant; hand cases are in the tests."""
    h = hourly(spark, sf_dir).select(F.col("symbol").alias("asset"), F.col("ts_ms").alias("date"), (F.col("tick") / 10.0).alias("p"))
    sign = lambda d: np.sign(np.diff(d["p"].to_numpy(), prepend=d["p"].iloc[0]))
    zero = lambda d: np.zeros(len(d))
    return rounded(kernels.per_asset(h, {"plain": lambda d: kernels.inverse_account(d["p"].to_numpy(), sign(d), zero(d)), "patient": lambda d: kernels.inverse_account(d["p"].to_numpy(), sign(d), zero(d), buffer=0.5), "grid": lambda d: kernels.grid_result(d["p"].to_numpy(), 0.002, 5)}))

