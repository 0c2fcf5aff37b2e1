"""Queries of order flow and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions import normal
from tidewright.functions.windows import r6_sql, rounded
from tidewright.operators import flow, tape
from tidewright.plans.joins import HOURLY, hourly
from tidewright.plans.tape import ORDERS
from tidewright.registry import query

P, T = f"WITH {views.PANEL_SQL}", f"WITH {views.TAPE_SQL}"
W = "PARTITION BY asset ORDER BY date"
HOUR, DAY = 3_600_000, 86_400_000
SIDE = "CASE WHEN is_buyer_maker THEN -1 ELSE 1 END"
STEPS = [600_000, HOUR]


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


_SD = f"CASE WHEN count(r) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 20 THEN stddev_samp(r) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END"


@query(
    f"""{P}, a AS (SELECT asset, date, volume, close / lag(close) OVER ({W}) - 1 r, coalesce(sign(close - lag(close) OVER ({W})), 0) * volume sv FROM panel_bars), b AS (SELECT *, r / nullif({_SD}, 0) z FROM a)
    SELECT asset, date, {r(f'sum(sv) OVER ({W})', 'obv')}, {r(f'sum(sv) OVER ({W} ROWS 26 PRECEDING) / sum(volume) OVER ({W} ROWS 26 PRECEDING)', 'imbalance')}, {r(f'CASE WHEN z IS NOT NULL THEN (2 * ({normal.cdf_sql("z")}) - 1) * volume END', 'bvc')} FROM b"""
)
def volume_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.volume_signals(views.panel_bars(spark, sf_dir)))


MIDS = """q_ AS (SELECT symbol, ts_ms, id, last_value(CASE WHEN NOT is_buyer_maker THEN tick END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ms, id) ask, last_value(CASE WHEN is_buyer_maker THEN tick END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ms, id) bid FROM tape),
    mids AS (SELECT symbol, ts_ms, max_by((ask + bid) / 2, id) mid FROM q_ WHERE ask IS NOT NULL AND bid IS NOT NULL GROUP BY 1, 2)"""
LATER = "".join(f" ASOF LEFT JOIN mids q{i} ON b.symbol = q{i}.symbol AND b.ts_ms + {s} >= q{i}.ts_ms" for i, s in enumerate(STEPS))


@query(
    f"""{T}, {MIDS}, b AS (SELECT t.id, t.symbol, t.ts_ms, t.tick, {SIDE} side, m.mid AS before FROM tape t ASOF JOIN mids m ON t.symbol = m.symbol AND t.ts_ms > m.ts_ms), l AS (SELECT b.*, {', '.join(f'q{i}.mid m{i}' for i in range(len(STEPS)))} FROM b {LATER})
    SELECT symbol, count(*) n, {r('1e4 * avg(side * (tick - before) / before)', 'effective')}, {', '.join(r(f'1e4 * avg(side * (tick - m{i}) / before)', f'realised_{s}') for i, s in enumerate(STEPS))} FROM l GROUP BY 1"""
)
def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.trade_costs(views.tape(spark, sf_dir), STEPS))


@query(
    f"""{T}, {MIDS}, b AS (SELECT *, {SIDE} side FROM tape), l AS (SELECT b.*, {', '.join(f'q{i}.mid m{i}' for i in range(len(STEPS)))} FROM b {LATER})
    SELECT CASE WHEN lots <= 5 THEN 'small' WHEN lots <= 20 THEN 'medium' ELSE 'large' END bucket, count(*) n, {', '.join(r(f'sum(lots * -side * (m{i} - tick)) / sum(lots) FILTER (m{i} IS NOT NULL)', f'markout_{s}') for i, s in enumerate(STEPS))} FROM l GROUP BY 1"""
)
def markouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.markouts(views.tape(spark, sf_dir), STEPS))


@query(
    f"""{T}, {ORDERS}, p AS (SELECT symbol, ts_ms, max_by(tick, id) price FROM tape GROUP BY 1, 2), b AS (SELECT o.*, p.price AS before FROM orders o ASOF JOIN p ON o.symbol = p.symbol AND o.ts_ms > p.ts_ms WHERE abs(o.last_tick - p.price) >= 8)
    SELECT b.*, {', '.join(f'q{i}.price price_{s}' for i, s in enumerate(STEPS))} FROM b {LATER.replace('mids', 'p')}"""
)
def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tape(spark, sf_dir)
    return flow.sweeps(tape.orders(t), t, 8, STEPS)


@query(
    f"""{T}, t AS (SELECT *, ts_ms // {2 * HOUR} slot FROM tape), s AS (SELECT symbol, slot, min_by(tick, (ts_ms, id)) price, min((ts_ms, id)) s FROM t GROUP BY 1, 2),
    a AS (SELECT t.symbol, t.slot, min(ts_ms) FILTER (tick < price) bf, min(ts_ms) FILTER (tick > price) af, max_by(tick, (ts_ms, id)) e FROM t JOIN s ON t.symbol = s.symbol AND t.slot = s.slot WHERE (ts_ms, id) > s AND ts_ms <= s[1] + {HOUR} GROUP BY 1, 2)
    SELECT symbol, count(*) n, {r('avg(cast(bf IS NOT NULL AS INT))', 'bid_filled')}, {r('avg(cast(af IS NOT NULL AS INT))', 'ask_filled')}, {r('avg(CASE WHEN bf IS NULL THEN e - price END)', 'bid_missed')} FROM s LEFT JOIN a USING (symbol, slot) GROUP BY 1"""
)
def resting_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.resting(views.tape(spark, sf_dir), 120, HOUR))


_ROOT = "sign(q) * sqrt(abs(q))"


@query(
    f"""{T}, b AS (SELECT symbol, ts_ms // {6 * HOUR} b, cast(sum({SIDE} * lots) AS DOUBLE) q, cast(max_by(tick, (ts_ms, id)) - min_by(tick, (ts_ms, id)) AS DOUBLE) dp FROM tape GROUP BY 1, 2)
    SELECT symbol, count(*) n, {r('regr_slope(dp, q)', 'lam')}, {r('sum(q * dp) / sum(q * q)', 'lam0')}, {r(f'sum({_ROOT} * dp) / sum({_ROOT} * {_ROOT})', 'root')}, {r('regr_r2(dp, q)', 'r2')} FROM b GROUP BY 1"""
)
def kyle_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.kyle(views.tape(spark, sf_dir), 6 * HOUR))


@query(
    f"""{T}, a AS (SELECT symbol, ts_ms, lots, {SIDE} side, cast(sum(lots) OVER (PARTITION BY symbol ORDER BY ts_ms, id) AS BIGINT) upto FROM tape), s AS (SELECT *, unnest(range((upto - lots) // 500, (upto - 1) // 500 + 1)) bucket FROM a),
    p AS (SELECT symbol, bucket, side, ts_ms, least(upto, (bucket + 1) * 500) - greatest(upto - lots, bucket * 500) part FROM s), b AS (SELECT symbol, bucket, max(ts_ms) end_ms, sum(part) v, abs(sum(side * part)) net FROM p GROUP BY 1, 2 HAVING sum(part) = 500)
    SELECT symbol, bucket, end_ms, {r('CASE WHEN count(*) OVER w >= 20 THEN sum(net) OVER w / (20 * 500.0) END', 'vpin')} FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS 19 PRECEDING)"""
)
def vpin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.vpin(views.tape(spark, sf_dir), 500, 20))


@query(
    f"{T}, s AS (SELECT symbol, ts_ms, id, tick, {SIDE} s FROM tape), e AS ("
    + " UNION ALL ".join(f"SELECT symbol, {k} lag, s, tick, lead(s, {k}) OVER (PARTITION BY symbol ORDER BY ts_ms, id) s2, lead(tick, {k}) OVER (PARTITION BY symbol ORDER BY ts_ms, id) p2 FROM s" for k in (1, 5, 20))
    + f") SELECT symbol, lag, {r('avg(s * s2)', 'c')}, {r('avg(s * (p2 - tick))', 'r')}, count(*) n FROM e WHERE p2 IS NOT NULL GROUP BY 1, 2"
)
def response_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.response(views.tape(spark, sf_dir), [1, 5, 20]))


_CH = lambda t, c: f"{t}1 AS (SELECT symbol, ts_ms, max_by(tick, id) p FROM {c} GROUP BY 1, 2), {t}2 AS (SELECT symbol, lag(ts_ms) OVER w s, ts_ms e, p - lag(p) OVER w d FROM {t}1 WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)), {t} AS (SELECT * FROM {t}2 WHERE s IS NOT NULL AND d <> 0)"


@query(
    f"""{T}, late AS (SELECT id, symbol, ts_ms + 40000 ts_ms, tick FROM tape), {_CH('x', 'tape')}, {_CH('y', 'late')}, n AS (SELECT x.symbol, any_value(xx) xx, any_value(yy) yy FROM (SELECT symbol, sum(d * d) xx FROM x GROUP BY 1) x JOIN (SELECT symbol, sum(d * d) yy FROM y GROUP BY 1) y USING (symbol) GROUP BY 1),
    p AS (SELECT x.symbol, l AS lag, sum(x.d * y.d) xy FROM x, y, (VALUES (0), (40000), (80000)) t(l) WHERE x.symbol = y.symbol AND x.s < y.e - l AND y.s - l < x.e GROUP BY 1, 2) SELECT symbol, lag, {r('xy / sqrt(cast(xx AS DOUBLE) * yy)', 'rho')} FROM p JOIN n USING (symbol)"""
)
def lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tape(spark, sf_dir).select("id", "symbol", "ts_ms", "tick")
    return rounded(flow.lead_lag(t, t.withColumn("ts_ms", F.col("ts_ms") + 40_000), [0, 40_000, 80_000]))


@query(
    f"""{T}, {HOURLY}, a AS (SELECT symbol, ts_ms, lots, tick - lag(tick) OVER (PARTITION BY symbol ORDER BY ts_ms) d FROM hourly), k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY lots) + (count(*) OVER (PARTITION BY symbol, lots) - 1) / 2.0 rx, rank() OVER (PARTITION BY symbol ORDER BY d) + (count(*) OVER (PARTITION BY symbol, d) - 1) / 2.0 ry FROM a WHERE d IS NOT NULL)
    SELECT symbol, {r('corr(rx, ry)', 'rho')}, count(*) n FROM k GROUP BY 1"""
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    h = hourly(spark, sf_dir)
    return rounded(flow.spearman(h.withColumn("d", F.col("tick") - F.lag("tick").over(Window.partitionBy("symbol").orderBy("ts_ms"))), ["symbol"], "lots", "d"))


@query(
    f"""{T}, b AS (SELECT symbol, ts_ms // {HOUR} b, cast(sum({SIDE} * lots) AS BIGINT) q, min_by(tick, (ts_ms, id)) o, max_by(tick, (ts_ms, id)) c FROM tape GROUP BY 1, 2), j AS (SELECT x.symbol, x.b * {HOUR} // {DAY} d, x.c - x.o move, y.c - y.o nxt, ntile(5) OVER (PARTITION BY x.symbol ORDER BY x.q, x.b) fifth FROM b x JOIN b y ON x.symbol = y.symbol AND y.b = x.b + 1),
    m AS (SELECT symbol, fifth, avg(move) move, avg(nxt) mean, count(*) n FROM j GROUP BY 1, 2), e AS (SELECT j.symbol, j.fifth, d, sum(nxt) - count(*) * any_value(mean) e FROM j JOIN m USING (symbol, fifth) GROUP BY 1, 2, 3)
    SELECT symbol, fifth, {r('any_value(move)', 'move')}, {r('any_value(mean)', 'mean')}, any_value(n) n, {r('sqrt(sum(e * e) * count(*) / (count(*) - 1)) / any_value(n)', 'se')} FROM e JOIN m USING (symbol, fifth) GROUP BY 1, 2"""
)
def flow_fifths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.flow_fifths(views.tape(spark, sf_dir), HOUR))


@query(
    f"""{T}, {ORDERS}, x AS (SELECT *, ts_ms // {HOUR} AS "hour", lag(lots) OVER w = lots AND lag(side) OVER w = side sl FROM orders WINDOW w AS (PARTITION BY symbol, ts_ms // {HOUR} ORDER BY ts_ms, n)),
    p AS (SELECT symbol, "hour", CASE WHEN coalesce(sl, false) THEN 'sliced' WHEN lots >= 40 THEN 'large' ELSE 'other' END style, sum(lots) lots FROM x GROUP BY 1, 2, 3) SELECT symbol, "hour", style, {r('lots / sum(lots) OVER (PARTITION BY symbol, "hour")', '"share"')} FROM p"""
)
def style_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.styles(tape.orders(views.tape(spark, sf_dir))))


_AVG = f"CASE WHEN count(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 20 THEN avg(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END"


@query(
    f"""{P}, a AS (SELECT asset, date, volume, close / lag(close) OVER ({W}) - 1 r FROM panel_bars), b AS (SELECT asset, date, volume / nullif({_AVG}, 0) x, abs(r) / nullif({_SD}, 0) y FROM a), c AS (SELECT x, y, ntile(10) OVER (PARTITION BY asset ORDER BY x, date) bin FROM b WHERE x > 0 AND y > 0),
    d AS (SELECT bin, avg(x) x, avg(y) y, count(*) n FROM c GROUP BY 1) SELECT bin, {r('x', 'x')}, {r('y', 'y')}, n, {r('(SELECT regr_slope(ln(y), ln(x)) FROM d)', 'slope')} FROM d"""
)
def impact_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.capacity(views.panel_bars(spark, sf_dir)))


@query(f"{T}, {HOURLY}, h AS (SELECT * FROM hourly WHERE (ts_ms // {HOUR}) % 24 = 14) SELECT symbol, ts_ms, cast(lots AS BIGINT) lots, {r('count(*) OVER (PARTITION BY symbol ORDER BY lots DESC RANGE UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY symbol)', 'p')} FROM h")
def window_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flow.window_pvalue(hourly(spark, sf_dir), 14))
