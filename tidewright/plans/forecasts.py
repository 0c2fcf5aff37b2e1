"""Queries of forecasts, visits, slippage and scaled returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import r6_sql, rounded
from tidewright.operators import forecast, kernels, tape
from tidewright.plans.joins import HOURLY, hourly
from tidewright.plans.positions import DAILY, daily
from tidewright.plans.tape import _clock
from tidewright.registry import query
from tidewright.session import table

P, T = f"WITH {views.PANEL_SQL}", f"WITH {views.TAPE_SQL}"
HOUR, DAY = 3_600_000, 86_400_000


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


_M = lambda n: f"CASE WHEN count(x) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {n} THEN avg(x) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
HAR = f"""a_ AS (SELECT symbol, ts_ms // {HOUR} h, cast(lots AS DOUBLE) x FROM hourly), har AS (SELECT symbol, h, x y, lag(x) OVER w last, {_M(24)} "day", {_M(168)} AS "week" FROM a_ WINDOW w AS (PARTITION BY symbol ORDER BY h))"""


def _har(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir).select("symbol", F.expr(f"ts_ms div {HOUR}").alias("h"), F.col("lots").cast("double").alias("x"))
    return forecast.har_frame(h)


@query(f"{T}, {HOURLY}, {HAR} SELECT symbol, h, y, {r('last', 'last')}, {r('\"day\"', '\"day\"')}, {r('"week"', '"week"')} FROM har")
def har_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_har(spark, sf_dir))


@query()
def har_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QLIKE of the fitted forecast against the last value's, and the test of their difference by day. Tests hold the fit against numpy."""
    x = _har(spark, sf_dir).where("week IS NOT NULL AND last > 0 AND y > 0")
    f = forecast.predict(x, forecast.least_squares(x, "y", ["last", "day", "week"]))
    lost = f.select(F.expr("h div 24").alias("d"), forecast.qlike(F.col("y"), F.col("forecast")).alias("a"), forecast.qlike(F.col("y"), F.col("last")).alias("b"))
    return rounded(forecast.diebold_mariano(lost, "a", "b", "d"))


@query(
    f"""{T}, t AS (SELECT *, ts_ms // {DAY} AS "day" FROM tape), m AS (SELECT symbol, "day", ts_ms, id, tick, lag(tick) OVER (PARTITION BY symbol, "day" ORDER BY ts_ms, id) b FROM t), c AS (SELECT symbol, "day", ts_ms, id, tick, b, tick > b up, unnest(range(cast(ceil(least(tick, b) / 50.0) AS BIGINT), cast(floor(greatest(tick, b) / 50.0) AS BIGINT) + 1)) k FROM m WHERE b IS NOT NULL),
    f AS (SELECT symbol, "day", k * 50 AS "level", ts_ms, up FROM c WHERE k * 50 > least(tick, b) OR k * 50 = tick QUALIFY row_number() OVER (PARTITION BY symbol, "day", k ORDER BY ts_ms, id) = 1)
    SELECT f.symbol, f."day", f."level", f.ts_ms, f.up, max(CASE WHEN f.up THEN t.tick - f."level" ELSE f."level" - t.tick END) beyond, count(*) trades FROM f JOIN t ON t.symbol = f.symbol AND t."day" = f."day" AND t.ts_ms >= f.ts_ms AND t.ts_ms <= f.ts_ms + {HOUR} GROUP BY ALL"""
)
def level_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.level_visits(views.tape(spark, sf_dir))


@query()
def duration_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = kernels.per_symbol_day(views.tape(spark, sf_dir), {"range_bar": lambda d: kernels.range_bars(d["tick"].to_numpy(float), 0.003)})
    return b.groupBy("symbol", "day").agg(F.countDistinct("range_bar").alias("n")).join(forecast.duration_variance(b, 0.003), ["symbol", "day"])


@query(
    f"""{T}, {HOURLY}, d AS (SELECT symbol, ts_ms, tick price FROM hourly), f AS (SELECT id, symbol, ts_ms, tick, CASE WHEN is_buyer_maker THEN -1 ELSE 1 END side FROM tape), j AS (SELECT f.*, d.ts_ms m, d.price FROM f ASOF JOIN d ON f.symbol = d.symbol AND f.ts_ms > d.ts_ms)
    SELECT symbol, side, {r('avg(1e4 * side * (tick - price) / price)', 'bp')}, {r('avg(ts_ms - m)', 'delay_ms')}, count(*) n FROM j GROUP BY 1, 2"""
)
def decision_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.tape(spark, sf_dir).select("id", "symbol", "ts_ms", "tick", F.when(F.col("is_buyer_maker"), -1).otherwise(1).alias("side"))
    return rounded(forecast.slippage(f, hourly(spark, sf_dir).select("symbol", "ts_ms", F.col("tick").alias("price"))))


_SD = lambda f: f"CASE WHEN count(net) OVER {f} >= 20 THEN stddev_samp(net) OVER {f} * sqrt(252.0) END"


@query(
    f"""{P}, {DAILY}, s AS (SELECT date, net, {_SD('(ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)')} sd, {_SD('(ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')} lg FROM daily), l AS (SELECT *, CASE WHEN sd IS NOT NULL THEN least(0.1 / nullif(sd, 0), 3 * 0.1 / nullif(lg, 0)) END lv FROM s)
    SELECT date, {r('lv', 'leverage')}, {r('lv * net', 'r')} FROM l"""
)
def vol_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecast.vol_target(daily(spark, sf_dir)))


@query(
    f"""{_clock('tick * lots', 20_000_000).replace(' SELECT symbol, cast(bar', ', c AS (SELECT symbol, cast(bar')}), e AS (SELECT *, start_ms // {DAY} d, exp((start_ms - start_ms // {DAY} * {DAY}) / {6.0 * HOUR}) e FROM c)
    SELECT symbol, bar, start_ms, {r('sum("close" * e) OVER w / sum(e) OVER w', 'average')} FROM e WINDOW w AS (PARTITION BY symbol, d ORDER BY start_ms, bar ROWS UNBOUNDED PRECEDING)"""
)
def dollar_bar_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tape.clock_bars(views.tape(spark, sf_dir), F.col("tick") * F.col("lots"), 20_000_000)
    return rounded(forecast.irregular_average(b, 6.0 * HOUR))


@query(
    "SELECT event_type, count(*) FILTER (user_id % 3 = 0) a, count(*) FILTER (user_id % 3 = 1) b, count(*) FILTER (user_id % 3 = 2) c FROM events GROUP BY 1"
)
def audit_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of one category by another; an unknown category would fail the assertion in the plan."""
    e = table(spark, sf_dir, "events").select("event_type", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("user_id") % 3 + 1).cast("int")).alias("by"))
    known = e.where(F.assert_true(F.col("event_type").isin("click", "error", "purchase", "signup", "view")).isNull())
    return known.groupBy("event_type").pivot("by", ["a", "b", "c"]).count().fillna(0)


@query(
    f"""{T}, m AS (SELECT symbol, lots, tick - 20000 AS m FROM tape), b AS (SELECT symbol, avg(m) c FROM m GROUP BY 1), k AS (SELECT symbol, lots, avg(abs(m - c)) m, count(*) n FROM m JOIN b USING (symbol) GROUP BY 1, 2 HAVING avg(abs(m - c)) > 0)
    SELECT symbol, {r('regr_slope(ln(m), ln(lots))', 'exponent')}, {r('exp(regr_intercept(ln(m), ln(lots)))', 'scale')}, cast(sum(n) AS BIGINT) n FROM k GROUP BY 1"""
)
def impact_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponent of the response to order size, by symbol."""
    moves = views.tape(spark, sf_dir).select("symbol", "lots", (F.col("tick") - 20000).cast("double").alias("m"))
    return rounded(forecast.response_curve(moves, "lots", "m", ["symbol"]))


@query()
def impact_propagator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel values of the propagator by symbol and lag, from the response functions. Tests hold them against numpy over the whole tape."""
    from tidewright.operators import flow

    return rounded(forecast.propagators(flow.response(views.tape(spark, sf_dir), list(range(1, 9)))))
