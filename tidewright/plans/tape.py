"""Queries of tape quality, clock bars and realised measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import r6_sql, rounded
from tidewright.operators import tape
from tidewright.registry import query

T = f"WITH {views.TAPE_SQL}"
HOUR, DAY = 3_600_000, 86_400_000


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


@query(
    f"""{T}, s AS (SELECT *, id - lag(id) OVER w g, ts_ms < lag(ts_ms) OVER w b FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY id))
    SELECT symbol, count(*) AS "rows", min(id) first_id, max(id) last_id, min(ts_ms) first_ms, max(ts_ms) last_ms, count(*) FILTER (g > 1) jumps, count(*) FILTER (g < 1) repeats, count(*) FILTER (b) backwards FROM s GROUP BY 1"""
)
def tape_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.integrity(views.tape(spark, sf_dir))


SEQ = f"{T}, seq AS (SELECT symbol, ts_ms, tick, lots, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms, id) seq FROM tape), raw AS (SELECT * FROM seq WHERE seq % 97 NOT IN (0, 1, 2)), \
patches AS (SELECT * FROM seq WHERE seq % 97 = 0 OR seq % 970 = 1 OR seq % 970 = 2)"
HOLES = "h_ AS (SELECT symbol, seq, ts_ms, lag(seq) OVER w f, lag(ts_ms) OVER w m FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY seq)), holes AS (SELECT symbol, f from_id, seq to_id, seq - f - 1 n, m from_ms, ts_ms to_ms FROM h_ WHERE seq - f > 1)"


def _seq(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A dense sequence by symbol, the same with holes, and patches for some of the holes."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts_ms", "id")).cast("long")
    seq = views.tape(spark, sf_dir).select("symbol", "ts_ms", "tick", "lots", n.alias("seq"))
    return seq, seq.where("seq % 97 NOT IN (0, 1, 2)"), seq.where("seq % 97 = 0 OR seq % 970 = 1 OR seq % 970 = 2")


@query(f"{SEQ}, {HOLES} SELECT * FROM holes")
def tape_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.holes(_seq(spark, sf_dir)[1])


@query(
    f"""{SEQ}, {HOLES}, d AS (SELECT symbol, from_id, from_ms, to_ms, unnest(range(from_ms // {DAY}, to_ms // {DAY} + 1)) "day" FROM holes),
    o AS (SELECT symbol, from_id, "day", least(to_ms, ("day" + 1) * {DAY}) - greatest(from_ms, "day" * {DAY}) overlap_ms FROM d) SELECT * FROM o WHERE overlap_ms >= 60000"""
)
def hole_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.hole_days(tape.holes(_seq(spark, sf_dir)[1]), 60_000)


@query(
    f"""{SEQ}, {HOLES}, p AS (SELECT h.*, (SELECT count(*) FROM patches p WHERE p.symbol = h.symbol AND p.seq > h.from_id AND p.seq < h.to_id) patched FROM holes h)
    SELECT *, CASE WHEN patched >= n THEN 'filled' WHEN patched > 0 THEN 'partly filled' ELSE 'not in the archive' END status FROM p"""
)
def patch_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, raw, patches = _seq(spark, sf_dir)
    return tape.patch_accounting(tape.holes(raw), patches)


@query(f"{SEQ} SELECT DISTINCT symbol, seq, ts_ms, tick, lots FROM (SELECT * FROM raw UNION ALL SELECT * FROM patches UNION ALL SELECT * FROM raw WHERE seq % 101 = 0)")
def cleaned_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, raw, patches = _seq(spark, sf_dir)
    return tape.cleaned(raw.unionByName(raw.where("seq % 101 = 0")), patches)


@query(f"{T}, d AS (SELECT DISTINCT symbol, ts_ms // {DAY} \"day\", tick FROM tape), s AS (SELECT symbol, \"day\", tick - lag(tick) OVER (PARTITION BY symbol, \"day\" ORDER BY tick) step FROM d) SELECT symbol, \"day\", min(step) step, 10.0::DOUBLE ** floor(log10(min(step)) + 0.5) regime FROM s WHERE step > 0 GROUP BY 1, 2")
def tick_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.tick_size(views.tape(spark, sf_dir))


@query(f"{T}, s AS (SELECT symbol, ts_ms // {DAY} \"day\", id, lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms, id) from_ms, ts_ms FROM tape) SELECT *, row_number() OVER (PARTITION BY symbol, \"day\" ORDER BY ts_ms, id) n FROM s WHERE ts_ms - from_ms > {HOUR}")
def silence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.silence_flags(views.tape(spark, sf_dir))


@query(
    f"""{T}, b AS (SELECT symbol, id, ts_ms, tick::DOUBLE p, quantile_cont(tick::DOUBLE, 0.5) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) m0, stddev_samp(tick) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) sd,
      quantile_cont(tick::DOUBLE, 0.5) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) m1, count(*) OVER (w ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) n FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, id))
    SELECT symbol, id, ts_ms, {r('p - m0', 'jump')}, CASE WHEN abs(m1 - m0) <= 0.2 * abs(p - m0) THEN 'spike' ELSE 'jump' END kind FROM b WHERE n >= 50 AND abs(p - m0) >= greatest(0.001 * m0, 2 * sd)"""
)
def spike_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tape.spikes(views.tape(spark, sf_dir), least=0.001, sds=2.0))


COUNTS = f"c AS (SELECT symbol, ts_ms // {DAY} \"day\", ts_ms // {HOUR} * {HOUR} start_ms, count(*) trades FROM tape GROUP BY 1, 2, 3), m AS (SELECT symbol, \"day\", quantile_cont(trades, 0.5) median FROM c GROUP BY 1, 2)"


@query(f"{T}, {COUNTS} SELECT symbol, \"day\", start_ms, trades, median FROM c JOIN m USING (symbol, \"day\") WHERE trades > 2 * median")
def activity_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.bursts(views.tape(spark, sf_dir), times=2.0)


@query(
    f"""{SEQ}, {HOLES}, {COUNTS}, q AS (SELECT symbol, count(*) "rows" FROM raw GROUP BY 1), h AS (SELECT symbol, count(*) n_holes, sum(n) missing FROM holes GROUP BY 1), b AS (SELECT symbol, count(*) n_bursts, count(DISTINCT "day") burst_days FROM c JOIN m USING (symbol, "day") WHERE trades > 2 * median GROUP BY 1)
    SELECT symbol, "rows", cast(coalesce(n_holes, 0) AS BIGINT) n_holes, cast(coalesce(missing, 0) AS BIGINT) missing, {r('"rows" / ("rows" + coalesce(missing, 0))', 'complete')}, coalesce(n_bursts, 0) n_bursts, coalesce(burst_days, 0) burst_days FROM q LEFT JOIN h USING (symbol) LEFT JOIN b USING (symbol)"""
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _seq(spark, sf_dir)[1]
    h = tape.holes(raw).groupBy("symbol").agg(F.count("*").alias("n_holes"), F.sum("n").alias("missing"))
    b = tape.bursts(views.tape(spark, sf_dir), times=2.0).groupBy("symbol").agg(F.count("*").alias("n_bursts"), F.countDistinct("day").alias("burst_days"))
    out = raw.groupBy("symbol").agg(F.count("*").alias("rows")).join(h, "symbol", "left").join(b, "symbol", "left").fillna(0, ["n_holes", "missing", "n_bursts", "burst_days"])
    return rounded(out.withColumn("complete", F.col("rows") / (F.col("rows") + F.col("missing"))))


BAR = "min(ts_ms) start_ms, max(ts_ms) end_ms, min_by(tick, (ts_ms, id)) open, max(tick) high, min(tick) low, max_by(tick, (ts_ms, id)) \"close\", cast(sum(lots) AS BIGINT) lots, cast(sum(tick * lots) AS BIGINT) usd, cast(sum(CASE WHEN is_buyer_maker THEN -tick * lots ELSE tick * lots END) AS BIGINT) signed_usd, count(*) trades"


@query(f"{T} SELECT symbol, ts_ms // {HOUR} * {HOUR} bar, {BAR} FROM tape GROUP BY 1, 2")
def time_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.time_bars(views.tape(spark, sf_dir), HOUR)


def _clock(size: str, n: int) -> str:
    return f"{T}, b AS (SELECT *, (sum({size}) OVER (PARTITION BY symbol ORDER BY ts_ms, id) - {size}) // {n} bar FROM tape) SELECT symbol, cast(bar AS BIGINT) bar, {BAR} FROM b GROUP BY 1, 2"


@query(_clock("1", 50))
def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.clock_bars(views.tape(spark, sf_dir), F.lit(1), 50)


@query(_clock("lots", 1000))
def volume_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.clock_bars(views.tape(spark, sf_dir), F.col("lots"), 1000)


@query(_clock("tick * lots", 20_000_000))
def dollar_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.clock_bars(views.tape(spark, sf_dir), F.col("tick") * F.col("lots"), 20_000_000)


SECONDS = [600, 3600, 14400]
RV = f"""e AS (SELECT symbol, ts_ms, id, ln(tick) p, s FROM tape, (VALUES {', '.join(f'({s})' for s in SECONDS)}) t(s)), l AS (SELECT symbol, s, ts_ms // (s * 1000) b, max_by(p, (ts_ms, id)) p FROM e GROUP BY 1, 2, 3),
    rr AS (SELECT symbol, s, b * s * 1000 // {DAY} "day", b, p - lag(p) OVER (PARTITION BY symbol, s ORDER BY b) r FROM l), b2 AS (SELECT *, abs(lag(r) OVER (PARTITION BY symbol, s ORDER BY b)) r1 FROM rr),
    rv AS (SELECT symbol, s, "day", sum(r * r) rv, sum(abs(r) * r1) * 1.5707963267948966 bv, count(*) n FROM b2 WHERE r IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"{T}, {RV} SELECT symbol, s, \"day\", {r('rv', 'rv')}, {r('bv', 'bipower')}, {r('greatest(1 - bv / nullif(rv, 0), 0)', 'jump_share')}, n FROM rv")
def realised_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tape.realised(views.tape(spark, sf_dir), SECONDS))


@query(f"{T}, {RV}, a AS (SELECT symbol, s, avg(rv) rv FROM rv GROUP BY 1, 2) SELECT a.symbol, a.s, {r('a.rv / b.rv', 'ratio')} FROM a JOIN a b ON a.symbol = b.symbol AND b.s = {SECONDS[0]}")
def variance_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tape.variance_ratio(tape.realised(views.tape(spark, sf_dir), SECONDS), SECONDS[0]))


@query(f"{T}, b AS (SELECT symbol, ts_ms // {HOUR} bar, max(tick) hi, min(tick) lo FROM tape GROUP BY 1, 2) SELECT symbol, bar * {HOUR} // {DAY} \"day\", {r('sum(ln(hi / lo) ** 2) / 2.772588722239781', 'range_variance')}, count(*) bars FROM b GROUP BY 1, 2")
def range_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tape.range_variance(tape.time_bars(views.tape(spark, sf_dir), HOUR)))


@query(
    f"""{T}, a AS (SELECT *, ts_ms // {DAY} "day" FROM tape), b AS (SELECT *, abs(tick - lag(tick) OVER (PARTITION BY symbol, "day" ORDER BY ts_ms, id)) moved, row_number() OVER (PARTITION BY symbol, "day" ORDER BY ts_ms, id) k FROM a),
    c AS (SELECT *, max(tick) OVER (PARTITION BY symbol, "day") hi, min(tick) OVER (PARTITION BY symbol, "day") lo FROM b) SELECT symbol, "day", min(k) FILTER (tick = hi) < min(k) FILTER (tick = lo) high_first, {r('sum(moved) / nullif(max(hi) - min(lo), 0)', '"path"')} FROM c GROUP BY 1, 2"""
)
def high_low_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tape.paths(views.tape(spark, sf_dir)))


@query(f"{T}, q AS (SELECT symbol, ts_ms // {HOUR} * {HOUR} start_ms, max_by(tick, (ts_ms, id)) FILTER (NOT is_buyer_maker) ask, max_by(tick, (ts_ms, id)) FILTER (is_buyer_maker) bid FROM tape GROUP BY 1, 2) SELECT symbol, start_ms, (ask + bid) / 2 mid, ask - bid spread FROM q WHERE ask >= bid")
def aggressor_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.spreads(views.tape(spark, sf_dir))


ORDERS = """o1 AS (SELECT *, coalesce(cast(ts_ms <> lag(ts_ms) OVER w OR is_buyer_maker <> lag(is_buyer_maker) OVER w AS INT), 1) nw FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, id)), o2 AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, ts_ms ORDER BY id) n FROM o1),
    orders AS (SELECT symbol, ts_ms, cast(n AS BIGINT) n, min(id) id, CASE WHEN min_by(is_buyer_maker, id) THEN -1 ELSE 1 END side, cast(sum(lots) AS BIGINT) lots, count(*) fills, min_by(tick, id) first_tick, max_by(tick, id) last_tick FROM o2 GROUP BY symbol, ts_ms, n)"""


@query(f"{T}, {ORDERS} SELECT * FROM orders")
def taker_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.orders(views.tape(spark, sf_dir))


@query(f"{T} SELECT symbol, tick // 50 * 50 AS \"level\", cast(sum(tick * lots) AS BIGINT) usd, cast(sum(CASE WHEN is_buyer_maker THEN -tick * lots ELSE tick * lots END) AS BIGINT) net FROM tape GROUP BY 1, 2")
def volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape.volume_profile(views.tape(spark, sf_dir))


@query(
    f"""{T}, h AS (SELECT symbol, ts_ms // {HOUR} h, count(*) n FROM tape GROUP BY 1, 2), e AS (SELECT symbol, h - k h, k, n FROM h, (VALUES (-1), (0), (1)) t(k)), a AS (SELECT * FROM e WHERE h % 24 IN (8, 14)),
    p AS (SELECT symbol, h, coalesce(max(n) FILTER (k = -1), 0) b, coalesce(max(n) FILTER (k = 0), 0) i, coalesce(max(n) FILTER (k = 1), 0) a FROM a GROUP BY 1, 2)
    SELECT symbol, h % 24 AS "hour", {r('avg(b)', 'before')}, {r('avg(i)', 'inside')}, {r('avg(a)', 'after')}, count(*) "days" FROM p GROUP BY 1, 2"""
)
def slot_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tape.slot_tests(views.tape(spark, sf_dir), [8, 14]))
