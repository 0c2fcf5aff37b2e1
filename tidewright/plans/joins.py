"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import r6_sql, rounded
from tidewright.operators import asof, ranges
from tidewright.registry import query
from tidewright.session import table

T = f"WITH {views.TAPE_SQL}"
B = f"WITH {views.TAPE_SQL}, {views.BOOK_SQL}"
HOUR = 3_600_000


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of one aggressor as quotes of the same symbol: (symbol, ts_ms, quote), one row a time."""
    t = views.tape(spark, sf_dir).where("is_buyer_maker")
    return t.groupBy("symbol", "ts_ms").agg(F.max("tick").alias("quote"))


QUOTES = "quotes AS (SELECT symbol, ts_ms, max(tick) quote FROM tape WHERE is_buyer_maker GROUP BY 1, 2)"


@query(f"{T}, {QUOTES}, b AS (SELECT * FROM tape WHERE NOT is_buyer_maker) SELECT b.id, b.symbol, b.ts_ms, b.tick, q.ts_ms ts_ms_matched, q.quote FROM b ASOF LEFT JOIN quotes q ON b.symbol = q.symbol AND b.ts_ms >= q.ts_ms")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.tape(spark, sf_dir).where("NOT is_buyer_maker").select("id", "symbol", "ts_ms", "tick")
    return asof.asof(b, _quotes(spark, sf_dir), "symbol", "ts_ms", ["quote"])


@query(
    f"""{T}, {QUOTES}, b AS (SELECT * FROM tape WHERE NOT is_buyer_maker), j AS (SELECT b.id, b.symbol, b.ts_ms, b.tick, q.ts_ms m, q.quote FROM b ASOF LEFT JOIN quotes q ON b.symbol = q.symbol AND b.ts_ms > q.ts_ms)
    SELECT id, symbol, ts_ms, tick, CASE WHEN ts_ms - m <= {HOUR} THEN m END ts_ms_matched, CASE WHEN ts_ms - m <= {HOUR} THEN quote END quote FROM j"""
)
def asof_strict_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.tape(spark, sf_dir).where("NOT is_buyer_maker").select("id", "symbol", "ts_ms", "tick")
    return asof.asof(b, _quotes(spark, sf_dir), "symbol", "ts_ms", ["quote"], strict=True, tolerance=HOUR)


@query(f"{T}, {QUOTES}, b AS (SELECT * FROM tape WHERE NOT is_buyer_maker) SELECT b.id, b.symbol, b.ts_ms, b.tick, q.ts_ms ts_ms_matched, q.quote FROM b ASOF LEFT JOIN quotes q ON b.symbol = q.symbol AND b.ts_ms < q.ts_ms")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.tape(spark, sf_dir).where("NOT is_buyer_maker").select("id", "symbol", "ts_ms", "tick")
    return asof.asof(b, _quotes(spark, sf_dir), "symbol", "ts_ms", ["quote"], strict=True, forward=True)


STEPS = [60_000, HOUR, 6 * HOUR]


@query(
    f"{T}, {QUOTES} SELECT b.id, b.symbol, b.ts_ms, b.tick"
    + "".join(f", q{i}.quote quote_{s}" for i, s in enumerate(STEPS))
    + " FROM tape b"
    + "".join(f" ASOF LEFT JOIN quotes q{i} ON b.symbol = q{i}.symbol AND b.ts_ms + {s} >= q{i}.ts_ms" for i, s in enumerate(STEPS))
)
def asof_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.horizons(views.tape(spark, sf_dir).select("id", "symbol", "ts_ms", "tick"), _quotes(spark, sf_dir), "symbol", "ts_ms", "quote", STEPS)


@query(f"{T}, i AS (SELECT symbol, ts_ms s, ts_ms + 1800000 e, id iid FROM tape) SELECT iid, i.symbol, count(*) n, cast(sum(t.lots) AS BIGINT) lots, max(t.id) last_id FROM tape t JOIN i ON t.symbol = i.symbol AND t.ts_ms >= s AND t.ts_ms < e GROUP BY 1, 2")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What trades in the half hour from each trade on: every trade is a point and an interval. Sums are differences at the two ends, the last id an extreme, all in one pass; no pairs."""
    t = views.tape(spark, sf_dir).select("id", "symbol", "ts_ms", "lots")
    spans = t.select("symbol", F.col("ts_ms").alias("s"), (F.col("ts_ms") + HOUR // 2).alias("e"), F.col("id").alias("iid"))
    met = ranges.range_totals(spans, t, "symbol", "ts_ms", "s", "e", ["lots"], "id", HOUR // 2)
    return met.select("iid", "symbol", "n", "lots", F.col("hi").alias("last_id"))


HOURLY = f"hourly AS (SELECT symbol, ts_ms // {HOUR} * {HOUR} ts_ms, max_by(tick, (ts_ms, id)) tick, sum(lots) lots FROM tape GROUP BY 1, 2)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tape(spark, sf_dir).withColumn("h", F.floor(F.col("ts_ms") / HOUR) * HOUR)
    return t.groupBy("symbol", F.col("h").alias("ts_ms")).agg(F.max_by("tick", F.struct("ts_ms", "id")).alias("tick"), F.sum("lots").alias("lots"))


@query(
    f"""{T}, {HOURLY}, e AS (SELECT symbol, min(ts_ms) a, max(ts_ms) b FROM hourly GROUP BY 1), s AS (SELECT symbol, unnest(generate_series(a, b, {HOUR})) ts_ms FROM e)
    SELECT symbol, ts_ms, last_value(tick IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts_ms) tick, cast(coalesce(lots, 0) AS BIGINT) lots FROM s LEFT JOIN hourly USING (symbol, ts_ms)"""
)
def calendar_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.densify(hourly(spark, sf_dir), "symbol", "ts_ms", HOUR, ["tick"], ["lots"])


@query(
    f"""{T}, {HOURLY}, e AS (SELECT symbol, ts_ms event FROM tape), o AS (SELECT symbol, event, "offset", (event // {HOUR} + "offset") * {HOUR} ts_ms FROM e, range(-3, 4) t("offset"))
    SELECT "offset", count(*) n, {r6_sql('avg(lots)')} AS lots FROM o JOIN hourly USING (symbol, ts_ms) GROUP BY 1"""
)
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity around every trade. Events of one bar share their windows, so they are counted by bar before they are spread."""
    events = views.tape(spark, sf_dir).groupBy("symbol", (F.floor(F.col("ts_ms") / HOUR) * HOUR).alias("ts_ms")).agg(F.count("*").alias("k"))
    found = asof.event_windows(events, hourly(spark, sf_dir), "symbol", "ts_ms", HOUR, 3, 3, ["k"])
    n = F.sum("k")
    return rounded(found.groupBy(F.col("offset").cast("long").alias("offset")).agg(n.alias("n"), (F.sum(F.col("k") * F.col("lots")) / n).alias("lots")))


@query(
    f"""WITH {views.PANEL_SQL}, {views.MACRO_SQL} SELECT asset, date, m."month", {r6_sql('m.value')} AS value FROM panel_bars p ASOF LEFT JOIN macro m ON p.date >= m.available"""
)
def publication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro values as known on each day: joined on the date from which they were public."""
    panel = views.panel_bars(spark, sf_dir).select("asset", "date", F.datediff("date", F.lit("1970-01-01")).alias("day"), F.lit(0).alias("one"))
    m = views.macro(spark, sf_dir).select(F.datediff("available", F.lit("1970-01-01")).alias("day"), "month", "value", F.lit(0).alias("one"))
    # one series for all assets: days are joined once, then spread to the assets
    days = panel.select("one", "day").distinct()
    known = asof.asof(days, m, "one", "day", ["month", "value"]).select("day", "month", "value")
    return rounded(panel.join(known, "day").select("asset", "date", "month", "value"))


@query(f"{T}, {HOURLY}, a AS (SELECT *, extract('hour' FROM to_timestamp(ts_ms / 1000)) h FROM hourly), c AS (SELECT symbol, h, avg(lots) m FROM a GROUP BY 1, 2) SELECT symbol, ts_ms, {r6_sql('lots - m')} AS excess FROM a JOIN c USING (symbol, h)")
def cell_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value less the mean of its cell (symbol, hour of the day): an aggregate joined back, not a window over the cell."""
    a = hourly(spark, sf_dir).withColumn("h", F.hour(F.timestamp_millis("ts_ms")))
    cells = a.groupBy("symbol", "h").agg(F.avg("lots").alias("m"))
    return rounded(a.join(cells, ["symbol", "h"]).select("symbol", "ts_ms", (F.col("lots") - F.col("m")).alias("excess")))


@query(
    """WITH m AS (SELECT o_orderkey k, o_totalprice v FROM orders WHERE o_orderkey % 7 <> 0), t AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END v FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT coalesce(m.k, t.k) k, m.v mine, t.v theirs, CASE WHEN m.v IS NULL THEN 'unknown here' WHEN t.v IS NULL THEN 'missing there' ELSE 'differs' END kind FROM m FULL JOIN t ON m.k = t.k WHERE m.v IS NULL OR t.v IS NULL OR m.v <> t.v"""
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    theirs = o.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 11 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return asof.differences(o.where("k % 7 <> 0"), theirs, "k", "v")


@query(f"{T}, {HOURLY} SELECT v.symbol, v.ts_ms FROM hourly v LEFT JOIN (SELECT DISTINCT symbol, ts_ms FROM hourly WHERE lots > 20) h USING (symbol, ts_ms) WHERE h.ts_ms IS NULL")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    return h.join(h.where("lots > 20"), ["symbol", "ts_ms"], "left_anti").select("symbol", "ts_ms")


@query("SELECT o_custkey, count(*) n, max(o_orderkey) AS last_order FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(rich, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_order"))


@query(
    """SELECT n_name, r_name, count(DISTINCT c_custkey) customers, count(o_orderkey) orders FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"""
)
def equi_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    # orders are counted per customer before they meet the customers: the large side shuffles counts, not rows
    per = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    held = t("customer").join(per, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"))
    named = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.join(held, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("orders", F.lit(0)).alias("orders"))


@query(f"{T} SELECT symbol, ts_ms // {HOUR} AS \"hour\", max_by(tick, (ts_ms, id)) tick, max_by(id, (ts_ms, id)) id FROM tape GROUP BY 1, 2")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tape(spark, sf_dir).select("symbol", F.expr(f"ts_ms div {HOUR}").alias("hour"), "ts_ms", "id", "tick")
    return asof.latest(t, ["symbol", "hour"], ["ts_ms", "id"]).select("symbol", "hour", "tick", "id")
