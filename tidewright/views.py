"""Market-data views over the driver's tables, as frames and as SQL for DuckDB.

panel_bars(asset, date, open, high, low, close, volume, trades): daily bars of six assets, from ``lineitem``.
tape(id, symbol, ts_ms, tick, lots, is_buyer_maker): trades of five symbols, from ``events``; the price is tick / 10.
book_deltas(ts_ms, u, side, tick, size): changes of book levels, from ``events``; size 0 removes a level.
market_changes, market_trades: level changes of three books, and what trades against their levels, from ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.session import table

DAY_MS = 86_400_000


def panel_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("asset"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).alias("px"),
        F.col("l_quantity").alias("q"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"),
    )
    # first and last by order need no sort: min_by and max_by combine on the map side
    return rows.groupBy("asset", "date").agg(
        F.min_by("px", "at").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "at").alias("close"),
        F.sum("q").alias("volume"),
        F.count("*").alias("trades"),
    )


PANEL_SQL = """px_ AS (SELECT concat(l_returnflag, l_linestatus) asset, cast(l_shipdate AS DATE) date,
    floor(l_extendedprice * 100 / l_quantity) / 100 px, l_quantity q,
    row_number() OVER w rn, count(*) OVER (PARTITION BY concat(l_returnflag, l_linestatus), cast(l_shipdate AS DATE)) n
  FROM lineitem WINDOW w AS (PARTITION BY concat(l_returnflag, l_linestatus), cast(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
panel_bars AS (SELECT asset, date, max(px) FILTER (rn = 1) open, max(px) high, min(px) low, max(px) FILTER (rn = n) close, sum(q) volume, max(n) trades FROM px_ GROUP BY ALL)"""


def _ms() -> F.Column:
    return F.expr("unix_micros(cast(ts AS timestamp)) div 1000")


def _running(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with the running sum of ``value`` in order of (ts, event_id): inside days, and over the sums of the days before, of which there is one row a day."""
    dated = rows.withColumn("__day", F.expr(f"ts_ms div {DAY_MS}"))
    inside = F.sum(value).over(Window.partitionBy(*by, "__day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    days = dated.groupBy(*by, "__day").agg(F.sum(value).alias("__s"))
    before = days.select(*by, "__day", (F.sum("__s").over(Window.partitionBy(*by).orderBy("__day")) - F.col("__s")).alias("__before"))
    return dated.withColumn("__run", inside).join(before, [*by, "__day"]).select(*rows.columns, (F.col("__before") + F.col("__run")).alias("running"))


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.round(F.col("value") * 100).cast("long") % 21 - 10
    rows = table(spark, sf_dir, "events").select("ts", "event_id", F.col("event_type").alias("symbol"), _ms().alias("ts_ms"), "user_id", step.alias("step"))
    return _running(rows, ["symbol"], "step").select(
        F.col("event_id").alias("id"),
        "symbol",
        "ts_ms",
        (20000 + F.col("running")).alias("tick"),
        (F.col("user_id") % 50 + 1).alias("lots"),
        (F.col("user_id") % 2 == 1).alias("is_buyer_maker"),
    )


TAPE_SQL = """tape AS (SELECT event_id id, event_type symbol, epoch_us(ts) // 1000 ts_ms,
    20000 + cast(sum(cast(round(value * 100) AS BIGINT) % 21 - 10) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) tick,
    user_id % 50 + 1 lots, user_id % 2 = 1 is_buyer_maker FROM events)"""


def book_deltas(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    """Changes of one book, numbered by u; with ``by`` a book for each of these columns of the events, numbered apart."""
    side = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    rows = table(spark, sf_dir, "events").select("*", _ms().alias("ts_ms"), F.lit(1).cast("long").alias("one"))
    return _running(rows, by or [], "one").select(
        *(by or []),
        "ts_ms",
        F.col("running").alias("u"),
        side.alias("side"),
        (20000 - side * (1 + F.col("user_id") % 20)).alias("tick"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("size"),
    )


BOOK_SQL = """book_deltas AS (SELECT epoch_us(ts) // 1000 ts_ms, row_number() OVER (ORDER BY ts, event_id) u, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END side,
    20000 - (CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END) * (1 + user_id % 20) tick, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value END size FROM events)"""


def market_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market_changes(symbol, ts_ms, u, side, tick, size): level changes of three books with whole sizes, from ``events``, numbered by u in each book."""
    k = F.floor(F.col("user_id") / 3)
    side = F.when(k % 2 == 0, 1).otherwise(-1)
    rows = table(spark, sf_dir, "events").select("ts", "event_id", F.concat(F.lit("M"), F.col("user_id") % 3).alias("symbol"), _ms().alias("ts_ms"), side.alias("side"), k.alias("k"), "event_type", "value", F.lit(1).cast("long").alias("one"))
    size = F.when(F.col("event_type") == "error", 0).otherwise(1 + F.round(F.col("value") * 100).cast("long") % 40)
    return _running(rows, ["symbol"], "one").select("symbol", "ts_ms", F.col("running").alias("u"), "side", (20000 - F.col("side") * (1 + F.col("k") % 5)).alias("tick"), size.alias("size"))


def market_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market_trades(id, symbol, ts_ms, side, tick, size): what traded against the resting ``side`` at a level, a third of the events and some of the level's size each."""
    k = F.floor(F.col("user_id") / 3)
    side = F.when(k % 2 == 0, 1).otherwise(-1)
    rows = table(spark, sf_dir, "events").where("event_id % 3 = 1")
    return rows.select(F.col("event_id").alias("id"), F.concat(F.lit("M"), F.col("user_id") % 3).alias("symbol"), _ms().alias("ts_ms"), side.alias("side"), (20000 - side * (1 + k % 5)).alias("tick"), (1 + F.round(F.col("value") * 100).cast("long") % 25).alias("size"))


MARKET_SQL = """mk_ AS (SELECT event_id, ts, 'M' || (user_id % 3) symbol, epoch_us(ts) // 1000 ts_ms, user_id // 3 k, CASE WHEN (user_id // 3) % 2 = 0 THEN 1 ELSE -1 END side, event_type, cast(round(value * 100) AS BIGINT) c FROM events),
market_changes AS (SELECT symbol, ts_ms, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) u, side, 20000 - side * (1 + k % 5) tick, CASE WHEN event_type = 'error' THEN 0 ELSE 1 + c % 40 END size FROM mk_),
market_trades AS (SELECT event_id id, symbol, ts_ms, side, 20000 - side * (1 + k % 5) tick, 1 + c % 25 size FROM mk_ WHERE event_id % 3 = 1)"""


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """macro(month, value, available): a monthly series that is published on the 16th of the next month, from ``orders``."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "MM")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    got = table(spark, sf_dir, "orders").groupBy(month.alias("month")).agg((cents / (F.lit(100.0) * F.count("*"))).alias("value"))
    return got.withColumn("available", F.date_add(F.add_months("month", 1), 15))


MACRO_SQL = """macro AS (SELECT cast(date_trunc('month', cast(o_orderdate AS DATE)) AS DATE) AS "month", sum(cast(round(o_totalprice * 100) AS BIGINT)) / (100.0::DOUBLE * count(*)) AS value,
    cast(date_trunc('month', cast(o_orderdate AS DATE)) + INTERVAL 1 MONTH + INTERVAL 15 DAY AS DATE) available FROM orders GROUP BY 1, 3)"""
