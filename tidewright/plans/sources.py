"""Queries of sources and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import r6_sql, rounded
from tidewright.operators import scalars
from tidewright.registry import query
from tidewright.session import table
from tidewright.sources import market

P, T = f"WITH {views.PANEL_SQL}", f"WITH {views.TAPE_SQL}"


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


@query("SELECT event_id, epoch_us(ts) // 1000 ts, 1 side, cast(round(value * 10) AS BIGINT) tick, cast(user_id AS DOUBLE) size FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, epoch_us(ts) // 1000, -1, cast(round(value * 10) AS BIGINT) + 5, cast(user_id + 1 AS DOUBLE) FROM events WHERE event_type = 'view'")
def json_book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as JSON lines and read back as level rows; the id travels as u."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("t", F.round(F.col("value") * 10))
    level = lambda price, size: F.array(F.array(price.cast("string"), size.cast("string")))
    data = F.struct(F.col("event_id").alias("u"), F.lit(0).alias("seq"), level(F.col("t") / 10, F.col("user_id")).alias("b"), level((F.col("t") + 5) / 10, F.col("user_id") + 1).alias("a"))
    lines = e.select(F.to_json(F.struct(F.expr("unix_micros(cast(ts AS timestamp)) div 1000").alias("ts"), F.lit("delta").alias("type"), data.alias("data"))).alias("value"))
    return market.book_messages(lines).select(F.col("u").alias("event_id"), "ts", "side", "tick", "size")


@query("SELECT l_orderkey, l_linenumber, l_quantity q FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' UNION ALL SELECT l_orderkey, l_linenumber, -l_quantity FROM lineitem WHERE l_returnflag NOT IN (SELECT l_returnflag FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O')")
def clean_over_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("q"))  # noqa: E741
    clean = l.where("l_returnflag = 'N' AND l_linestatus = 'O'").drop("l_linestatus")
    return market.resolve(clean, l.drop("l_linestatus").withColumn("q", -F.col("q")), "l_returnflag").select("l_orderkey", "l_linenumber", "q")


@query(
    f"""{T} SELECT id, (ts_ms // 3600000 + 72) % 168 how, tick BETWEEN 19990 AND 20010 AS near, cast(round(ln(tick) * 1000) AS INT) AS lg, least(greatest(tick - 20000, -50), 50) clipped, {r('tanh((tick - 20000) / 100.0)', 'squashed')},
    CASE WHEN lots > 5 THEN CASE WHEN lots > 20 THEN 2 ELSE 1 END ELSE 0 END cut, upper(substr(symbol, 1, 2)) || regexp_extract(symbol, '[aeiou]', 0) tag FROM tape"""
)
def scalar_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tick")
    return rounded(
        views.tape(spark, sf_dir).select(
            "id",
            scalars.hour_of_week(F.col("ts_ms")).alias("how"),
            t.between(19990, 20010).alias("near"),
            F.round(F.ln(t) * 1000).cast("int").alias("lg"),
            F.least(F.greatest(t - 20000, F.lit(-50)), F.lit(50)).alias("clipped"),
            F.tanh((t - 20000) / 100.0).alias("squashed"),
            scalars.cut(F.col("lots"), [5, 20]).alias("cut"),
            F.concat(F.upper(F.substring("symbol", 1, 2)), F.regexp_extract("symbol", "[aeiou]", 0)).alias("tag"),
        )
    )


_SUN = lambda m, n: f"(make_date(y, {m}, 1) + cast((7 - isodow(make_date(y, {m}, 1))) % 7 + {7 * (n - 1)} AS INT))"
_LF = "(last_day(d) - cast((isodow(last_day(d)) - 5 + 7) % 7 AS INT))"


@query(
    f"""WITH a AS (SELECT DISTINCT cast(cast(o_orderdate AS DATE) + INTERVAL 15 YEAR AS DATE) d FROM orders), b AS (SELECT d, year(d) y FROM a)
    SELECT d, d >= {_SUN(3, 2)} AND d < {_SUN(11, 1)} summer, CASE WHEN d = {_LF} AND month(d) % 3 = 0 THEN 'quarterly' WHEN d = {_LF} THEN 'monthly' WHEN isodow(d) = 5 THEN 'weekly' END expiry,
      epoch_ms((d + INTERVAL 8 HOUR + INTERVAL 30 MINUTE)::TIMESTAMP) + CASE WHEN d >= {_SUN(3, 2)} AND d < {_SUN(11, 1)} THEN 4 ELSE 5 END * 3600000 slot_ms FROM b"""
)
def calendar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    days = table(spark, sf_dir, "orders").select(F.add_months(F.col("o_orderdate").cast("date"), 180).alias("d")).distinct()  # the present rules hold from 2007 on
    return days.select("d", scalars.us_summer_time(d).alias("summer"), scalars.expiry_kind(d).alias("expiry"), scalars.new_york_slot(d, 8, 30).alias("slot_ms"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) first_value, len(json_keys(props)) n FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"), F.json_object_keys("props").alias("k"))
    return m.select("event_id", F.element_at("m", F.element_at("k", 1)).alias("first_value"), F.size("k").cast("long").alias("n"))
