"""Queries that run as streams over replayed files, against SQL on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.registry import query
from tidewright.streaming import bars, carry

T = f"WITH {views.TAPE_SQL}"
HOUR = 3_600_000


@query(
    f"""{T}, m AS (SELECT max(ts_ms) - 600000 w FROM tape) SELECT symbol, ts_ms // {HOUR} * {HOUR} start_ms, min_by(tick, (ts_ms, id)) open, max(tick) high, min(tick) low, max_by(tick, (ts_ms, id)) "close", cast(sum(lots) AS BIGINT) lots, count(*) trades
    FROM tape, m GROUP BY 1, 2 HAVING max(ts_ms // {HOUR} * {HOUR}) + {HOUR} <= any_value(w)"""
)
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the hours that the watermark has closed."""
    return bars.replay(spark, views.tape(spark, sf_dir), bars.live_bars, files=None)


@query(f"{T} SELECT DISTINCT * FROM tape")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tape(spark, sf_dir)
    return bars.replay(spark, t.unionByName(t.where("id % 7 = 0")), bars.deduplicated, files=None)


@query(f"{T}, k AS (SELECT *, unnest([0, 1, 2, 3]) j FROM tape) SELECT symbol, (ts_ms // 900000 - j) * 900000 start_ms, count(*) trades, cast(sum(lots) AS BIGINT) lots FROM k GROUP BY 1, 2")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.sliding_counts(views.tape(spark, sf_dir))


@query(
    f"""{T}, g AS (SELECT *, coalesce(cast(ts_ms - lag(ts_ms) OVER w >= 1800000 AS INT), 1) n FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms, id)), s AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY ts_ms, id) k FROM g)
    SELECT symbol, min(ts_ms) start_ms, max(ts_ms) end_ms, count(*) trades FROM s GROUP BY symbol, k"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.sessions(views.tape(spark, sf_dir))


@query()
def stream_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each kind of event, from a stream with a snapshot at its start and a gap in its ids; tests hold the hand cases."""
    d = views.book_deltas(spark, sf_dir, ["event_type"]).where("u % 1000 <> 500")
    rows = d.select(F.col("event_type").alias("symbol"), "u", "ts_ms", (F.col("u") % 1000 == 1).alias("snap"), "side", F.col("tick").cast("long").alias("tick"), "size")
    return bars.replay(spark, rows, bars.live_book, files=None)


def chunks(rows: DataFrame, n: int = 3) -> list[DataFrame]:
    """``rows`` in ``n`` stretches of time."""
    a, b = rows.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    k = F.least(F.floor((F.col("ts_ms") - a) * n / (b - a + 1)), F.lit(n - 1))
    return [rows.where(k == i) for i in range(n)]


@query(
    f"""{T}, b AS (SELECT *, (sum(lots) OVER (PARTITION BY symbol ORDER BY ts_ms, id) - lots) // 1000 bar FROM tape)
    SELECT symbol, cast(bar AS BIGINT) bar, min(ts_ms) start_ms, max(ts_ms) end_ms, min_by(tick, (ts_ms, id)) open, max(tick) high, min(tick) low, max_by(tick, (ts_ms, id)) "close", cast(sum(lots) AS BIGINT) lots, count(*) trades FROM b GROUP BY 1, 2"""
)
def bars_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume bars over three chunks whose open bars are carried on, and the last open ones: the bars of one run."""
    done, state = carry.in_chunks(chunks(views.tape(spark, sf_dir).select("id", "symbol", "ts_ms", "tick", "lots")), carry.lot_bars(1000))
    return done.unionByName(carry.unfinished(state))


@query(
    f"""{T}, c AS (SELECT *, sum(lots) OVER (PARTITION BY symbol, is_buyer_maker ORDER BY ts_ms, id) e FROM tape), p AS (SELECT b.symbol, b.id buy_id, s.id sell_id, least(b.e, s.e) - greatest(b.e - b.lots, s.e - s.lots) lots, s.tick - b.tick d
      FROM c b JOIN c s ON b.symbol = s.symbol AND NOT b.is_buyer_maker AND s.is_buyer_maker AND b.e - b.lots < s.e AND s.e - s.lots < b.e)
    SELECT symbol, buy_id, sell_id, cast(sum(lots) AS BIGINT) lots, cast(sum(lots * d) AS BIGINT) result FROM p GROUP BY 1, 2, 3"""
)
def lots_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bought lots closed with sold ones, first in, first out, over three chunks with their open lots carried on: the pairs of one run."""
    side = F.when(F.col("is_buyer_maker"), -1).otherwise(1)
    done, _ = carry.in_chunks(chunks(views.tape(spark, sf_dir).select("id", "symbol", "ts_ms", side.alias("side"), "tick", "lots")), carry.match_lots)
    return done.groupBy("symbol", "buy_id", "sell_id").agg(F.sum("lots").alias("lots"), F.sum("result").alias("result"))


W_ = "PARTITION BY asset ORDER BY date"


@query(
    f"""WITH {views.PANEL_SQL}, s AS (SELECT asset, date, lag(date) OVER w p, "close" - lag("close") OVER w d FROM panel_bars WINDOW w AS ({W_})), g AS (SELECT *, cast(sign(d) AS BIGINT) sg FROM s), h AS (SELECT *, sum(cast(sg IS DISTINCT FROM psg OR sg = 0 AS INT)) OVER ({W_}) r FROM (SELECT *, lag(sg) OVER ({W_}) psg FROM g))
    SELECT asset, min(p) AS "from", max(date) AS "to", sg AS "sign", count(*) steps, floor(sum(d) * 1e6 + 0.5) / 1e6 AS "change" FROM h WHERE sg <> 0 GROUP BY asset, r, sg"""
)
def price_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of rising and falling closes by a table function, one asset a partition."""
    from tidewright.functions import tables
    from tidewright.functions.windows import rounded

    tables.register(spark)
    panel = views.panel_bars(spark, sf_dir).select("asset", "date", "close")
    return rounded(spark.sql("SELECT * FROM streaks(TABLE(SELECT * FROM {panel}) PARTITION BY (asset) ORDER BY (date), 'asset', 'date', 'close')", panel=panel))


@query(
    f"""{T}, w AS (SELECT symbol, ts_ms // 86400000 AS "day", tick, sum(lots) OVER (PARTITION BY symbol, ts_ms // 86400000 ORDER BY tick) u, sum(lots) OVER (PARTITION BY symbol, ts_ms // 86400000) n FROM tape)
    SELECT symbol, "day", cast(min(tick) AS DOUBLE) median FROM w WHERE 2 * u >= n GROUP BY 1, 2"""
)
def weighted_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median price by day, weighed by lots, with an aggregate written in Python and called from SQL."""
    from tidewright.functions import tables

    tables.register(spark)
    return spark.sql("SELECT symbol, ts_ms div 86400000 AS day, weighted_median(cast(tick AS double), cast(lots AS double)) AS median FROM {t} GROUP BY 1, 2", t=views.tape(spark, sf_dir))
