"""Queries of the order book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import r6_sql, rounded
from tidewright.operators import book
from tidewright.registry import query

B = f"WITH {views.BOOK_SQL}"
HOUR, DAY = 3_600_000, 86_400_000


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


def levels_sql(ms: int, name: str = "levels") -> str:
    return f"""{name}_v AS (SELECT *, lead(ts_ms) OVER (PARTITION BY side, tick ORDER BY u) next_ms FROM book_deltas), {name}_m AS (SELECT side, tick, size, unnest(range(ts_ms // {ms} + 1, coalesce(next_ms, (SELECT max(ts_ms) FROM book_deltas)) // {ms} + 1)) m FROM {name}_v WHERE size > 0),
    {name} AS (SELECT m * {ms} moment, side, tick, size FROM {name}_m)"""


LEVELS = levels_sql(6 * HOUR)
_I = lambda b, a: f"({b} - {a}) / nullif({b} + {a}, 0)"
STATES = """k_ AS (SELECT *, row_number() OVER (PARTITION BY moment, side ORDER BY -side * tick) k FROM levels),
    st AS (SELECT moment, max(tick) FILTER (side = 1) bid, min(tick) FILTER (side = -1) ask, sum(size) FILTER (side = 1 AND k = 1) q_bid, sum(size) FILTER (side = -1 AND k = 1) q_ask, sum(size) FILTER (side = 1) q_bid5, sum(size) FILTER (side = -1) q_ask5 FROM k_ WHERE k <= 5 GROUP BY 1)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.checkpoints(views.book_deltas(spark, sf_dir), 6 * HOUR)


@query(f"{B}, {LEVELS} SELECT * FROM levels")
def book_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir)


@query(f"{B}, {LEVELS}, {STATES} SELECT moment, bid, ask, {r('q_bid', 'q_bid')}, {r('q_ask', 'q_ask')}, {r('q_bid5', 'q_bid5')}, {r('q_ask5', 'q_ask5')}, (bid + ask) / 2 mid, ask - bid spread, {r(_I('q_bid', 'q_ask'), 'i1')}, {r(_I('q_bid5', 'q_ask5'), 'i5')}, {r('(bid * q_ask + ask * q_bid) / (q_bid + q_ask)', 'microprice')} FROM st")
def book_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.states(levels(spark, sf_dir)))


@query(f"{B}, {LEVELS}, q AS (SELECT moment, (max(tick) FILTER (side = 1) + min(tick) FILTER (side = -1)) / 2 mid FROM levels GROUP BY 1) SELECT moment, {r('coalesce(sum(size) FILTER (side = 1), 0)', 'depth_bid')}, {r('coalesce(sum(size) FILTER (side = -1), 0)', 'depth_ask')} FROM levels JOIN q USING (moment) WHERE abs(tick - mid) <= 0.0005 * mid GROUP BY 1")
def book_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.depth(levels(spark, sf_dir)))


@query(
    f"""{B}, {LEVELS}, t AS (SELECT moment, tick, least(size, greatest(500 - coalesce(sum(size) OVER (PARTITION BY moment ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) take FROM levels WHERE side = -1),
    s AS (SELECT moment, sum(take) got, sum(take * tick) paid, max(tick) FILTER (take > 0) w, min(tick) b FROM t GROUP BY 1)
    SELECT moment, {r('CASE WHEN got >= 500 - 1e-9 THEN paid / got END', 'price')}, CASE WHEN got >= 500 - 1e-9 THEN w END worst, {r('CASE WHEN got >= 500 - 1e-9 THEN abs(paid / got - b) END', '\"cost\"')} FROM s"""
)
def walk_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.walk(levels(spark, sf_dir), 500.0))


# the state after every update, by asking for each update and level the last change so far
UPDATES = """l_ AS (SELECT DISTINCT side, tick FROM book_deltas), c_ AS (SELECT d.ts_ms, d.u, l.side, l.tick FROM book_deltas d, l_ l),
    f_ AS (SELECT c.ts_ms, c.u, c.side, c.tick, b.size FROM c_ c ASOF JOIN book_deltas b ON c.side = b.side AND c.tick = b.tick AND c.u >= b.u), g_ AS (SELECT *, row_number() OVER (PARTITION BY u, side ORDER BY -side * tick) k FROM f_ WHERE size > 0),
    us AS (SELECT u, max(ts_ms) ts_ms, max(tick) FILTER (side = 1) bid, min(tick) FILTER (side = -1) ask, sum(size) FILTER (side = 1 AND k = 1) q_bid, sum(size) FILTER (side = -1 AND k = 1) q_ask, sum(size) FILTER (side = 1) q_bid5, sum(size) FILTER (side = -1) q_ask5 FROM g_ WHERE k <= 5 GROUP BY 1)"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.fold_states(views.book_deltas(spark, sf_dir), 6 * HOUR)


@query(f"{B}, {UPDATES} SELECT d.ts_ms, d.u, bid, ask, {r('q_bid', 'q_bid')}, {r('q_ask', 'q_ask')}, {r('q_bid5', 'q_bid5')}, {r('q_ask5', 'q_ask5')} FROM book_deltas d LEFT JOIN us USING (u)")
def book_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(updates(spark, sf_dir))


SNAPSHOTS = "snap AS (SELECT moment, side, tick, CASE WHEN tick % 7 = 0 THEN size + 1 ELSE size END size FROM levels WHERE moment % (24 * 3600000) = 0 AND tick % 11 <> 0)"


@query(f"{B}, {LEVELS}, {SNAPSHOTS} SELECT coalesce(l.moment, s.moment) moment, coalesce(l.side, s.side) side, coalesce(l.tick, s.tick) tick, l.size rebuilt, s.size FROM (SELECT * FROM levels WHERE moment IN (SELECT moment FROM snap)) l FULL JOIN snap s ON l.moment = s.moment AND l.side = s.side AND l.tick = s.tick WHERE l.size IS DISTINCT FROM s.size")
def book_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences from snapshots that were changed on purpose."""
    snap = levels(spark, sf_dir).where(f"moment % {DAY} = 0 AND tick % 11 <> 0").withColumn("size", F.when(F.col("tick") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return book.verify(views.book_deltas(spark, sf_dir), snap, 6 * HOUR)


@query(f"{B}, g AS (SELECT lag(ts_ms) OVER (ORDER BY u) start_ms, ts_ms end_ms FROM book_deltas) SELECT start_ms, end_ms, (end_ms - start_ms) / 1000.0::DOUBLE AS \"seconds\" FROM g WHERE end_ms - start_ms > 1200000")
def feed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.feed_gaps(views.book_deltas(spark, sf_dir), 1_200_000)


SAMPLES = f"""m_ AS (SELECT ts_ms // {DAY} AS "day", u, ts_ms, bid + ask mid2, q_bid, q_ask FROM us WHERE bid IS NOT NULL AND ask IS NOT NULL), n_ AS (SELECT *, coalesce(cast(mid2 <> lag(mid2) OVER (PARTITION BY "day" ORDER BY u) AS INT), 1) c FROM m_), r_ AS (SELECT *, sum(c) OVER (PARTITION BY "day" ORDER BY u) run FROM n_),
    o_ AS (SELECT * FROM r_ QUALIFY row_number() OVER (PARTITION BY "day", run ORDER BY (u * 1103515245 + 12345) % 2147483648, u) = 1),
    samples AS (SELECT "day", cast(run AS BIGINT) run, u, ts_ms, mid2, (q_bid - q_ask) / (q_bid + q_ask) i1, lead(mid2) OVER (PARTITION BY "day" ORDER BY run) > mid2 up FROM o_)"""


@query(f"{B}, {UPDATES}, {SAMPLES} SELECT \"day\", run, u, ts_ms, mid2, {r('i1', 'i1')}, up FROM samples")
def mid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.mid_samples(updates(spark, sf_dir)))


@query(f"{B}, {UPDATES}, {SAMPLES} SELECT cast(least(floor((i1 + 1) / 2 * 10), 9) AS BIGINT) band, {r('avg(cast(up AS INT))', 'p_up')}, count(*) n FROM samples WHERE up IS NOT NULL AND i1 IS NOT NULL GROUP BY 1")
def imbalance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.imbalance_bands(book.mid_samples(updates(spark, sf_dir))))


@query(
    f"""{B}, {UPDATES}, p AS (SELECT *, lag(bid) OVER w pb, lag(ask) OVER w pa, lag(q_bid) OVER w pqb, lag(q_ask) OVER w pqa FROM us WHERE bid IS NOT NULL AND ask IS NOT NULL WINDOW w AS (PARTITION BY ts_ms // {DAY} ORDER BY u)),
    e AS (SELECT ts_ms // {HOUR} * {HOUR} moment, CASE WHEN bid >= pb THEN q_bid ELSE 0 END - CASE WHEN bid <= pb THEN pqb ELSE 0 END - (CASE WHEN ask <= pa THEN q_ask ELSE 0 END - CASE WHEN ask >= pa THEN pqa ELSE 0 END) e FROM p WHERE pb IS NOT NULL)
    SELECT moment, {r('sum(e)', 'ofi')}, count(*) n FROM e GROUP BY 1"""
)
def order_flow_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.order_flow_imbalance(updates(spark, sf_dir), HOUR))


@query(f"{B}, x AS (SELECT ts_ms, side, size, lag(size) OVER (PARTITION BY side, tick ORDER BY u) b FROM book_deltas) SELECT ts_ms // {DAY} AS \"day\", side, {r('sum(b - size)', 'lost')}, count(*) FILTER (size = 0) emptied, count(*) n FROM x WHERE b > size GROUP BY 1, 2")
def book_pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.pulls(views.book_deltas(spark, sf_dir)))
