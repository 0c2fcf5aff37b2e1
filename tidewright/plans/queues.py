"""Queries of the queues of order books: three books, ``market_changes`` and ``market_trades``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import r6_sql, rounded
from tidewright.operators import book, queues
from tidewright.registry import query
from tidewright.session import materialise

BY = ["symbol"]
HOUR = 3_600_000
M = f"WITH {views.MARKET_SQL}"
EVENTS = """lc_ AS (SELECT symbol, side, tick, ts_ms, max(u) u, max_by(size, u) size FROM market_changes GROUP BY 1, 2, 3, 4), up_ AS (SELECT DISTINCT symbol, ts_ms FROM lc_), fr_ AS (SELECT symbol, min(ts_ms) f FROM lc_ GROUP BY 1),
    hit_ AS (SELECT t.symbol, t.side, t.tick, u.ts_ms, sum(t.size) hit FROM (SELECT t.* FROM market_trades t JOIN fr_ USING (symbol) WHERE t.ts_ms > f) t ASOF JOIN up_ u ON t.symbol = u.symbol AND t.ts_ms <= u.ts_ms GROUP BY 1, 2, 3, 4),
    e0_ AS (SELECT l.*, cast(coalesce(h.hit, 0) AS BIGINT) hit, coalesce(lag(l.size) OVER (PARTITION BY l.symbol, l.side, l.tick ORDER BY l.ts_ms), 0) old FROM lc_ l LEFT JOIN hit_ h ON l.symbol = h.symbol AND l.side = h.side AND l.tick = h.tick AND l.ts_ms = h.ts_ms),
    events_ AS (SELECT *, greatest(size - old, 0) added, least(greatest(old - size, 0), hit) traded, greatest(old - size, 0) - least(greatest(old - size, 0), hit) cancelled FROM e0_)"""
#: Best prices before and after each update: the last change of every level so far.
BEST = """lv_ AS (SELECT DISTINCT symbol, side, tick FROM lc_), g_ AS (SELECT u.symbol, u.ts_ms, l.side, l.tick FROM up_ u JOIN lv_ l USING (symbol)),
    b0_ AS (SELECT g.symbol, g.ts_ms, g.side, g.tick, b.size FROM g_ g ASOF JOIN lc_ b ON g.symbol = b.symbol AND g.side = b.side AND g.tick = b.tick AND g.ts_ms > b.ts_ms),
    best_ AS (SELECT u.symbol, u.ts_ms, max(tick) FILTER (side = 1 AND size > 0) best_bid, min(tick) FILTER (side = -1 AND size > 0) best_ask FROM up_ u LEFT JOIN b0_ USING (symbol, ts_ms) GROUP BY 1, 2)"""
DEPTH = """b1_ AS (SELECT g.symbol, g.ts_ms, g.side, g.tick, b.size FROM g_ g ASOF JOIN lc_ b ON g.symbol = b.symbol AND g.side = b.side AND g.tick = b.tick AND g.ts_ms >= b.ts_ms),
    depth_ AS (SELECT symbol, side, ts_ms, sum(size) AS "depth" FROM b1_ WHERE size > 0 GROUP BY 1, 2, 3)"""
OWN = "CASE WHEN side = 1 THEN best_bid ELSE best_ask END"
SPAN = 6 * HOUR


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: what follows reads it several times."""
    return materialise(queues.level_events(views.market_changes(spark, sf_dir), views.market_trades(spark, sf_dir), BY), "level-events")


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(queues.best_before(views.market_changes(spark, sf_dir), BY, SPAN), "best")


@query(f"{M}, {EVENTS} SELECT symbol, side, tick, ts_ms, u, size, hit, old, added, traded, cancelled FROM events_")
def level_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir)


@query(f"{M}, {EVENTS}, {BEST} SELECT symbol, side, cast(sum(added) AS BIGINT) added, cast(sum(traded) AS BIGINT) traded, cast(sum(cancelled) AS BIGINT) cancelled, count(*) n FROM events_ JOIN best_ USING (symbol, ts_ms) WHERE tick = {OWN} GROUP BY 1, 2")
def queue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.queue_totals(events(spark, sf_dir), best(spark, sf_dir), BY)


REFILLS = f"""x_ AS (SELECT *, old > 0 AND 100 * hit >= 50 * old AND size < old eaten FROM events_ WHERE size <> old OR size = 0),
    y_ AS (SELECT *, last_value(CASE WHEN old > 0 THEN {{'at': ts_ms, 'old': old, 'away': eaten AND size = 0}} END IGNORE NULLS) OVER (PARTITION BY symbol, side, tick ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) was FROM x_),
    refills_ AS (SELECT symbol, side, tick, ts_ms FROM y_ WHERE (added > 0 AND old = 0 AND was.away AND ts_ms - was.at <= {24 * HOUR} AND 100 * abs(size - was.old) <= 60 * was.old) OR (eaten AND size > 0 AND 100 * abs(size - old) <= 60 * old))"""


def refills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.refills(events(spark, sf_dir), BY, 24 * HOUR, 50, 60)


@query(f"{M}, {EVENTS}, {REFILLS} SELECT * FROM refills_")
def level_refills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that stand again after trades ate half of them or more; days and wide bands, as these books change every few minutes."""
    return refills(spark, sf_dir)


@query(
    f"""{M}, {EVENTS}, {REFILLS}, n_ AS (SELECT *, coalesce(cast(ts_ms - lag(ts_ms) OVER w > {72 * HOUR} AS INT), 1) b FROM refills_ WINDOW w AS (PARTITION BY symbol, side, tick ORDER BY ts_ms)), r_ AS (SELECT *, sum(b) OVER (PARTITION BY symbol, side, tick ORDER BY ts_ms) r FROM n_)
    SELECT symbol, side, tick, min(ts_ms) start_ms, max(ts_ms) end_ms, count(*) refills FROM r_ GROUP BY symbol, side, tick, r HAVING count(*) >= 2"""
)
def iceberg_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.refill_chains(refills(spark, sf_dir), BY, 72 * HOUR, 2)


@query(
    f"""{M}, {EVENTS}, {BEST}, c_ AS (SELECT e.symbol, side, tick, ts_ms, added, abs(tick - {OWN}) AS off, 100 * old + 20 * added lim FROM events_ e JOIN best_ USING (symbol, ts_ms) WHERE added >= 10 AND abs(tick - {OWN}) BETWEEN 1 AND 9),
    p_ AS (SELECT c.symbol, c.side, c.tick, c.ts_ms, c.added, c.off, min(e.ts_ms) FILTER (100 * e.size <= lim) gone, min(e.ts_ms) FILTER (e.hit >= 1) hit FROM c_ c LEFT JOIN events_ e ON c.symbol = e.symbol AND c.side = e.side AND c.tick = e.tick AND e.ts_ms > c.ts_ms AND e.ts_ms <= c.ts_ms + {12 * HOUR} GROUP BY 1, 2, 3, 4, 5, 6)
    SELECT symbol, side, tick, ts_ms, added, off, gone - ts_ms life_ms, coalesce(hit <= coalesce(gone, ts_ms + {12 * HOUR}), false) traded FROM p_"""
)
def spoof_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large additions behind the best and how long they stand."""
    return queues.short_lived(events(spark, sf_dir), best(spark, sf_dir), BY, 10, 12 * HOUR, HOUR // 4)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of each level and time, written once: books and events are both made from it."""
    return materialise(queues.last_of_time(views.market_changes(spark, sf_dir), BY), "changes")


def depths(known: DataFrame) -> DataFrame:
    """(symbol, side, ts_ms, depth) of all levels after each update; a side without levels has no row."""
    state = book.fold_states(known, SPAN, BY)
    last = state.groupBy("symbol", "ts_ms").agg(F.max_by(F.struct("q_bid5", "q_ask5"), "u").alias("s"))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("s.q_bid5").alias("depth")), F.struct(F.lit(-1).alias("side"), F.col("s.q_ask5").alias("depth")))).alias("x")
    out = last.select("symbol", "ts_ms", sides).select("symbol", "x.side", "ts_ms", F.col("x.depth").cast("long").alias("depth")).where("depth IS NOT NULL")
    return materialise(out, "depths")


def own_depths(known: DataFrame) -> DataFrame:
    """:func:`depths` without the rows of updates of the other side, at which a side's depth stays as it is: each side is a book of its own."""
    state = book.fold_states(known.withColumn("own", F.col("side")), SPAN, [*BY, "own"])
    last = state.groupBy("symbol", F.col("own").alias("side"), "ts_ms").agg(F.max_by(F.struct(F.coalesce("q_bid5", "q_ask5").cast("long").alias("depth")), "u").alias("s"))
    return materialise(last.select("symbol", "side", "ts_ms", "s.depth").where("depth IS NOT NULL"), "own-depths")


#: Depth before each update of a side, and whether the update took a fifth of it or more by trades.
SHOCKS = """tr_ AS (SELECT symbol, side, ts_ms, cast(sum(traded) AS BIGINT) traded FROM events_ GROUP BY 1, 2, 3),
    sh_ AS (SELECT t.symbol, t.side, t.ts_ms, t.traded, d."depth" AS "before" FROM tr_ t ASOF JOIN depth_ d ON t.symbol = d.symbol AND t.side = d.side AND t.ts_ms > d.ts_ms),
    shocks_ AS (SELECT symbol || '/' || side || '/' || ts_ms AS id, *, 5 * traded >= "before" AS shock FROM sh_)"""


def shocks(spark: SparkSession, sf_dir: str, known: DataFrame, depth: DataFrame, steps: list[int]) -> DataFrame:
    """(id, symbol, side, ts_ms, before, after, shock) of every update of a side."""
    took = queues.events_of(known, views.market_trades(spark, sf_dir), BY).groupBy("symbol", "side", "ts_ms").agg(F.sum("traded").alias("traded"))
    met = queues.depth_around(took, depth, BY, steps)
    return materialise(met.select(F.concat_ws("/", "symbol", "side", "ts_ms").alias("id"), "symbol", "side", "ts_ms", "before", "after", (5 * F.col("traded") >= F.col("before")).alias("shock")), "shocks")


@query(
    f"""{M}, {EVENTS}, {BEST}, {DEPTH}, {SHOCKS} SELECT s.id, min(d.ts_ms) FILTER (100 * d."depth" >= 90 * s."before") - s.ts_ms refill_ms FROM shocks_ s LEFT JOIN depth_ d ON s.symbol = d.symbol AND s.side = d.side AND d.ts_ms > s.ts_ms AND d.ts_ms <= s.ts_ms + {48 * HOUR} WHERE shock GROUP BY s.id, s.ts_ms"""
)
def refill_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long after trades took a fifth of a side or more its depth is back at nine tenths."""
    known = changes(spark, sf_dir)
    depth = depths(known)
    return queues.refill_times(shocks(spark, sf_dir, known, depth, []).where("shock").drop("after"), depth, BY, 48 * HOUR, HOUR // 2)


STEPS = [HOUR // 4, HOUR, 4 * HOUR, 12 * HOUR]


@query(
    f"""{M}, {EVENTS}, {BEST}, {DEPTH}, {SHOCKS}, c_ AS (SELECT s.id, s.symbol, s.side, s.ts_ms + k AS ts_ms, k AS step, s."before" FROM shocks_ s, (SELECT unnest({STEPS}) k)), r_ AS (SELECT c.id, c.step, d."depth" / c."before"::DOUBLE ratio FROM c_ c ASOF LEFT JOIN depth_ d ON c.symbol = d.symbol AND c.side = d.side AND c.ts_ms >= d.ts_ms),
    h_ AS (SELECT symbol, side, min(ts_ms) + (max(ts_ms) - min(ts_ms)) // 2 AS half FROM shocks_ GROUP BY 1, 2), q_ AS (SELECT symbol, side, list_transform([0.2, 0.4, 0.6, 0.8], lambda p: list_sort(list("before"))[cast(greatest(ceil(p * count(*)), 1) AS BIGINT)]) q FROM shocks_ JOIN h_ USING (symbol, side) WHERE ts_ms <= half GROUP BY 1, 2),
    k_ AS (SELECT id, shock, symbol || '/' || side || '/' || len(list_filter(q, lambda x: x < "before")) cell FROM shocks_ JOIN q_ USING (symbol, side)),
    m_ AS (SELECT step, cell, avg(ratio) FILTER (shock) s, avg(ratio) FILTER (NOT shock) c, count(*) FILTER (shock) k FROM r_ JOIN k_ USING (id) WHERE ratio IS NOT NULL GROUP BY 1, 2)
    SELECT step, {r6_sql('sum(s * k) / sum(k)')} AS shocks, {r6_sql('sum(c * k) / sum(k)')} AS controls, count(*) AS "cells", cast(sum(k) AS BIGINT) n FROM m_ WHERE s IS NOT NULL AND c IS NOT NULL GROUP BY 1"""
)
def refill_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth after shocks against that after other updates of the same fifth of depth; the bounds of the fifths are those of the first half of the time."""
    known = changes(spark, sf_dir)
    all_ = shocks(spark, sf_dir, known, own_depths(known), STEPS)
    half = all_.groupBy("symbol", "side").agg((F.min("ts_ms") + F.floor((F.max("ts_ms") - F.min("ts_ms")) / 2)).alias("half"))
    early = all_.join(half, ["symbol", "side"]).where(F.col("ts_ms") <= F.col("half")).groupBy("symbol", "side", "before").agg(F.count("*").alias("k"))
    w = Window.partitionBy("symbol", "side")
    # nearest-rank quantiles from the counts of distinct depths
    ranked = early.select("symbol", "side", "before", F.sum("k").over(w.orderBy("before")).alias("upto"), F.sum("k").over(w).alias("n"))
    bounds = ranked.groupBy("symbol", "side").agg(F.array(*[F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)), F.col("before"))) for p in (0.2, 0.4, 0.6, 0.8)]).alias("q"))
    cell = F.concat_ws("/", "symbol", "side", F.size(F.filter("q", lambda x: x < F.col("before"))))
    celled = all_.join(bounds, ["symbol", "side"]).select("shock", cell.alias("cell"), "before", "after")
    return rounded(queues.matched_curves(queues.refill_curves(celled, STEPS)))


SHIFTS = [*range(-60_000, 60_001, 5_000)]


@query(
    f"""{M}, lc_ AS (SELECT symbol, side, tick, ts_ms, max_by(size, u) size FROM market_changes GROUP BY 1, 2, 3, 4), s_ AS (SELECT t.symbol, t.side, t.tick, t.ts_ms + k AS ts_ms, k AS shift FROM market_trades t, (SELECT unnest({SHIFTS}) k))
    SELECT s_.symbol, shift, count(*) n, count(*) FILTER (size > 0) standing FROM s_ ASOF LEFT JOIN lc_ ON s_.symbol = lc_.symbol AND s_.side = lc_.side AND s_.tick = lc_.tick AND s_.ts_ms >= lc_.ts_ms GROUP BY 1, 2"""
)
def clock_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of trades whose price stands in the book at a grid of shifts of their clock."""
    return queues.resting_share(views.market_trades(spark, sf_dir), views.market_changes(spark, sf_dir), BY, SHIFTS)


@query()
def queue_fill_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that join the best of the side hit at every trade's time, held for a day: touched, traded through, and reached in the queue. Folded per level, so held by brute force in the tests."""
    from tidewright.operators.asof import asof

    trades, changes = views.market_trades(spark, sf_dir), views.market_changes(spark, sf_dir)
    state = book.fold_states(queues.last_of_time(changes, BY), SPAN, BY).groupBy("symbol", "ts_ms").agg(F.max_by(F.struct("bid", "ask"), "u").alias("s"))
    at = asof(trades.select("id", "symbol", "side", "ts_ms"), state.select("symbol", "ts_ms", "s.bid", "s.ask"), "symbol", "ts_ms", ["bid", "ask"])
    orders = at.select("id", "symbol", "side", F.when(F.col("side") == 1, F.col("bid")).otherwise(F.col("ask")).alias("tick"), "ts_ms").where("tick IS NOT NULL")
    orders = materialise(orders, "orders")
    return queues.queue_rules(orders, changes, trades, BY, 24 * HOUR, 1.5)


@query(
    f"""{M}, {EVENTS}, {BEST}, b1_ AS (SELECT g.symbol, g.ts_ms, g.side, g.tick, b.size FROM g_ g ASOF JOIN lc_ b ON g.symbol = b.symbol AND g.side = b.side AND g.tick = b.tick AND g.ts_ms >= b.ts_ms),
    st_ AS (SELECT symbol, ts_ms, max(tick) FILTER (side = 1) bid, min(tick) FILTER (side = -1) ask, max_by(size, tick) FILTER (side = 1) qb, min_by(size, tick) FILTER (side = -1) qa FROM b1_ WHERE size > 0 GROUP BY 1, 2),
    m_ AS (SELECT symbol, ts_ms, ts_ms // {24 * HOUR} AS "day", bid + ask mid2, (qb - qa)::DOUBLE / (qb + qa) i1 FROM st_ WHERE bid IS NOT NULL AND ask IS NOT NULL),
    n_ AS (SELECT *, CASE WHEN mid2 <> lag(mid2) OVER w THEN {{'s': sign(mid2 - lag(mid2) OVER w), 't': ts_ms}} END c FROM m_ WINDOW w AS (PARTITION BY symbol, "day" ORDER BY ts_ms)), l_ AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol, "day" ORDER BY ts_ms) v FROM n_),
    t_ AS (SELECT symbol, ts_ms, max_by(tick, id) tick FROM market_trades GROUP BY 1, 2), x_ AS (SELECT l.symbol, i1, 2 * t.tick - mid2 gap, v.s s, l.ts_ms - v.t age FROM l_ l ASOF JOIN t_ t ON l.symbol = t.symbol AND l.ts_ms >= t.ts_ms WHERE v IS NOT NULL),
    y_ AS (SELECT symbol, i1, gap, unnest(list_filter(['all', CASE WHEN s > 0 THEN 'up' END, CASE WHEN s < 0 THEN 'down' END, CASE WHEN age < {HOUR} THEN 'new' END, CASE WHEN age >= {HOUR} THEN 'old' END], lambda z: z IS NOT NULL)) slice FROM x_),
    r_ AS (SELECT symbol, slice, rank() OVER (PARTITION BY symbol, slice ORDER BY i1) + (count(*) OVER (PARTITION BY symbol, slice, i1) - 1) / 2.0 rx, rank() OVER (PARTITION BY symbol, slice ORDER BY gap) + (count(*) OVER (PARTITION BY symbol, slice, gap) - 1) / 2.0 ry FROM y_)
    SELECT symbol, slice, {r6_sql('corr(rx, ry)')} AS rho, count(*) n FROM r_ GROUP BY 1, 2"""
)
def simpson_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalance against the gap of the last trade to the mid: over all updates, after up and after down moves of the mid, and by the age of that move."""
    from tidewright.operators import flow
    from tidewright.operators.asof import asof

    changes = queues.last_of_time(views.market_changes(spark, sf_dir), BY)
    state = book.fold_states(changes, SPAN, BY).groupBy("symbol", "ts_ms").agg(F.max_by(F.struct("bid", "ask", "q_bid", "q_ask"), "u").alias("s")).select("symbol", "ts_ms", "s.*")
    mids = state.where("bid IS NOT NULL AND ask IS NOT NULL").select("symbol", "ts_ms", F.floor(F.col("ts_ms") / (24 * HOUR)).alias("day"), (F.col("bid") + F.col("ask")).alias("mid2"), book.imbalance(F.col("q_bid"), F.col("q_ask")).alias("i1"))
    w = Window.partitionBy("symbol", "day").orderBy("ts_ms")
    step = F.col("mid2") - F.lag("mid2").over(w)
    moved = mids.withColumn("c", F.when(step != 0, F.struct(F.signum(step).alias("s"), F.col("ts_ms").alias("t"))))
    last = moved.select("*", F.last("c", ignorenulls=True).over(w).alias("v")).where("v IS NOT NULL")
    trades = views.market_trades(spark, sf_dir).groupBy("symbol", "ts_ms").agg(F.max_by("tick", "id").alias("tick"))
    met = asof(last.select("symbol", "ts_ms", "mid2", "i1", F.col("v.s").alias("s"), F.col("v.t").alias("t")), trades, "symbol", "ts_ms", ["tick"]).where("tick IS NOT NULL")
    age = F.col("ts_ms") - F.col("t")
    x = met.withColumn("gap", 2 * F.col("tick") - F.col("mid2"))
    slices = {"all": F.lit(True), "up": F.col("s") > 0, "down": F.col("s") < 0, "new": age < HOUR, "old": age >= HOUR}
    return rounded(flow.sliced_spearman(x, BY, "i1", "gap", slices))
