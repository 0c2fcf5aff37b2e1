"""Queues of books against plain replays, event by event."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import book, queues, ranges

CHANGES = "symbol string, ts_ms long, u long, side int, tick long, size long"
TRADES = "id long, symbol string, ts_ms long, side int, tick long, size long"
ORDERS = "id long, symbol string, side int, tick long, ts_ms long"


def market(seed, n=500, end=4000):
    rng = random.Random(seed)
    at = sorted(rng.randrange(end) for _ in range(n))
    changes, trades = [], []
    for u, t in enumerate(at):
        s = rng.choice([1, -1])
        changes.append((rng.choice("AB"), t, u, s, 100 - s * rng.randrange(1, 4), rng.choice([0, 0, *range(1, 30)])))
    for i in range(n // 2):
        s = rng.choice([1, -1])
        trades.append((i, rng.choice("AB"), rng.randrange(end), s, 100 - s * rng.randrange(1, 4), rng.randrange(1, 15)))
    return changes, trades


def level(changes, key):
    """(time, size) of a level, the last change of each time."""
    last = {}
    for c in sorted(changes, key=lambda c: c[2]):
        if (c[0], c[3], c[4]) == key:
            last[c[1]] = c[5]
    return sorted(last.items())


def plain_order(order, changes, trades, hold, power):
    """(ahead, q0, q1, q2) of one order, replayed."""
    _, sym, side, p, t0 = order
    mine = [(t, z) for _, s, t, sd, k, z in trades if (s, sd, k) == (sym, side, p)]
    worse = sorted(t for _, s, t, sd, k, _ in trades if (s, sd) == (sym, side) and t0 < t <= t0 + hold and (k - p) * side < 0)
    touch = sorted(t for _, s, t, sd, k, _ in trades if (s, sd) == (sym, side) and t0 < t <= t0 + hold and (k - p) * side <= 0)
    path = level(changes, (sym, side, p))
    known = [(t, z) for t, z in path if t <= t0]
    since, shown = known[-1] if known else (t0, 0)
    gone = sum(z for t, z in mine if since < t <= t0)
    ahead, whole = max(shown - gone, 0.0), float(shown - gone)
    front, reached = ahead, None
    events = sorted([(t, 0, i, z) for i, (t, z) in enumerate(mine) if t0 < t <= t0 + hold] + [(t, 1, 0, z) for t, z in path if t0 < t <= t0 + hold], key=lambda e: e[:2])
    # trades of one time are applied in one order by both
    for t, kind, _, z in events:
        if kind == 0:
            if z > front:
                reached = t
                break
            front, whole = front - z, whole - z
        else:
            lost = max(whole - z, 0.0)
            if lost > 0:
                x = min(front / max(whole, 1e-12), 1.0)
                behind = ((1 - x**power) if math.isfinite(power) else 1.0) * lost if x < 1 else 0.0
                behind = min(behind, max(whole - front, 0.0))
                front = max(front - (lost - behind), 0.0)
            whole = z
    q1 = worse[0] if worse else None
    q2 = min((x for x in (q1, reached) if x is not None), default=None)
    return ahead, touch[0] if touch else None, q1, q2


@pytest.mark.parametrize(("power", "hold"), [(1.0, 700), (2.0, 150), (math.inf, 5000)])
def test_fill_rules_match_a_replay(spark, power, hold):
    changes, trades = market(int(hold))
    # one trade a time and level, so that no order of equal times matters
    trades = list({(t[1], t[2], t[3], t[4]): t for t in trades}.values())
    rng = random.Random(9)
    orders = [(i, rng.choice("AB"), s := rng.choice([1, -1]), 100 - s * rng.randrange(1, 5), rng.randrange(-50, 4000)) for i in range(250)]
    got = queues.queue_rules(spark.createDataFrame(orders, ORDERS), spark.createDataFrame(changes, CHANGES), spark.createDataFrame(trades, TRADES), ["symbol"], hold, power, 16)
    for r in got.collect():
        ahead, q0, q1, q2 = plain_order((r.id, r.symbol, r.side, r.tick, r.ts_ms), changes, trades, hold, power)
        assert (r.ahead, r.q0_ms, r.q1_ms, r.q2_ms) == (ahead, q0, q1, q2)
    assert got.where("q2_ms IS NOT NULL AND (q1_ms IS NULL OR q2_ms < q1_ms)").count() > 0


def test_an_order_waits_for_what_stands_ahead(spark):
    changes = [("A", 0, 1, 1, 99, 10), ("A", 30, 2, 1, 99, 6), ("A", 50, 3, 1, 99, 20)]
    trades = [(1, "A", 20, 1, 99, 2), (2, "A", 60, 1, 99, 5), (3, "A", 70, 1, 99, 2)]
    # 10 ahead, 2 traded, of 8 all ahead 2 more cancelled: 6; then 14 join behind, 5 trade, and the last trade is larger than the 1 left
    r = queues.queue_rules(spark.createDataFrame([(7, "A", 1, 99, 10)], ORDERS), spark.createDataFrame(changes, CHANGES), spark.createDataFrame(trades, TRADES), ["symbol"], 1000).first()
    assert (r.ahead, r.q0_ms, r.q1_ms, r.q2_ms) == (10.0, 20, None, 70)


def test_level_events_match_a_replay(spark):
    changes, trades = market(3)
    got = {(r.symbol, r.side, r.tick, r.ts_ms): (r.old, r["size"], r.hit, r.added, r.traded, r.cancelled) for r in queues.level_events(spark.createDataFrame(changes, CHANGES), spark.createDataFrame(trades, TRADES), ["symbol"], 600).collect()}
    n = 0
    for sym in "AB":
        times = sorted({c[1] for c in changes if c[0] == sym})
        for side in (1, -1):
            for tick in range(95, 106):
                old = 0
                for t, size in level(changes, (sym, side, tick)):
                    before = max((x for x in times if x < t), default=None)
                    hit = 0 if before is None else sum(z for _, s, tt, sd, k, z in trades if (s, sd, k) == (sym, side, tick) and before < tt <= t)
                    less = max(old - size, 0)
                    assert got[sym, side, tick, t] == (old, size, hit, max(size - old, 0), min(less, hit), less - min(less, hit))
                    old, n = size, n + 1
    assert len(got) == n


def test_refills_of_hand_cases(spark):
    events = [
        ("A", 1, 99, 0, 10, 0, 0), ("A", 1, 99, 10, 0, 10, 9), ("A", 1, 99, 500, 11, 0, 0),  # eaten away and back in time
        ("A", 1, 99, 600, 10, 11, 10),  # eaten and full again at once
        ("A", 1, 99, 700, 0, 10, 1), ("A", 1, 99, 800, 10, 0, 0),  # cancelled away: no refill
        ("A", 1, 99, 900, 0, 10, 10), ("A", 1, 99, 9900, 10, 0, 0),  # too late
        ("A", 1, 99, 9950, 0, 10, 10), ("A", 1, 99, 9960, 5, 0, 0),  # too small
    ]
    rows = [(s, sd, k, t, z, old, hit, max(z - old, 0)) for s, sd, k, t, z, old, hit in events]
    df = spark.createDataFrame(rows, "symbol string, side int, tick long, ts_ms long, size long, old long, hit long, added long")
    found = queues.refills(df, ["symbol"], 1000)
    assert sorted(r.ts_ms for r in found.collect()) == [500, 600]
    chains = queues.refill_chains(found, ["symbol"], 200, 2).collect()
    assert [(c.start_ms, c.end_ms, c.refills) for c in chains] == [(500, 600, 2)]
    assert queues.refill_chains(found, ["symbol"], 50, 2).count() == 0


def test_short_lived_orders_match_a_replay(spark):
    changes, trades = market(5)
    c, t = spark.createDataFrame(changes, CHANGES), spark.createDataFrame(trades, TRADES)
    events = queues.level_events(c, t, ["symbol"])
    got = {(r.symbol, r.side, r.tick, r.ts_ms): (r.added, r.off, r.life_ms, r.traded) for r in queues.short_lived(events, queues.best_before(c, ["symbol"], 1000), ["symbol"], 8, 600, 40).collect()}
    rows = [tuple(r) for r in events.select("symbol", "side", "tick", "ts_ms", "size", "old", "hit", "added").collect()]
    seen = 0
    for sym, side, tick, ts, _, old, _, added in rows:
        if added < 8:
            continue
        standing = [k for k in range(95, 106) for p in [level(changes, (sym, side, k))] if (before := [z for x, z in p if x < ts]) and before[-1] > 0]
        if not standing:
            continue
        off = abs(tick - (max(standing) if side == 1 else min(standing)))
        if not 1 <= off <= 9:
            continue
        later = sorted((x[3], x[4], x[6]) for x in rows if x[:3] == (sym, side, tick) and ts < x[3] <= ts + 600)
        gone = next((x for x, z, _ in later if 100 * z <= 100 * old + 20 * added), None)
        hit = next((x for x, _, h in later if h >= 1), None)
        assert got[sym, side, tick, ts] == (added, off, None if gone is None else gone - ts, hit is not None and hit <= (ts + 600 if gone is None else gone))
        seen += 1
    assert seen == len(got) > 20


def test_books_of_two_symbols_stay_apart(spark):
    from pyspark.sql import functions as F

    from tidewright.operators import book

    changes, _ = market(6)
    one = spark.createDataFrame(changes, CHANGES)
    both = {(r.symbol, r.u): tuple(r)[1:] for r in book.fold_states(one, 500, ["symbol"]).collect()}
    apart = {}
    for s in "AB":
        apart |= {(s, r.u): tuple(r) for r in book.fold_states(one.where(F.col("symbol") == s).drop("symbol"), 500).collect()}
    assert both == apart


def test_clock_shift_is_found(spark):
    """Trades stamped 40 ms late hit levels that stand just before them."""
    rng = np.random.default_rng(1)
    changes, trades, t = [], [], 0
    for i in range(400):
        t += 200
        tick = int(rng.integers(90, 110))
        changes += [("A", t, 2 * i, 1, tick, 5), ("A", t + 30, 2 * i + 1, 1, tick, 0)]
        trades.append((i, "A", t + 55, 1, tick, 5))
    got = queues.resting_share(spark.createDataFrame(trades, TRADES), spark.createDataFrame(changes, CHANGES), ["symbol"], [-80, -40, 0, 40], 5000).collect()
    assert {r.shift: r.standing for r in got} == {-80: 0, -40: 400, 0: 0, 40: 0}


def test_live_books_match_a_replay_over_the_table(spark, sf):
    from tidewright import registry, views

    rows = {}
    for r in views.book_deltas(spark, sf, ["event_type"]).where("u % 1000 <> 500").collect():
        rows.setdefault(r.event_type, []).append(r)
    want = set()
    for symbol, changes in rows.items():
        levels, last, valid = {}, -1, False
        for c in sorted(changes, key=lambda c: c.u):
            if c.u % 1000 == 1:
                levels, valid = {}, True
            elif not valid or c.u != last + 1:
                valid = False
            last = c.u
            if not valid:
                want.add((symbol, c.u, c.ts_ms, None, None, False))
                continue
            levels[c.side, c.tick] = c["size"]
            best = {s: [s * t for (side, t), x in levels.items() if side == s and x > 0] for s in (1, -1)}
            want.add((symbol, c.u, c.ts_ms, max(best[1], default=None), -max(best[-1]) if best[-1] else None, True))
    got = [tuple(r) for r in registry.queries()["stream_book"](spark, sf).collect()]
    assert set(got) == want and len(got) == len(want)


def test_depths_around_updates_match_a_replay(spark):
    rng = random.Random(4)
    depth = [(s, sd, t, rng.randrange(1, 50)) for s in "AB" for sd in (1, -1) for t in sorted(rng.sample(range(0, 9000), 60)) if not 3000 < t < 6000]
    updates = [(s, sd, t) for s in "AB" for sd in (1, -1) for t in rng.sample(range(-50, 12000), 80)]
    steps = [0, 40, 700]
    d = spark.createDataFrame(depth, "symbol string, side int, ts_ms long, depth long")
    # spans of 900 ms, so values are older than many spans and steps end in the next
    names = {"before": -1, **{f"s{k}": k for k in steps}}
    got = ranges.asof_steps(spark.createDataFrame(updates, "symbol string, side int, ts_ms long"), d, ["symbol", "side"], "ts_ms", "depth", names, 900).collect()
    last = lambda s, sd, t: max(((x[2], x[3]) for x in depth if x[:2] == (s, sd) and x[2] <= t), default=(None, None))[1]
    assert sorted((r.symbol, r.side, r.ts_ms) for r in got) == sorted(updates)
    for r in got:
        assert [r[c] for c in names] == [last(r.symbol, r.side, r.ts_ms + k) for k in names.values()]
    wide = queues.depth_around(spark.createDataFrame(updates, "symbol string, side int, ts_ms long"), d, ["symbol"], steps).collect()
    known = {(s, sd, t): last(s, sd, t - 1) for s, sd, t in updates if last(s, sd, t - 1) is not None}
    assert {(r.symbol, r.side, r.ts_ms): r.before for r in wide} == known
    assert all(r.after == [last(r.symbol, r.side, r.ts_ms + k) for k in steps] for r in wide)


def test_refill_curves_look_every_depth_up_in_one_pass(spark):
    """Rows do not go through a join on their ids, nor once for each step through an as-of join."""
    d = spark.createDataFrame([("A", 1, t, 5 + t % 7) for t in range(0, 4000, 10)], "symbol string, side int, ts_ms long, depth long")
    found = queues.depth_around(d.select("symbol", "side", "ts_ms"), d, ["symbol"], [10, 20, 30, 40])
    curves = queues.refill_curves(found.select("before", "after", F.lit(True).alias("shock"), F.lit("c").alias("cell")), [10, 20, 30, 40])
    plan = curves._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    assert curves.where("ratio IS NOT NULL").count() == 4 * 399


def test_a_span_of_a_book_goes_through_many_batches(spark):
    """Spans longer and shorter than a batch fold alike: no group of rows is held whole."""
    changes, _ = market(8)
    one = spark.createDataFrame(changes, CHANGES)
    want = sorted(tuple(r) for r in book.fold_states(one, 10_000, ["symbol"]).collect())
    plan = book.fold_states(one, 10_000, ["symbol"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for ms in (10_000, 300, 11):
            assert sorted(tuple(r) for r in book.fold_states(one, ms, ["symbol"]).collect()) == want
        got = queues.depth_around(one.select("symbol", "side", "ts_ms"), one.groupBy("symbol", "side", "ts_ms").agg({"size": "max"}).toDF("symbol", "side", "ts_ms", "depth"), ["symbol"], [100])
        small = sorted(map(str, got.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert small == sorted(map(str, got.collect()))
