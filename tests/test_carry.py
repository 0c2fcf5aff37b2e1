"""State carried over chunks, and functions for SQL, against loops."""

import random
from collections import deque

import pytest

from tidewright.streaming import carry

TRADES = "id long, symbol string, ts_ms long, tick long, lots long"
FILLS = "id long, symbol string, ts_ms long, side int, tick long, lots long"


def made(seed, n=240):
    rng = random.Random(seed)
    at = sorted(rng.randrange(n // 2) for _ in range(n))
    return [(i, rng.choice("ab"), t, rng.choice([1, -1]), rng.randrange(90, 110), rng.randrange(1, 9)) for i, t in enumerate(at)]


def cut(rows, ends):
    return [[r for r in rows if a <= r[2] < b] for a, b in zip([-1, *ends], [*ends, 10**9], strict=True)]


@pytest.mark.parametrize("ends", [[], [40, 41, 90], [120]])
def test_bars_over_chunks_are_those_of_one_run(spark, ends):
    rows = made(1)
    frames = [spark.createDataFrame([(i, s, t, p, n) for i, s, t, _, p, n in c], TRADES) for c in cut(rows, ends)]
    done, state = carry.in_chunks(frames, carry.lot_bars(25))
    want = {}
    for s in "ab":
        total = 0
        for i, _, t, _, p, n in (r for r in rows if r[1] == s):
            b = want.setdefault((s, total // 25), [t, t, p, p, p, p, 0, 0])
            b[1], b[3], b[4], b[5], b[6], b[7] = t, max(b[3], p), min(b[4], p), p, b[6] + n, b[7] + 1
            total += n
        assert state.where(f"symbol = '{s}'").first().total == total
    # a bar is finished once the lots reach its end
    got = {(r.symbol, r.bar): [r[c] for c in carry.BAR] for r in done.unionByName(carry.unfinished(state)).collect()}
    assert got == want
    assert carry.unfinished(state).count() <= 2


@pytest.mark.parametrize("ends", [[], [30, 60, 61], [119]])
def test_lots_over_chunks_are_matched_as_in_one_run(spark, ends):
    rows = made(2)
    done, state = carry.in_chunks([spark.createDataFrame(c, FILLS) for c in cut(rows, ends)], carry.match_lots)
    want, open_ = {}, {}
    for i, s, _, side, p, n in rows:
        line = open_.setdefault(s, deque())
        while n and line and line[0][0] != side:
            m = min(n, line[0][3])
            buy, sell = ((i, p), line[0][1:3]) if side > 0 else (line[0][1:3], (i, p))
            x = want.setdefault((s, buy[0], sell[0]), [0, 0])
            x[0], x[1] = x[0] + m, x[1] + m * (sell[1] - buy[1])
            n -= m
            line[0] = (*line[0][:3], line[0][3] - m)
            if not line[0][3]:
                line.popleft()
        if n:
            line.append((side, i, p, n))
    got = {}
    for r in done.collect():
        x = got.setdefault((r.symbol, r.buy_id, r.sell_id), [0, 0])
        x[0], x[1] = x[0] + r.lots, x[1] + r.result
    assert got == want
    assert sorted((r.symbol, r.side, r.id, r.tick, r.lots) for r in state.collect()) == sorted((s, *x) for s, line in open_.items() for x in line)


def test_streaks_and_medians_of_odd_rows(spark):
    from tidewright.functions import tables

    tables.register(spark)
    rows = [("a", d, x) for d, x in enumerate([1.0, 2.0, 3.0, 3.0, 2.0, None, 5.0, 4.0, 3.0])] + [("b", 0, 1.0), ("c", 0, None), (None, 0, 1.0), (None, 1, 2.0)]
    spark.createDataFrame(rows, "k string, d int, x double").createOrReplaceTempView("odd_steps")
    got = [tuple(r) for r in spark.sql("SELECT * FROM streaks(TABLE(odd_steps) PARTITION BY (k) ORDER BY (d), 'k', 'd', 'x')").collect()]
    assert sorted(got, key=str) == sorted([("a", 0, 2, 1, 2, 2.0), ("a", 3, 4, -1, 1, -1.0), ("a", 6, 8, -1, 2, -2.0), (None, 0, 1, 1, 1, 1.0)], key=str)
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM streaks(TABLE(odd_steps) PARTITION BY (k) ORDER BY (d), 'k', 'd', 'y')").collect()
    w = spark.sql("SELECT k, weighted_median(x, cast(d + 1 AS double)) m FROM odd_steps GROUP BY k").collect()
    assert {r.k: r.m for r in w} == {"a": 3.0, "b": 1.0, "c": None, None: 2.0}
