"""Range aggregates and first passages against loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import ranges

ROWS = "k string, t long, v long"


def made(seed, n, keys="ab", most=4000):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.randrange(-most // 4, most), rng.randrange(-50, 50)) for _ in range(n)]


@pytest.mark.parametrize("leaf", [1, 7, 400])
def test_ranges_match_loops(spark, leaf):
    rng = random.Random(leaf)
    rows = made(1, 600)
    asked = [(i, rng.choice("abc"), s := rng.randrange(-1200, 4200), s + rng.choice([0, 1, 5, 60, 900, 5000])) for i in range(300)]
    r = spark.createDataFrame(asked, "id long, k string, s long, e long")
    x = spark.createDataFrame(rows, ROWS).withColumn("n", F.lit(1).cast("long"))
    sums = {g.id: (g.n, g.v) for g in ranges.range_sums(r, x, "k", "t", "s", "e", ["n", "v"], span=500).collect()}
    ends = {g.id: (g.lo, g.hi) for g in ranges.range_extremes(r, x, "k", "t", "s", "e", "v", leaf, 900).collect()}
    for i, k, s, e in asked:
        inside = [v for kk, t, v in rows if kk == k and s <= t < e]
        assert sums[i] == (len(inside), sum(inside))
        assert ends.get(i) == ((min(inside), max(inside)) if inside else None)


@pytest.mark.parametrize(("leaf", "within"), [(1, 900), (5, 900), (64, 3000), (5000, 100)])
def test_first_passage_matches_a_loop(spark, leaf, within):
    rng = random.Random(within)
    rows = made(2, 700)
    asked = [(i, rng.choice("abc"), rng.randrange(-1200, 4200), rng.choice([None, *range(-52, 53)]), rng.random() < 0.5) for i in range(400)]
    p = spark.createDataFrame(asked, "id long, k string, t long, lim long, up boolean")
    got = {g.id: g.passed for g in ranges.first_passage(p, spark.createDataFrame(rows, ROWS), ["k"], "t", "lim", "v", F.col("up"), within, leaf).collect()}
    for i, k, t0, lim, up in asked:
        hits = [] if lim is None else [t for kk, t, v in rows if kk == k and t0 < t <= t0 + within and (v >= lim if up else v <= lim)]
        assert got.get(i) == (min(hits) if hits else None)


def test_ranges_of_empty_tables(spark):
    x = spark.createDataFrame([], ROWS)
    r = spark.createDataFrame([(1, "a", 0, 9)], "id long, k string, s long, e long")
    assert [tuple(g) for g in ranges.range_sums(r, x, "k", "t", "s", "e", ["v"]).collect()] == [(1, 0)]
    assert ranges.range_extremes(r, x, "k", "t", "s", "e", "v", 3, 9).count() == 0
    assert ranges.range_sums(r.limit(0), x, "k", "t", "s", "e", ["v"]).count() == 0


def test_many_rows_of_one_leaf_meet_no_pairs(spark):
    """Points and rows that all fall into one block of time: found by a tree in one task, without a join of each point with each row."""
    rng = random.Random(8)
    at = rng.sample(range(5000), 1500)
    rows = spark.createDataFrame([("a", t, t % 89) for t in at], ROWS)
    asked = [(i, "a", rng.randrange(5000), rng.choice([*range(90)]), rng.random() < 0.5) for i in range(1500)]
    found = ranges.first_passage(spark.createDataFrame(asked, "id long, k string, t long, lim long, up boolean"), rows, ["k"], "t", "lim", "v", F.col("up"), 5000, 10_000)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {g.id: g.passed for g in found.collect()}
    for i, _, t0, lim, up in asked:
        assert got.get(i) == min((t for t in at if t0 < t and (t % 89 >= lim if up else t % 89 <= lim)), default=None)
    spans = spark.createDataFrame([(i, "a", t, t + 900) for i, t in enumerate(at)], "id long, k string, s long, e long")
    most = ranges.range_extremes(spans, rows, "k", "t", "s", "e", "v", 10_000, 900)
    assert "Join" not in most._jdf.queryExecution().executedPlan().toString()
    assert {g.id: (g.lo, g.hi) for g in most.collect()} == {i: (min(inside), max(inside)) for i, s in enumerate(at) if (inside := [t % 89 for t in at if s <= t < s + 900])}
