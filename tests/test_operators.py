import json
import math
import random
import statistics

import numpy as np

from pyspark.sql import functions as F

from tidewright.functions import normal
from tidewright.operators import asof, inference, scalars, tape
from tidewright.operators.skew import split_join
from tidewright.sources import market
from tidewright.sources.feed import FeedSource
from tidewright.streaming import bars


def rows(df):
    return [tuple(r) for r in df.collect()]


TAPE = "id long, symbol string, ts_ms long, tick long, lots long, is_buyer_maker boolean"


def test_bars_of_the_hand_case(spark):
    ts, price = [30_000, 60_000, 60_500, 119_999, 120_000], [5, 10, 12, 9, 7]
    t = spark.createDataFrame([(i, "x", a, b, 1, False) for i, (a, b) in enumerate(zip(ts, price, strict=True))], TAPE)
    got = tape.time_bars(t, 60_000).where("bar = 60000").first()
    assert (got.open, got.high, got.low, got.close, got.trades) == (10, 12, 9, 9, 3)


def test_as_of_joins(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 5)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 15, 2.0), ("b", 6, 9.0)], "k string, t long, v double")
    of = lambda **kw: {r.id: r.v for r in asof.asof(left, right, "k", "t", ["v"], **kw).collect()}
    assert of() == {1: 1.0, 2: 2.0, 3: None}
    assert of(strict=True) == {1: None, 2: 2.0, 3: None}
    assert of(tolerance=2) == {1: 1.0, 2: None, 3: None}
    assert of(forward=True) == {1: 1.0, 2: None, 3: 9.0}
    assert of(forward=True, strict=True) == {1: 2.0, 2: None, 3: 9.0}


def test_split_join_keeps_every_row(spark):
    left = spark.range(10_000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    got = split_join(left, right, ["k"], "n", 10_000)
    assert got.count() == 10_000 and got.select("id").distinct().count() == 10_000 and got.where("k = 0 AND n <> 4000").count() == 0


def test_normal_distribution(spark):
    xs = [-5.0, -1.0, 0.0, 0.3, 2.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", normal.cdf(F.col("x")).alias("p"), normal.inverse(normal.cdf(F.col("x"))).alias("y")).collect():
        assert abs(r.p - statistics.NormalDist().cdf(r.x)) < 1e-7
        assert abs(r.y - r.x) < 0.05 if abs(r.x) > 4 else abs(r.y - r.x) < 1e-5


def test_logit_and_smile_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "x double, y int")
    b = np.zeros(2)
    design = np.stack([np.ones(500), x], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ b))
        b += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y - p))
    got = {r.term: r.coefficient for r in inference.logit(df, "y", ["x"]).collect()}
    assert math.isclose(got["intercept"], b[0], abs_tol=1e-8) and math.isclose(got["x"], b[1], abs_tol=1e-8)
    z = 1 + 2 * x - 0.5 * x * x + rng.normal(size=500) * 0.1
    fit = inference.smile(spark.createDataFrame([(float(a), float(c)) for a, c in zip(x, z, strict=True)], "x double, z double"), "z", "x").first()
    want = np.polyfit(x, z, 2)[::-1]
    assert np.allclose([fit.b0, fit.b1, fit.b2], want, atol=1e-8) and fit.r2 > 0.99


def test_deflated_sharpe_needs_more_than_luck(spark):
    rng = np.random.default_rng(5)
    luck = [(f"s{i}", float(v)) for i in range(20) for v in rng.normal(size=250)]
    skill = [*luck, *(("good", float(v)) for v in rng.normal(0.5, 1, 250))]
    assert inference.deflated_sharpe(spark.createDataFrame(luck, "stream string, r double")).first().dsr < 0.95
    best = inference.deflated_sharpe(spark.createDataFrame(skill, "stream string, r double")).first()
    assert best.stream == "good" and best.dsr > 0.95


def test_draws_are_the_same_in_sql():
    import duckdb

    assert duckdb.connect().execute(f"SELECT {inference.draw_sql('3', '7')}").fetchone()[0] >= 0


BOOK = "symbol string, u long, ts_ms long, snap boolean, side int, tick long, size double"


def test_book_needs_a_snapshot_and_ids_that_follow(spark):
    changes = [
        ("x", 4, 1, False, 1, 99, 1.0),  # before the first snapshot
        ("x", 5, 2, True, 1, 100, 2.0),
        ("x", 5, 2, True, -1, 101, 2.0),
        ("x", 6, 3, False, 1, 100, 0.0),  # size 0 removes
        ("x", 8, 4, False, 1, 98, 1.0),  # an id is missing
        ("x", 9, 5, True, -1, 105, 1.0),  # the snapshot repairs
    ]
    got = rows(bars.replay(spark, spark.createDataFrame(changes, BOOK), bars.live_book).orderBy("u", "ts_ms", F.col("ask").asc_nulls_first()))
    assert [(r[1], r[3], r[4], r[5]) for r in got] == [(4, None, None, False), (5, 100, None, True), (5, 100, 101, True), (6, None, 101, True), (8, None, None, False), (9, None, 105, True)]


def test_stream_equals_batch_over_several_batches(spark):
    t = spark.createDataFrame([(i, "x", i * 1000, i, 1, False) for i in range(1000)], TAPE)
    one = bars.replay(spark, t, bars.live_bars).count()
    assert one == 0  # the watermark closes no hour of 1,000 seconds
    short = bars.replay(spark, t, lambda s: bars.live_bars(s, "1 minute", "1 minute"))
    batch = tape.time_bars(t, 60_000).where("bar + 60000 <= 999000 - 60000")
    assert sorted(r.trades for r in short.collect()) == sorted(r.trades for r in batch.collect())


def test_decisions_are_sent_once(spark):
    schema = "label string, ts_ms long, price_ms long, healthy boolean"
    batch = spark.createDataFrame([("h1", 10, 9, True), ("h1", 11, 9, True), ("h2", 12, 9, False), ("h3", 9_000_000, 1, True), ("h4", 13, 12, True)], schema)
    done = spark.createDataFrame([("h4",)], "label string")
    assert [(r.label, r.ts_ms) for r in bars.decide_once(batch, done).collect()] == [("h1", 10)]


def test_upserts_survive_replays(spark, tmp_path):
    write = bars.upsert_sink(spark, f"{tmp_path}/t", ["k"], "t")
    a = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, t long, v string")
    b = spark.createDataFrame([(1, 2, "c")], "k long, t long, v string")
    write(a, 0)
    write(b, 1)
    write(b, 1)
    assert sorted(rows(bars.read_upserts(spark, f"{tmp_path}/t", ["k"], "t"))) == [(1, 2, "c"), (2, 1, "b")]


def test_macro_and_vintages(spark, tmp_path):
    (tmp_path / "m.csv").write_text("DATE,VALUE\n2020-01-01,1.5\n2020-02-01,.\n")
    got = market.macro_series(spark, {"cpi": f"{tmp_path}/m.csv"})
    assert [r[2] for r in sorted(rows(got))] == [1.5, None]
    sheet = spark.createDataFrame([("1998-01", "1.0", None), ("1998-02", "2.0", "2.1")], "month string, 98M11 string, 04M02 string")
    v = sorted((r.month, str(r.available), r.value) for r in market.vintages(sheet, "month").collect())
    assert v == [("1998-01", "1998-11-16", 1.0), ("1998-02", "1998-11-16", 2.0), ("1998-02", "2004-02-16", 2.1)]


def test_archives_with_and_without_header(spark, tmp_path):
    body = "1,10.5,2,1,1,1000,true\n2,11.5,1,2,2,2000,false\n"
    head = "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n"
    for i, text in enumerate((body, head + body)):
        (tmp_path / f"{i}.csv").write_text(text)
        assert market.archive_to_parquet(spark, f"{tmp_path}/{i}.csv", f"{tmp_path}/p{i}") == {"read": 2, "written": 2}
        assert spark.read.parquet(f"{tmp_path}/p{i}").agg(F.sum("price")).first()[0] == 22.0


def test_book_messages_and_trades(spark):
    lines = [json.dumps({"ts": 5, "type": "snapshot", "data": {"u": 1, "seq": 2, "b": [["10.1", "3"]], "a": []}}), json.dumps({"ts": 6, "cts": 4, "type": "delta", "data": {"u": 2, "seq": 3, "b": [], "a": [["10.3", "0"]]}})]
    got = rows(market.book_messages(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("u"))
    assert got == [(5, 5, 1, 2, 1, 1, 101, 3.0), (6, 4, 2, 3, 0, -1, 103, 0.0)]
    raw = spark.createDataFrame([("1.5", "Buy", "10.2", "3", "x")], "timestamp string, side string, price string, size string, id string")
    assert rows(market.typed_trades(raw)) == [(1500, 1, 102, 3.0, "x", None)]


def test_top_up_and_cache(spark):
    saved = spark.createDataFrame([(0, 1.0), (60_000, 2.0)], "ts long, close double")
    fresh = spark.createDataFrame([(60_000, 3.0), (120_000, 4.0), (180_000, 5.0)], "ts long, close double")
    assert sorted(rows(market.top_up(saved, fresh, 200_000))) == [(0, 1.0), (60_000, 3.0), (120_000, 4.0)]
    cache = spark.createDataFrame([("a", 1)], "asset string, close long")
    more = spark.createDataFrame([("a", 9), ("b", 2)], "asset string, close long")
    panel, missing = market.cached_panel(cache, more, ["a", "b", "c"])
    assert sorted(rows(panel)) == [("a", 1), ("b", 2)] and missing == ["c"]


def test_secrets_are_scrubbed(spark):
    df = spark.createDataFrame([("key=abc signature=f00&x=1",)], "t string")
    assert df.select(market.scrub(F.col("t"), ["abc"])).first()[0] == "key=*** signature=***&x=1"


def test_migrations_run_once(spark, tmp_path):
    steps = [(1, "CREATE OR REPLACE TEMP VIEW migrated AS SELECT 1 AS x"), (2, "SELECT 1")]
    assert market.migrate(spark, steps, f"{tmp_path}/v") == [1, 2]
    assert market.migrate(spark, [*steps, (3, "SELECT 2")], f"{tmp_path}/v") == [3]


def test_written_parts_are_read_by_window(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 2).alias("p"), F.col("id").alias("cts"))
    market.write_parts(df, f"{tmp_path}/w", ["p"], "cts")
    assert market.window_read(spark, f"{tmp_path}/w", 10, 20).count() == 10


def test_feed_source(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    lines = "\n".join([json.dumps({"ts": 1, "type": "trade", "data": [1]}), "not json", json.dumps({"ts": 3, "type": "book", "data": {}})])
    got = rows(spark.read.format("recorded_feed").option("lines", lines).load().orderBy("n"))
    assert [r[2] for r in got] == ["trade", None, "book"]


def test_calendar(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-12-31')) d")
    assert days.where(scalars.expiry_kind(F.col("d")) == "quarterly").count() == 4
    assert days.where(scalars.us_summer_time(F.col("d"))).agg(F.min("d"), F.max("d")).first() == (__import__("datetime").date(2024, 3, 10), __import__("datetime").date(2024, 11, 2))


def test_holes_are_accounted_for(spark):
    seq = spark.createDataFrame([("x", i, i * 10) for i in (1, 2, 5, 6, 10)], "symbol string, seq long, ts_ms long")
    found = tape.holes(seq)
    assert sorted((r.from_id, r.to_id, r.n) for r in found.collect()) == [(2, 5, 2), (6, 10, 3)]
    patches = spark.createDataFrame([("x", 3, 30), ("x", 4, 40), ("x", 7, 70)], "symbol string, seq long, ts_ms long")
    assert {r.from_id: r.status for r in tape.patch_accounting(found, patches).collect()} == {2: "filled", 6: "partly filled"}



def test_inverse_contract(spark):
    df = spark.createDataFrame([(10_000.0, 50_000.0, 55_000.0)], "a double, p double, q double")
    assert abs(df.select(scalars.inverse_pnl(F.col("a"), F.col("p"), F.col("q"))).first()[0] - 10_000 * (1 / 50_000 - 1 / 55_000)) < 1e-12


def test_least_squares_matches_numpy(spark):
    from tidewright.operators import forecast

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    fit = forecast.least_squares(df, "y", ["a", "b"])
    want = np.linalg.lstsq(np.c_[np.ones(300), x], y, rcond=None)[0]
    assert np.allclose([fit["intercept"], fit["a"], fit["b"]], want, atol=1e-8) and fit["r2"] > 0.99
    assert forecast.least_squares(df.where("a > 1e9"), "y", ["a"]) == {}


def test_propagator_of_uncorrelated_signs_is_the_response():
    from tidewright.operators import forecast

    assert np.allclose(forecast.propagator([0.0, 0.0, 0.0], [1.0, 0.8, 0.7]), [1.0, 0.8, 0.7])


def test_long_only_moves_are_exploded_forwards(spark):
    from tidewright.operators import forecast

    t = spark.createDataFrame([(1, "x", 0, 120, 1, False), (2, "x", 1, 230, 1, False), (3, "x", 2, 90, 1, True)], TAPE)
    got = sorted((r.level, r.up) for r in forecast.level_visits(t, 50).collect())
    assert got == [(100, False), (150, True), (200, True)]


def test_scratch_is_this_applications_own(spark):
    from tidewright.session import materialise, scratch

    assert spark.sparkContext.applicationId in scratch(spark, "x")
    assert materialise(spark.range(3), "three").count() == 3


def test_feed_source_reads_files(spark, tmp_path):
    from tidewright.sources.feed import FILE

    (tmp_path / "a.jsonl").write_text('{"ts": 1, "type": "trade", "data": 5}\nbroken\n')
    (tmp_path / "b.jsonl").write_text('{"ts": 2, "type": "book", "data": null}\n')
    spark.dataSource.register(FeedSource)
    got = spark.read.format("recorded_feed").load(str(tmp_path)).orderBy("n").collect()
    assert [(r.n, r.ts_ms, r.type) for r in got] == [(0, 1, "trade"), (1, 0, None), (FILE, 2, "book")]


def test_regression_on_several_columns(spark):
    from tidewright.operators import inference

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    e = np.convolve(rng.normal(size=303), [1, 0.5, 0.2, 0.1], "valid")
    y = 0.5 + x @ [1.0, -2.0] + e
    df = spark.createDataFrame([(k, float(y[k]), float(x[k, 0]), float(x[k, 1])) for k in range(300)], "date long, y double, a double, b double")
    got = {r.name: r for r in inference.ols_several(df, "y", ["a", "b"], 3).collect()}
    X = np.column_stack([np.ones(300), x])
    inverse = np.linalg.inv(X.T @ X)
    beta = inverse @ X.T @ y
    s = X * (y - X @ beta)[:, None]
    meat = s.T @ s + sum((1 - d / 4) * (s[d:].T @ s[:-d] + s[:-d].T @ s[d:]) for d in (1, 2, 3))
    t = beta / np.sqrt(np.diag(inverse @ meat @ inverse))
    assert np.allclose([got[n].coef for n in ("intercept", "a", "b")], beta) and np.allclose([got[n].t for n in ("intercept", "a", "b")], t)
    assert inference.ols_several(df.limit(2), "y", ["a", "b"]).count() == 0


def test_a_print_exactly_at_the_bound_is_flagged_in_whatever_order_the_rows_before_stand(spark):
    rng, base = random.Random(4), [1003 + d for d in (7, -7, 7, -7, *[0] * 46)]  # median 1003, deviation exactly 2
    made = [(i, f"s{k}", i, x, 1, False) for k in range(40) for i, x in enumerate([*rng.sample(base, 50), 1007 if k % 2 else 999])]
    short = [(i, "near", i, x, 1, False) for i, x in enumerate([*base, 1006])]
    got = tape.spikes(spark.createDataFrame(made + short, TAPE), least=0.001, sds=2.0)
    assert sorted((r.symbol, r.id, r.jump, r.kind) for r in got.collect()) == sorted((f"s{k}", 50, 4.0 if k % 2 else -4.0, "jump") for k in range(40))
