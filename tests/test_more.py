"""Second implementations: propagator, binomial tail, rank correlations by slice, adjusted prices."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright import registry, views
from tidewright.operators import flow, forecast, inference
from tidewright.sources import market


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (0, 1, 2, 7, 40, 999, 2500) for k in {0, n // 7, n // 2}]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", inference.binomial_tail(F.col("n"), F.col("k")))
    for r in df.collect():
        exact = sum(math.comb(r.n, i) for i in range(r.k + 1)) / 2**r.n
        assert math.isclose(r.p, exact, rel_tol=1e-9) or exact < 1e-290


def test_sign_test_beyond_the_exact_count(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1.0 if i % 5 < 3 else -1.0) for i in range(400)] + [("b", 0.0)], "k string, r double")
    exact = {r.k: r.p for r in inference.sign_test(df, ["k"], "r").collect()}
    monkeypatch.setattr(inference, "EXACT_SIGNS", 10)
    near = {r.k: r.p for r in inference.sign_test(df, ["k"], "r").collect()}
    assert exact["b"] == 1 and math.isclose(exact["a"], 2 * sum(math.comb(400, i) for i in range(161)) / 2**400, rel_tol=1e-9)
    assert math.isclose(near["a"], exact["a"], rel_tol=0.1)


def test_propagators_match_numpy_over_the_tape(spark, sf):
    t = views.tape(spark, sf).toPandas().sort_values(["symbol", "ts_ms", "id"])
    got = {(r.symbol, r.lag): r.g for r in registry.queries()["impact_propagator"](spark, sf).collect()}
    for symbol, x in t.groupby("symbol"):
        s = np.where(x.is_buyer_maker, -1.0, 1.0)
        p = x.tick.to_numpy(float)
        c = [float((s[:-k] * s[k:]).mean()) for k in range(1, 9)]
        r = [float((s[:-k] * (p[k:] - p[:-k])).mean()) for k in range(1, 9)]
        for k, g in enumerate(forecast.propagator(c, r)):
            assert math.isclose(got[symbol, k + 1], g, abs_tol=2e-6)


def test_a_correlation_that_only_the_slices_lack(spark):
    rng = np.random.default_rng(1)
    rows = [("x", float(g * 10 + a), float(g * 10 + b), g) for g in (0, 1) for a, b in rng.permutation(200).reshape(2, 100).T % 7]
    df = spark.createDataFrame(rows, "k string, x double, y double, g int")
    got = {r.slice: (r.rho, r.n) for r in flow.sliced_spearman(df, ["k"], "x", "y", {"all": F.lit(True), "low": F.col("g") == 0, "high": F.col("g") == 1}).collect()}
    assert got["all"][1] == 200 and got["low"][1] == got["high"][1] == 100
    assert got["all"][0] > 0.6 and abs(got["low"][0]) < 0.3 and abs(got["high"][0]) < 0.3


def test_adjusted_prices(spark, tmp_path):
    (tmp_path / "AB.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-01,10,12,8,10,5,100\n2020-01-02,11,11,11,11,null,1\n2020-01-03,0,0,0,0,7,\n2020-01-06,4,4,4,4,4,9\n")
    (tmp_path / "C.D.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\nbad,1,1,1,1,1,1\n2020-01-02,2,2,2,2,2,2\n")
    got = sorted(tuple(r) for r in market.adjusted_panel(spark, str(tmp_path), end="2020-01-06").select("asset", F.col("date").cast("string"), "open", "high", "low", "close", "volume").collect())
    assert got == [("AB", "2020-01-01", 5.0, 6.0, 4.0, 5.0, 100.0), ("AB", "2020-01-03", None, None, None, 7.0, None), ("C.D", "2020-01-02", 2.0, 2.0, 2.0, 2.0, 2.0)]
    assert market.adjusted_panel(spark, str(tmp_path), "2020-01-03").count() == 2


@pytest.mark.parametrize("name", ["embedding_spectrum", "correlation_spectra"])
def test_spectra_match_numpy(spark, sf, name):
    from tidewright.operators import risk
    from tidewright.plans import selection

    pairs = (selection.embedding_pairs if name == "embedding_spectrum" else selection.yearly)(spark, sf).toPandas()
    got = registry.queries()[name](spark, sf).toPandas().set_index("y")
    assert len(got)
    for y, part in pairs.groupby("y"):
        names, c = risk.matrix(part, "corr")
        if len(names) < 2:
            continue
        v = np.linalg.eigvalsh(c)[::-1]
        row, edge = got.loc[y], (1 + math.sqrt(len(c) / part.n.min())) ** 2
        assert row.n_assets == len(c) and row.above_edge == (v > edge).sum()
        assert math.isclose(row.largest, v[0], abs_tol=2e-6) and math.isclose(row.effective_n, v.sum() ** 2 / (v**2).sum(), abs_tol=1e-5)


def test_ranks_of_values_match_a_sort_of_all_rows_and_no_window_holds_a_key(spark):
    rng = random.Random(12)
    for most in (6, 100_000):  # many ties; more values than pieces
        made = [(rng.choice("ab"), float(x := rng.randrange(most)), x // 2 + rng.randrange(most)) for _ in range(1200)]
        found = flow.spearman(spark.createDataFrame(made, "k string, x double, y long"), ["k"], "x", "y")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # a window over (key, value) or over (key) alone would hold every row of a key
        assert "__piece" in plan and "rank(" not in plan
        for r in found.collect():
            x, y = (np.array([m[i] for m in made if m[0] == r.k], float) for i in (1, 2))
            rank = lambda v: np.searchsorted(np.sort(v), v) + np.searchsorted(np.sort(v), v, "right")
            assert r.n == len(x) and abs(r.rho - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-12
