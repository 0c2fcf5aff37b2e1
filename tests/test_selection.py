"""Fitted and carried matrices: conditions of optimality, and second implementations over whole tables."""

import datetime
import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tidewright import registry
from tidewright.operators import risk, selection


def correlated(seed, n, rows, factor=0.6):
    x = np.random.default_rng(seed).standard_normal((rows, n))
    x += factor * x[:, :1]
    return np.corrcoef(x.T), x


def test_graphical_lasso_meets_its_conditions():
    s, _ = correlated(1, 8, 60)
    for penalty in (0.01, 0.1, 0.3):
        w, p = selection.graphical_lasso(s, penalty)
        np.testing.assert_allclose(w @ p, np.eye(8), atol=1e-5)
        off = ~np.eye(8, dtype=bool)
        gap = w - s
        assert np.abs(gap[off]).max() <= penalty + 1e-6 and np.abs(np.diag(gap)).max() < 1e-9
        linked = off & (np.abs(p) > 1e-6)
        np.testing.assert_allclose(gap[linked], penalty * np.sign(p[linked]), atol=1e-5)
    assert (np.abs(selection.graphical_lasso(s, 1.0)[1][off]) < 1e-9).all()


def test_noise_density_is_one_density_and_its_variance_is_found():
    q = 0.25
    x = np.linspace(0, 4, 40_001)
    assert math.isclose(selection.noise_density(x, q, 0.7).sum() * (x[1] - x[0]), 1, rel_tol=1e-3)
    rng = np.random.default_rng(2)
    v = np.linalg.eigvalsh(np.cov((rng.standard_normal((1200, 300)) * math.sqrt(0.6)).T))
    assert abs(selection.noise_variance(v, q) - 0.6) < 0.05


def test_shrinkages_keep_signals_and_the_diagonal():
    c, x = correlated(3, 12, 120, 1.0)
    q = 12 / 120
    for keep in (0.0, 0.5, 1.0):
        out, signals = selection.shrink_noise(c, q, keep, targeted=True)
        v, e = np.linalg.eigh(c)
        noise = v <= (1 + math.sqrt(q)) ** 2
        assert signals == (~noise).sum() == 1
        sig, rest = (e[:, ~noise] * v[~noise]) @ e[:, ~noise].T, (e[:, noise] * v[noise]) @ e[:, noise].T
        np.testing.assert_allclose(out, sig + keep * rest + (1 - keep) * np.diag(np.diag(rest)), atol=1e-12)
    out, _ = selection.shrink_noise(c, q)
    np.testing.assert_allclose(np.diag(out), 1)
    np.testing.assert_allclose(selection.shrink_noise(c, q, 1.0)[0], c, atol=1e-12)
    np.testing.assert_allclose(selection.shrink_noise(np.eye(4), 0.1)[0], np.eye(4))


def shares(c, w):
    v, q = np.linalg.eigh(c)
    p = v * (q.T @ w) ** 2
    return p / p.sum()


def test_spectral_budget_has_no_better_neighbour():
    c = risk.shrink(np.cov(correlated(4, 6, 200)[1].T), 200)
    w, loss = selection.spectral_weights(c, 0.3)
    assert math.isclose(w.sum(), 1) and (w >= 0).all()
    budget = np.append(np.full(5, 0.14), 0.3)
    kl = lambda x: float((budget * np.log(budget / np.maximum(shares(c, x), 1e-15))).sum())
    assert math.isclose(kl(w), loss, abs_tol=1e-9)
    rng = np.random.default_rng(5)
    for _ in range(500):
        x = np.maximum(w + rng.normal(0, 1e-3, 6), 0)
        assert kl(x / x.sum()) >= loss - 1e-6


def pair_rows(key, names, c, n=500):
    return [(key, a, b, n, float(c[i, j]), float(c[i, j]), float(c[i, i]), float(c[j, j])) for (i, a), (j, b) in itertools.combinations_with_replacement(enumerate(names), 2)]


PAIRS = "y long, a string, b string, n long, cov double, corr double, va double, vb double"


def test_carried_weights_stay_unless_better(spark):
    c = np.cov(correlated(6, 5, 300)[1].T)
    near = c * (1 + 1e-4)
    df = spark.createDataFrame([r for y, m in ((1, c), (2, near)) for r in pair_rows(y, "abcde", m)], PAIRS)
    got = selection.carried_spectral(df, "y", 0.4).toPandas().pivot(index="asset", columns="y", values=["weight", "kept"])
    assert not got["kept"][1].any() and got["kept"][2].all()
    np.testing.assert_allclose(got["weight"][1].astype(float), got["weight"][2].astype(float), atol=1e-2)


def test_trailing_hedge_matches_numpy_over_the_table(spark, sf):
    """Complete days of all assets, so pairs and complete cases agree; recomputed day by day from the panel."""
    rng = np.random.default_rng(7)
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(d) for d in range(130)]
    r = rng.standard_normal((130, 4)) @ rng.standard_normal((4, 4))
    s = rng.standard_normal((130, 4))
    names = list("abcd")
    frame = lambda m, c: spark.createDataFrame([(a, d, float(m[i, j])) for i, d in enumerate(days) for j, a in enumerate(names)], f"asset string, date date, {c} double")
    got = {(x.date, x.asset): x.weight for x in selection.trailing_hedge(frame(s, "score"), frame(r, "r"), 0.5, 40, 10, 20).collect()}
    expected = {}
    for i in range(130):
        block = i // 10 * 10
        h = r[max(0, block - 40) : block]
        if len(h) < 20:
            continue
        v = np.linalg.eigh(np.corrcoef(h.T))[1]
        w = s[i] - v[:, -1] * (v[:, -1] @ s[i]) - 0.5 * v[:, -2] * (v[:, -2] @ s[i])
        expected |= {(days[i], a): w[j] for j, a in enumerate(names)}
    assert got.keys() == expected.keys()
    for k in got:
        assert math.isclose(got[k], expected[k], rel_tol=1e-8, abs_tol=1e-8)


def test_hedged_scores_use_no_later_day(spark, tmp_path):
    rng = np.random.default_rng(8)
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(d) for d in range(100)]
    r = rng.standard_normal((100, 3))
    frame = lambda m, c, n: spark.createDataFrame([(a, d, float(m[i, j])) for i, d in enumerate(days[:n]) for j, a in enumerate("abc")], f"asset string, date date, {c} double")
    run = lambda n: {(x.date, x.asset): x.weight for x in selection.trailing_hedge(frame(r, "score", n), frame(r, "r", n), 0.5, 40, 10, 20).collect()}
    early, late = run(75), run(100)
    assert early and all(math.isclose(late[k], v, abs_tol=1e-12) for k, v in early.items())


def test_members_need_two_strikes_to_leave(spark):
    c = np.array([[1, 0.1, 0.95], [0.1, 1, 0.1], [0.95, 0.1, 1.0]])
    kind, liquid = dict.fromkeys("abc", "k"), {"a": 3.0, "b": 2.0, "c": 1.0}
    strikes: dict = {}
    held = selection.review(list("abc"), c, kind, liquid, 500, {"k": ["c", "b", "a"]}, strikes, 0.5, 30, 2)["k"]
    assert held == ["c", "b", "a"] and strikes["c"] == 1
    held = selection.review(list("abc"), c, kind, liquid, 500, {"k": held}, strikes, 0.5, 30, 2)["k"]
    assert held == ["b", "a"] and strikes["c"] == 0
    # the copy may not come back, a member without data leaves at once, the class fills to its least from below the floor
    assert selection.review(list("abc"), c, kind, liquid, 500, {"k": held}, strikes, 0.5, 30, 2)["k"] == ["b", "a"]
    two = c[:2, :2]
    assert selection.review(list("ab"), two, kind, liquid, 500, {"k": ["c", "a"]}, {}, 2.5, 30, 2)["k"] == ["a", "b"]
    # one slot, as no eigenvalue is above the edge: the most liquid, and one more for the least
    assert selection.review(list("abc"), np.eye(3), kind, liquid, 500, {}, {}, 0.5, 30, 1)["k"] == ["a"]
    # a strike is forgotten after a review without a flag
    strikes = {"c": 1}
    assert selection.review(list("abc"), np.eye(3), kind, liquid, 500, {"k": ["c"]}, strikes, 0.5, 30, 1)["k"] == ["c"] and strikes["c"] == 0


def test_class_members_match_a_fold_over_the_table(spark, sf):
    from tidewright import views
    from tidewright.plans.selection import yearly

    pairs = yearly(spark, sf).toPandas()
    bars = views.panel_bars(spark, sf).toPandas()
    members, strikes, expected = {}, {}, []
    for y in sorted(pairs.y.unique()):
        part = pairs[pairs.y == y]
        names, c = risk.matrix(part, "corr")
        year = bars[[d.year == y for d in bars.date]]
        liquid = year.assign(v=year.volume.astype(float)).groupby("asset").v.mean().to_dict()
        members = selection.review(names, c, {a: a[0] for a in names}, liquid, int(part.n.min()), members, strikes, 60.0, 4, 1)
        expected += [(int(y), k, x, n) for k, held in members.items() for n, x in enumerate(held)]
    got = [tuple(r) for r in registry.queries()["class_members"](spark, sf).collect()]
    assert sorted(got) == sorted(expected) and got


@pytest.mark.parametrize("name", ["noise_bands", "sparse_links", "spectral_weights"])
def test_fits_match_a_loop_over_keys(spark, sf, name):
    from tidewright.plans import selection as plans

    got = registry.queries()[name](spark, sf).toPandas()
    pairs = (plans.embedding_pairs if name == "noise_bands" else plans.yearly)(spark, sf).toPandas()
    for y, part in pairs.groupby("y"):
        names, c = risk.matrix(part, "corr")
        mine = got[got.y == y]
        if name == "noise_bands":
            v = np.linalg.eigvalsh(c)
            assert int(mine.signals.iloc[0]) == int((v > (1 + math.sqrt(len(c) / part.n.min())) ** 2).sum())
        elif name == "sparse_links":
            for x, links in mine.groupby("penalty"):
                p = selection.graphical_lasso(c, x)[1]
                assert {(a, b) for a, b in zip(links.a, links.b, strict=True)} == {(names[i], names[j]) for i in range(len(c)) for j in range(i + 1, len(c)) if abs(p[i, j]) > 1e-6}
        else:
            w = mine.set_index("asset").weight
            assert math.isclose(w.sum(), 1, abs_tol=1e-5)
    assert len(got)
    assert isinstance(got, pd.DataFrame)
