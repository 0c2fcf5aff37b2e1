import math

import numpy as np
import pandas as pd
import pytest

from tidewright.operators import kernels as k
from tidewright.operators import risk


def test_donchian_keeps_its_state_through_missing_days_and_prints_0():
    c = np.array([1, 2, 3, 4, 9, np.nan, 9, 8, 1, 0.5])
    out = k.donchian(c, c, c, 3, 2)
    assert out[4] == 1 and out[5] == 0
    flipped = k.donchian(np.arange(12.0), np.arange(12.0), np.r_[np.arange(11.0), -5], 3, 2, flip=True)
    assert flipped[10] == 1 and flipped[11] == -1
    plain = k.donchian(np.arange(12.0), np.arange(12.0), np.r_[np.arange(11.0), -5], 3, 2)
    assert plain[11] == 0


def test_signals_use_no_later_rows():
    rng = np.random.default_rng(4)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
    h, l = c * 1.01, c * 0.99  # noqa: E741
    kernels = [
        lambda n: k.kama(c[:n]), lambda n: k.supertrend(h[:n], l[:n], c[:n]), lambda n: k.chandelier(h[:n], l[:n], c[:n]), lambda n: k.keltner(h[:n], l[:n], c[:n]), lambda n: k.parabolic_sar(h[:n], l[:n], c[:n]),
        lambda n: k.adx(h[:n], l[:n], c[:n]), lambda n: k.kalman_trend(np.log(c[:n])), lambda n: k.donchian(h[:n], l[:n], c[:n], 20, 10), lambda n: k.hurst(c[:n]),
    ]
    for f in kernels:
        np.testing.assert_allclose(f(300)[:250], f(250), equal_nan=True)


def test_supertrend_turns_on_the_bands_of_the_day():
    # ranges of 2 around the close: ATR 2 from the first day, bands 3 * 2 = 6 away; three days of warming
    c = np.array([10, 10, 10, 17, 10.5, 10, 3.9, 30], float)
    got = k.supertrend(c + 1, c - 1, c, 3, 1.0)
    a = k.atr(c + 1, c - 1, c, 3)
    up, low = c + a, c - a
    assert got[:3].tolist() == [0, 0, 1]
    above, below, trend, expected = up[2], low[2], 1, [1]
    for i in range(3, 8):
        above = up[i] if up[i] < above or c[i - 1] > above else above
        below = low[i] if low[i] > below or c[i - 1] < below else below
        trend = 1 if c[i] > above else -1 if c[i] < below else trend
        expected.append(trend)
    assert got[2:].tolist() == expected
    # a close that passes the band of the day before, but not today's wider one, turns nothing; a fall through today's does
    assert k.supertrend(np.array([11, 11, 11, 11.0]), np.array([9, 9, 9, 3.0]), np.array([10, 10, 10, 7.5]), 3, 1.0).tolist() == [0, 0, 1, -1]


def test_take_profit_goes_flat_and_trades_again():
    # 12 days of +1 % at a unit of 1 % times sqrt(4): flat once the gain passes 5 units
    r = np.full(14, 0.01)
    sign = np.array([1.0] * 12 + [-1.0] * 2)
    out = k.take_profit_reentry(r, sign, np.full(14, 0.01), 5.0, 4)
    assert out[:11].tolist() == [1.0] * 11 and out[11] == 0 and out[12] == -1


def test_partial_adjustment_starts_at_zero():
    assert k.partial_adjustment(np.array([1.0, 1.0, np.nan, 1.0]), 0.5).tolist() == [0.0, 0.5, 0.5, 0.75]


def test_kalman_follows_a_line_and_predicts_through_gaps():
    y = np.arange(200) * 0.3
    y[100] = np.nan
    assert abs(k.kalman_trend(y)[-1] - 0.3) < 1e-2


def test_average_matches_its_definition():
    x = np.array([3.0, 1.0, 4.0, 1.0, 5.0])
    a = 0.3
    w = np.array([(1 - a) ** (4 - i) for i in range(5)])
    assert math.isclose(k.ema(x, a, adjust=True)[-1], (w * x).sum() / w.sum())
    assert math.isclose(k.ema(x, a)[1], 3 + a * (1 - 3))


def test_bars_restart_where_they_end():
    p = np.exp(np.array([0, 0.5, 1.0, 1.2, 2.1, 2.2]))
    assert k.range_bars(p, 1.0).tolist() == [0, 0, 0, 1, 1, 2]
    assert k.cusum_bars(p, 1.0).tolist() == [0, 0, 0, 1, 1, 2]
    assert k.imbalance_bars(np.array([1, 1, -1, 1, 1, 5.0]), 2).tolist() == [0, 0, 1, 1, 1, 1]
    assert k.ladder_steps(np.exp(np.array([0, 0.25, 0.05, 0.5])), 0.1).tolist() == [0, 2, -1, 4]


def test_queue_position():
    events = [("trade", 3.0), ("cancel", 2.0), ("add", 4.0), ("cancel", 5.0), ("trade", 1.0)]
    left = k.fifo_queue(events, 10.0)
    assert left is not None and 0 < left < 5
    assert k.fifo_queue([("trade", 2.0), ("trade", 1.2)], 3.0) is None
    assert k.fifo_queue([("trade", 2.0)], 3.0) == 1.0


def test_garch_recovers_a_changing_variance():
    rng = np.random.default_rng(1)
    v, out = 1e-4, []
    for _ in range(1500):
        x = rng.normal(0, math.sqrt(v))
        out.append(x)
        v = 1e-4 * 0.05 + 0.1 * x * x + 0.85 * v
    f = k.garch(np.array(out))
    assert f.min() > 0 and np.corrcoef(f[50:], pd.Series(np.square(out)).rolling(20).mean().to_numpy()[50:])[0, 1] > 0.3


def covariance(seed=2, p=8, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) * 0.01
    return np.cov(x.T)


def test_allocations_keep_their_promises():
    c = covariance()
    for name, f in risk.ALLOCATORS.items():
        w = f(c)
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= -1e-12, name
    e = risk.equal_risk(c)
    shares = e * (c @ e)
    assert np.ptp(shares / shares.sum()) < 1e-6
    m = risk.minimum_variance(c)
    rng = np.random.default_rng(0)
    for _ in range(200):
        o = rng.dirichlet(np.ones(len(c)))
        assert m @ c @ m <= o @ c @ o + 1e-12


def test_matrices_are_cleaned():
    c = covariance()
    corr, s = risk.to_correlation(c)
    clean = risk.denoise(corr, 400)
    assert np.allclose(np.diag(clean), 1) and np.linalg.eigvalsh(clean).min() > 0
    broken = corr.copy()
    broken[0, 1] = broken[1, 0] = 0.999
    broken[0, 2] = broken[2, 0] = -0.999
    broken[1, 2] = broken[2, 1] = 0.999
    assert np.linalg.eigvalsh(risk.nearest_psd(broken)).min() > -1e-9
    assert np.linalg.eigvalsh(risk.detone(corr)).min() > -1e-8
    assert np.allclose(risk.shrink(np.eye(4), 50), np.eye(4))
    assert 1 <= risk.effective_bets(c, np.full(len(c), 1 / len(c))) <= len(c)


def test_matrix_drops_assets_without_pairs():
    pdf = pd.DataFrame([("a", "a", 1.0), ("a", "b", 0.1), ("b", "b", 1.0), ("c", "c", 1.0), ("a", "c", 0.2)], columns=["a", "b", "cov"])
    names, m = risk.matrix(pdf)
    assert len(names) == 2 and not np.isnan(m).any()


def test_hawkes_finds_clustering():
    rng = np.random.default_rng(6)
    poisson = np.sort(rng.uniform(0, 86_400, 600))
    clustered = np.sort(np.concatenate([c + np.cumsum(rng.exponential(60, 6)) for c in rng.uniform(0, 80_000, 100)]))
    assert k.hawkes(poisson, (1 / 300,), 86_400)[1].sum() < 0.3 < k.hawkes(clustered, (1 / 300,), 86_400)[1].sum()
    assert k.hawkes(np.zeros(0), (1.0,), 10.0)[0] == 0


def test_inverse_account_of_one_trade():
    # 1 coin of target at 50,000 is 50,000 dollars; the price then rises by a tenth
    out = k.inverse_account(np.array([50_000.0, 55_000.0]), np.array([1.0, 1.0]), np.zeros(2), equity=1.0, fee=0.0)
    assert math.isclose(out[1], 1 + 50_000 * (1 / 50_000 - 1 / 55_000), abs_tol=1e-12)


def test_grid_sells_what_it_bought_one_step_higher():
    out = k.grid_result(np.array([100.0, 99.0, 100.0]), 0.01, 3)
    assert math.isclose(out[-1], 1.0)


def test_filters_settle():
    assert abs(k.steady_gain(1.0) - (math.sqrt(5) - 1) / 2) < 1e-9
    rng = np.random.default_rng(7)
    x = rng.normal(size=500)
    y = 2 * x + 1 + rng.normal(size=500) * 0.1
    y[100] = np.nan
    assert abs(k.hedge_ratio(y, x)[-1] - 2) < 0.1
    f = k.kalman(np.array([1.0, np.nan, 50.0]), np.eye(1), np.ones(1), np.eye(1) * 0.01, 1.0, cap=1.0)
    assert math.isnan(f["surprise"][1]) and f["states"][2, 0] < 5  # the surprise is capped
    v = k.hidden_volatility(np.full(50, 1.02), np.full(50, 1.0))
    assert np.isfinite(v).all() and np.ptp(v[20:]) < 1e-3


def test_selections():
    block = np.full((6, 6), 0.05)
    block[:3, :3] = block[3:, 3:] = 0.9
    np.fill_diagonal(block, 1)
    assert risk.clusters(block).tolist() == [0, 0, 0, 1, 1, 1]
    assert len({i // 3 for i in risk.greedy_selection(block, 2)}) == 2
    tree = risk.spanning_tree(block)
    assert len(tree) == 5 and sum(i // 3 != j // 3 for i, j in tree) == 1
    c = covariance()
    assert risk.effective_bets(c, risk.spectral_parity(c)) >= risk.effective_bets(c, risk.inverse_volatility(c)) - 1e-9
    other = covariance(seed=8)
    w = risk.minimax([c, other])
    worst = lambda w: max(w @ c @ w, w @ other @ w)
    assert worst(w) <= min(worst(risk.minimum_variance(c)), worst(risk.minimum_variance(other))) * 1.05


def test_greedy_selection_stops_where_little_is_gained():
    corr = np.full((4, 4), 0.999)
    np.fill_diagonal(corr, 1)
    assert risk.greedy_selection(corr) == [0]
    corr[3, :3] = corr[:3, 3] = 0.0
    assert risk.greedy_selection(corr) == [0, 3]


def test_partition_by_silhouette_finds_blocks():
    block = np.full((9, 9), 0.05)
    for a in (0, 3, 6):
        block[a : a + 3, a : a + 3] = 0.8
    np.fill_diagonal(block, 1)
    assert sorted(map(sorted, risk.best_partition(block))) == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    w = risk.nested_clusters(block)
    assert np.allclose(w, 1 / 9, atol=1e-6)


def test_equal_risk_raises_where_it_is_not_reached():
    with pytest.raises(ArithmeticError):
        risk.equal_risk(covariance(), rounds=1)


def test_stream_rules():
    c = np.concatenate([np.linspace(100, 150, 80), np.linspace(150, 90, 80)])
    rules = k.stream_rules(c + 0.5, c - 0.5, c, 20)
    assert set(rules) == {"average", "channel", "return"}
    for name, sign in rules.items():
        assert sign[70] == 1 and sign[150] == -1, name


def test_kama_state_turns_with_the_trend():
    rng = np.random.default_rng(3)
    p = 100 + np.concatenate([np.arange(80.0), 80 - np.arange(80.0)]) + rng.normal(size=160) * 0.1
    assert k.kama_state(p)[70] == 1 and k.kama_state(p)[150] == -1
    assert k.kama_state(p, None)[70] == 1 and set(k.kama_state(p)[:20]) == {0.0}
