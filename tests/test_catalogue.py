"""The catalogue of trend signals against pandas, asset by asset."""

import math

import numpy as np
import pandas as pd

from tidewright import registry, views
from tidewright.operators import kernels as k
from tidewright.operators import signals


def expected(x, n):
    """family -> signals of one asset's bars at one frame; NaN where there is none."""
    c, h, l = (x[v].astype(float) for v in ("close", "high", "low"))  # noqa: E741
    r = c.pct_change()
    past = c / c.shift(n) - 1
    y, i = np.log(c), np.arange(n) - (n - 1) / 2

    def slope_t(v):
        b = (i * v).sum() / (i * i).sum()
        left = ((v - v.mean() - b * i) ** 2).sum()
        return b / math.sqrt(left / (n - 2) / (i * i).sum()) if left > 0 else 0.0

    # extremes within n bars on either side
    p = max(3, round(n / 10))
    top, low = h.where(h == h.rolling(2 * p + 1, center=True).max()).shift(p).ffill(), l.where(l == l.rolling(2 * p + 1, center=True).min()).shift(p).ffill()
    q = max(3, round(n / 20))
    old = h.shift(q)
    is_top = (old == h.shift(q).rolling(n).max()) & (h.rolling(q).max() < old)
    roof, floor = old.where(is_top).ffill(), l.rolling(q + 1).min().where(is_top).ffill()
    state = lambda up, down: pd.Series(np.where(c > up, 1.0, np.where(c < down, -1.0, np.nan)), c.index).ffill().fillna(0.0)
    e = lambda half: y.ewm(halflife=half, adjust=True).mean()
    a = (h.to_numpy(), l.to_numpy(), c.to_numpy())
    fast, slow = max(5, round(n / 5)), max(10, round(n / 2))
    high, deep = c.rolling(n).max(), c.rolling(n).min()
    return {
        "pure_momentum": np.sign(past),
        "risk_adjusted": (past / (r.rolling(n).std() * math.sqrt(n)) / 2).clip(-1, 1),
        "trend_t": (y.rolling(n).apply(slope_t, raw=True) / 2).clip(-1, 1),
        "price_sma": np.sign(c - c.rolling(n).mean()),
        "dual_sma": np.sign(c.rolling(max(5, n // 4)).mean() - c.rolling(n).mean()),
        "range_position": 2 * (c - deep) / (high - deep) - 1,
        "ewma_cross": np.sign(e(max(3, n / 8)) - e(n / 2)),
        "kama_cross": pd.Series(np.sign(a[2] - k.kama(a[2], fast, 2, slow))).fillna(0.0),
        "kama_filter": k.kama_state(a[2], 0.5, 20, fast, slow),
        "donchian": k.donchian(*a, n, max(5, n // 3)),
        "supertrend": k.supertrend(*a, max(7, round(n / 5)), 3.0),
        "chandelier": k.chandelier(*a, n, 3.0, 20),
        "pivot": state(top, low),
        "darvas": state(roof, floor),
    }


def test_the_catalogue_matches_pandas(spark, sf):
    got = registry.queries()["trend_catalogue"](spark, sf).toPandas()
    assert set(got.frame) == set(signals.TIME_FRAMES) and got.family.nunique() == 16
    assert got[got.kind == "continuous"].signal.abs().max() <= 1 + 1e-6 and set(got[got.kind == "sign"].signal) <= {-1, 0, 1}
    bars = views.panel_bars(spark, sf).toPandas().sort_values(["asset", "date"])
    asset = bars.asset.iloc[0]
    x = bars[bars.asset == asset].reset_index(drop=True)
    mine = got[got.asset == asset]
    for n in (21, 126):
        for family, want in expected(x, n).items():
            want = pd.Series(np.asarray(want, float), x.date).dropna()
            have = mine[(mine.family == family) & (mine.frame == n)].set_index("date").signal.sort_index()
            assert list(have.index) == list(want.index), family
            off = np.abs(have.to_numpy() - want.to_numpy()) > 2e-6
            # the sign of a difference that is zero but for rounding may fall either way
            assert off.mean() <= (0.002 if family in ("price_sma", "dual_sma", "ewma_cross") else 0), (family, n, off.sum())
