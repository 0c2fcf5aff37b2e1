"""Recursions along one asset's or symbol's history, as grouped functions: what a window frame cannot express because the state depends on itself.

Every kernel is a plain function of arrays, oldest first. A group is one key's history, which the model of daily bars bounds; tape kernels
run by symbol and day and restart each day, so no group grows with the tape's length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_asset(df: DataFrame, columns: dict[str, Callable[[pd.DataFrame], np.ndarray]], key: str = "asset", order: str = "date") -> DataFrame:
    """``key``, ``order`` and a double column for each function of the key's sorted rows."""
    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, " + ", ".join(f"{c} double" for c in columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        out = {c: pd.Series(np.asarray(f(pdf), float)) for c, f in columns.items()}
        return pd.DataFrame({key: pdf[key], order: pdf[order], **out}).astype(object).where(lambda x: x.notna(), None)

    return df.groupBy(key).applyInPandas(run, schema)


def ema(x: np.ndarray, alpha: float, adjust: bool = False, least: int = 1) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=adjust, min_periods=least).mean().to_numpy()


def ew_std(x: np.ndarray, span: float) -> np.ndarray:
    return pd.Series(x).ewm(span=span).std().to_numpy()


def halflife_alpha(half: float) -> float:
    return 1 - 2 ** (-1 / half)


def returns(p: np.ndarray) -> np.ndarray:
    out = np.full(len(p), np.nan)
    out[1:] = p[1:] / p[:-1] - 1
    return out


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:  # noqa: E741
    before = np.concatenate([[np.nan], c[:-1]])
    return np.nanmax(np.stack([h - l, np.abs(h - before), np.abs(l - before)]), axis=0)


def atr(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:  # noqa: E741
    return ema(true_range(h, l, c), 1 / n)


def risk_metrics(r: np.ndarray, lam: float = 0.94, seed: int = 20) -> np.ndarray:
    """Forecast of the next day's variance, var = lam var + (1 - lam) r², from the mean square of the first ``seed`` returns."""
    x = np.nan_to_num(r)
    var = float(np.mean(x[1 : seed + 1] ** 2)) if len(x) > 1 else 0.0
    out = np.empty(len(x))
    for i, v in enumerate(x):
        out[i] = var
        var = lam * var + (1 - lam) * v * v
    return out


def partial_adjustment(target: np.ndarray, speed: float) -> np.ndarray:
    """The position moves by ``speed`` of its distance to the target each day, from 0; it is 0 on the first day."""
    pos, out = 0.0, np.zeros(len(target))
    for i in range(1, len(target)):
        t = target[i]
        pos = pos if math.isnan(t) else pos + speed * (t - pos)
        out[i] = pos
    return out


def no_trade_buffer(target: np.ndarray, buffer: float) -> np.ndarray:
    """Trades to the target only where it is further away than ``buffer`` times the running mean of its size."""
    cur, total, n, out = 0.0, 0.0, 0, np.zeros(len(target))
    for i, t in enumerate(target):
        if not math.isnan(t):
            total, n = total + abs(t), n + 1
            if abs(t - cur) > buffer * total / n:
                cur = t
        out[i] = cur
    return out


def rolling_max(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).rolling(n).max().shift(1).to_numpy()


def rolling_min(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).rolling(n).min().shift(1).to_numpy()


def donchian(h: np.ndarray, l: np.ndarray, c: np.ndarray, enter: int, leave: int, flip: bool = False) -> np.ndarray:  # noqa: E741
    """In on a close beyond the extreme of the ``enter`` days before, out on one beyond the opposite extreme of ``leave`` days.

    Without ``flip`` the other side is not taken on the day of the exit, and a day without channels prints 0 but keeps the state; with it both are turned round.
    """
    hi, lo, out_hi, out_lo = rolling_max(h, enter), rolling_min(l, enter), rolling_max(h, leave), rolling_min(l, leave)
    pos, out = 0, np.zeros(len(c))
    for i in range(len(c)):
        if math.isnan(hi[i]) or math.isnan(out_hi[i]) or math.isnan(c[i]):
            pos = 0 if flip else pos
            continue
        left = (pos == 1 and c[i] < out_lo[i]) or (pos == -1 and c[i] > out_hi[i])
        if left:
            pos = 0
        if pos == 0 and (flip or not left):
            pos = 1 if c[i] > hi[i] else -1 if c[i] < lo[i] else 0
        out[i] = pos
    return out


def kama(p: np.ndarray, n: int = 10, fast: int = 2, slow: int = 30) -> np.ndarray:
    """Kaufman's adaptive average: starts at row n with the price; a missing price spoils the rest."""
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    moved = np.abs(np.diff(p, prepend=np.nan))
    out = np.full(len(p), np.nan)
    if len(p) > n:
        path = pd.Series(moved).rolling(n).sum().to_numpy()
        y = p[n]
        out[n] = y
        for i in range(n + 1, len(p)):
            er = abs(p[i] - p[i - n]) / path[i] if path[i] > 0 else 0.0 if path[i] == 0 else math.nan
            y += (er * (f - s) + s) ** 2 * (p[i] - y)
            out[i] = y
    return out


def kama_state(p: np.ndarray, mult: float | None = 0.5, window: int = 20, n: int = 10, slow: int = 30) -> np.ndarray:
    """Trend of Kaufman's average: the price against it, or (with ``mult``) up once it rises by more than that many deviations of its own last changes, down once it
    falls by as much, else as before; 0 until then."""
    k = kama(p, n, slow=slow)
    if mult is None:
        return np.nan_to_num(np.sign(p - k))
    d = pd.Series(np.diff(k, prepend=np.nan))
    edge = mult * d.rolling(window).std()
    turn = np.sign(d).where(d.abs() > edge)
    return turn.where(edge.notna()).ffill().fillna(0.0).to_numpy()


def supertrend(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int = 10, k: float = 3.0) -> np.ndarray:  # noqa: E741
    """Ratcheting bands k ATR around (H + L) / 2: each moves towards the price only, until the close before has passed it. The trend turns when a close passes today's
    band. 0 until the average has seen n ranges, +1 on that day."""
    a, mid = atr(h, l, c, n), (h + l) / 2
    up, low = mid + k * a, mid - k * a
    out = np.zeros(len(c))
    for i in range(n - 1, len(c)):
        if i == n - 1:
            above, below, trend = up[i], low[i], 1
        else:
            above = up[i] if c[i - 1] > above else min(up[i], above)
            below = low[i] if c[i - 1] < below else max(low[i], below)
            trend = 1 if c[i] > above else -1 if c[i] < below else trend
        out[i] = trend
    return out


def chandelier(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int = 20, k: float = 3.0, atr_n: int | None = None) -> np.ndarray:  # noqa: E741
    """Breakout entry, then a stop k ATR from the best close since, which never loosens. Days without a channel print 0 and keep the state."""
    hi, lo, a = rolling_max(h, n), rolling_min(l, n), atr(h, l, c, atr_n or n)
    pos, best, stop, out = 0, 0.0, 0.0, np.zeros(len(c))
    for i in range(len(c)):
        if math.isnan(hi[i]) or math.isnan(c[i]):
            continue
        if pos:
            best = max(best, c[i]) if pos == 1 else min(best, c[i])
            new = best - pos * k * a[i]
            stop = max(stop, new) if pos == 1 else min(stop, new)
            if pos * (c[i] - stop) < 0:
                pos = 0
        elif c[i] > hi[i] or c[i] < lo[i]:
            pos = 1 if c[i] > hi[i] else -1
            best, stop = c[i], c[i] - pos * k * a[i]
        out[i] = pos
    return out


def keltner(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int = 20, k: float = 1.0) -> np.ndarray:  # noqa: E741
    """+1 beyond EMA + k ATR, -1 beyond EMA - k ATR, kept between."""
    m, a = ema(c, 2 / (n + 1)), atr(h, l, c, n)
    state = np.where(c > m + k * a, 1.0, np.where(c < m - k * a, -1.0, np.nan))
    return pd.Series(state).ffill().fillna(0).to_numpy()


def parabolic_sar(h: np.ndarray, l: np.ndarray, c: np.ndarray, step: float = 0.02, most: float = 0.2) -> np.ndarray:  # noqa: E741
    """Side of Wilder's stop and reverse, seeded by the first two closes; a missing bar repeats the output."""
    out = np.zeros(len(c))
    if len(c) < 2:
        return out
    up = c[1] >= c[0]
    sar, ep, af = (l[0], h[1], step) if up else (h[0], l[1], step)
    out[1] = 1 if up else -1
    for i in range(2, len(c)):
        if math.isnan(h[i]) or math.isnan(l[i]):
            out[i] = out[i - 1]
            continue
        sar += af * (ep - sar)
        sar = min(sar, l[i - 1], l[i - 2]) if up else max(sar, h[i - 1], h[i - 2])
        if (up and l[i] < sar) or (not up and h[i] > sar):
            up, sar, ep, af = not up, ep, l[i] if up else h[i], step
        elif (up and h[i] > ep) or (not up and l[i] < ep):
            ep, af = h[i] if up else l[i], min(most, af + step)
        out[i] = 1 if up else -1
    return out


def adx(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int = 14) -> np.ndarray:  # noqa: E741
    up, down = np.diff(h, prepend=np.nan), -np.diff(l, prepend=np.nan)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    a = atr(h, l, c, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, m = 100 * ema(plus, 1 / n) / a, 100 * ema(minus, 1 / n) / a
        dx = np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), 0.0)
    return ema(dx, 1 / n)


def kalman_trend(y: np.ndarray, q_level: float = 1e-3, q_slope: float = 1e-5, noise: float = 1e-2) -> np.ndarray:
    """Slope of a local linear trend; a missing value only predicts."""
    level, slope, p11, p12, p22 = (float(y[0]) if len(y) else 0.0), 0.0, 1.0, 0.0, 1.0
    out = np.empty(len(y))
    for i, v in enumerate(y):
        if i:
            level += slope
            p11, p12, p22 = p11 + 2 * p12 + p22 + q_level, p12 + p22, p22 + q_slope
        if not math.isnan(v):
            s = p11 + noise
            k1, k2, e = p11 / s, p12 / s, v - level
            level, slope = level + k1 * e, slope + k2 * e
            p22 -= k2 * p12
            p12 *= 1 - k1
            p11 *= 1 - k1
        out[i] = slope
    return out


def hurst(x: np.ndarray, window: int = 120, sizes: tuple[int, ...] = (8, 16, 32, 60)) -> np.ndarray:
    """Slope of ln R/S on ln size over chunks of the trailing window of returns."""
    r = returns(x)
    out = np.full(len(x), np.nan)
    for i in range(window, len(x), 20):
        w = r[i - window + 1 : i + 1]
        pts = []
        for n in sizes:
            parts = w[: window // n * n].reshape(-1, n)
            z = np.cumsum(parts - parts.mean(1, keepdims=True), 1)
            s = parts.std(1)
            if (s > 0).all():
                pts.append((math.log(n), math.log(((z.max(1) - z.min(1)) / s).mean())))
        if len(pts) > 1:
            out[i] = np.polyfit(*zip(*pts, strict=True), 1)[0]
    return pd.Series(out).ffill().to_numpy()


def take_profit_reentry(r: np.ndarray, sign: np.ndarray, vol: np.ndarray, k: float, horizon: int) -> np.ndarray:
    """Flat once the gain since the entry passes k units; in again after the price gives back one unit from the best gain since."""
    out = np.zeros(len(r))
    now, gain, best, unit, flat = 0.0, 0.0, 0.0, 0.0, False
    for i in range(len(r)):
        s = 0.0 if math.isnan(sign[i]) else sign[i]
        if s != now:
            now, gain, best, flat = s, 0.0, 0.0, False
            unit = (0.0 if math.isnan(vol[i]) else vol[i]) * math.sqrt(horizon)
        else:
            gain += now * (0.0 if math.isnan(r[i]) else r[i])
            best = max(best, gain)
            if not flat and unit > 0 and gain > k * unit:
                flat, best = True, gain
            elif flat and best - gain >= unit:
                flat, gain, best = False, 0.0, 0.0
        out[i] = 0.0 if flat else now
    return out


def garch(r: np.ndarray) -> np.ndarray:
    """One-step forecast of the variance by GARCH(1,1) with variance targeting; the two parameters by a grid refined twice."""
    x = np.nan_to_num(r)
    target = float(np.var(x)) or 1e-12

    def path(a: float, b: float) -> np.ndarray:
        out = np.empty(len(x))
        v = target
        for i in range(len(x)):
            out[i] = v
            v = (1 - a - b) * target + a * x[i] * x[i] + b * v
        return out

    def loss(a: float, b: float) -> float:
        if a < 0 or b < 0 or a + b >= 0.999:
            return math.inf
        v = path(a, b)
        return float(np.sum(np.log(v) + x * x / v))

    best, width = (0.05, 0.9), 0.08
    for _ in range(3):
        grid = [(best[0] + i * width / 2, best[1] + j * width / 2) for i in range(-2, 3) for j in range(-2, 3)]
        best, width = min(grid, key=lambda g: loss(*g)), width / 2.5
    return path(*best)


def range_bars(p: np.ndarray, threshold: float) -> np.ndarray:
    """Bar number of each observation: a bar ends where its log range reaches the threshold, and the next one starts there."""
    out, bar = np.empty(len(p), np.int64), 0
    hi = lo = math.log(p[0]) if len(p) else 0.0
    for i, v in enumerate(np.log(p)):
        hi, lo = max(hi, v), min(lo, v)
        out[i] = bar
        if hi - lo >= threshold:
            bar, hi, lo = bar + 1, v, v
    return out


def cusum_bars(p: np.ndarray, threshold: float) -> np.ndarray:
    """Bar number by a symmetric CUSUM of log returns; both sums restart when one reaches the threshold."""
    out, bar, up, down = np.empty(len(p), np.int64), 0, 0.0, 0.0
    r = np.diff(np.log(p), prepend=math.log(p[0]) if len(p) else 0.0)
    for i, v in enumerate(r):
        up, down = max(0.0, up + v), min(0.0, down + v)
        out[i] = bar
        if up >= threshold or down <= -threshold:
            bar, up, down = bar + 1, 0.0, 0.0
    return out


def imbalance_bars(signed: np.ndarray, band: float, least: int = 1) -> np.ndarray:
    """Bar number: a bar ends where its signed sum reaches the band and it has ``least`` trades."""
    out, bar, total, n = np.empty(len(signed), np.int64), 0, 0.0, 0
    for i, v in enumerate(signed):
        total, n = total + v, n + 1
        out[i] = bar
        if abs(total) >= band and n >= least:
            bar, total, n = bar + 1, 0.0, 0
    return out


def adaptive_imbalance_bars(signed: np.ndarray, start: float, alpha: float = 0.1) -> np.ndarray:
    """Bar number with the threshold E[T] |E[v]|, both exponential averages, of bars and trades."""
    out, bar, total, n = np.empty(len(signed), np.int64), 0, 0.0, 0
    size, mean = start, abs(float(signed[0])) if len(signed) else 1.0
    for i, v in enumerate(signed):
        total, n = total + v, n + 1
        mean = (1 - alpha) * mean + alpha * v
        out[i] = bar
        if abs(total) >= max(size * abs(mean), abs(start)):
            size, bar, total, n = (1 - alpha) * size + alpha * n, bar + 1, 0.0, 0
    return out


def ladder_steps(p: np.ndarray, step: float) -> np.ndarray:
    """Net steps of a ladder in log price at each observation; several at once where the price jumps."""
    out = np.zeros(len(p), np.int64)
    level = math.log(p[0]) if len(p) else 0.0
    for i, v in enumerate(np.log(p)):
        n = math.floor(abs(v - level) / step + 1e-12) * (1 if v > level else -1)
        out[i] = n
        level += n * step
    return out


def per_symbol_day(tape: DataFrame, columns: dict[str, Callable[[pd.DataFrame], np.ndarray]]) -> DataFrame:
    """(symbol, day, id) and a long column for each kernel over the day's trades in order of time and id."""
    schema = "symbol string, day long, id long, " + ", ".join(f"{c} long" for c in columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_ms", "id"]).reset_index(drop=True)
        return pd.DataFrame({"symbol": pdf.symbol, "day": pdf.day, "id": pdf.id, **{c: f(pdf) for c, f in columns.items()}})

    return tape.withColumn("day", F.expr("ts_ms div 86400000")).groupBy("symbol", "day").applyInPandas(run, schema)


def fifo_queue(events: list[tuple[str, float]], ahead: float, cancel_power: float = 1.0) -> float | None:
    """Size ahead of an order that joins a level of ``ahead``: trades eat the front, cancels are split by x^power of the share ahead; None once it is reached."""
    front, behind = ahead, 0.0
    for kind, size in events:
        if kind == "trade":
            front -= size
            if front < 0:
                return None
        elif kind == "cancel":
            whole = front + behind
            share = (front / whole) ** cancel_power if whole > 0 else 0.0
            front -= min(front, size * share)
            behind = max(0.0, behind - size * (1 - share))
        else:
            behind += size
    return front


def hawkes(times: np.ndarray, decays: tuple[float, ...], end: float, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Base rate and branching ratios of exponential kernels with given decays, by expectation-maximisation; each event is an offspring of the base or of the past through one kernel."""
    n, k = len(times), len(decays)
    if n == 0:
        return 0.0, np.zeros(k)
    beta = np.asarray(decays)
    r = np.zeros((n, k))
    for i in range(1, n):
        r[i] = np.exp(-beta * (times[i] - times[i - 1])) * (r[i - 1] + 1)
    seen = (1 - np.exp(-beta[None, :] * (end - times)[:, None])).sum(0)
    mu, a = 0.5 * n / end, np.full(k, 0.5 / k)
    for _ in range(rounds):
        parts = a * beta * r
        rate = mu + parts.sum(1)
        mu, a = (mu / rate).sum() / end, (parts / rate[:, None]).sum(0) / np.maximum(seen, 1e-12)
    return float(mu), a


def inverse_account(price: np.ndarray, target: np.ndarray, funding: np.ndarray, equity: float = 1.0, buffer: float = 0.1, fee: float = 0.0005, lot: float = 10.0) -> np.ndarray:
    """Equity in coin, hour by hour, of inverse contracts of ``target`` times equity: profit, funding, buffer, rounding to lots, fees."""
    amount, out = 0.0, np.empty(len(price))
    for i, p in enumerate(price):
        if i:
            equity += amount * (1 / price[i - 1] - 1 / p) - abs(amount) / p * np.sign(amount) * funding[i]
        want = round(target[i] * equity * p / lot) * lot
        if abs(want - amount) > buffer * equity * p:
            equity -= fee * abs(want - amount) / p
            amount = want
        out[i] = equity
    return out


def grid_result(price: np.ndarray, step: float, levels: int) -> np.ndarray:
    """Running result of a paired grid around the first price: each level bought on the way down is sold one step higher."""
    if not len(price):
        return np.zeros(0)
    base, open_, cash, out = price[0], set(), 0.0, np.empty(len(price))
    for i, p in enumerate(price):
        for k in range(1, levels + 1):
            buy = base * (1 - k * step)
            if p <= buy and k not in open_:
                open_.add(k)
                cash -= buy
            elif k in open_ and p >= buy + base * step:
                open_.discard(k)
                cash += buy + base * step
        out[i] = cash + len(open_) * p
    return out


#: Decay rates of the six kernels, by second: from under a second to two hours.
DECAYS = (2.0, 0.2, 1 / 30, 1 / 240, 1 / 1200, 1 / 7200)


def branching(tape: DataFrame, decays: tuple[float, ...] = DECAYS) -> DataFrame:
    """(symbol, day, mu, branching) of a Hawkes process of each day's trades, times in seconds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf.ts_ms.to_numpy()) % 86_400_000 / 1000
        mu, a = hawkes(t, decays, 86_400.0)
        return pd.DataFrame({"symbol": [pdf.symbol.iloc[0]], "day": [int(pdf.day.iloc[0])], "mu": [mu], "branching": [float(a.sum())]})

    return tape.withColumn("day", F.expr("ts_ms div 86400000")).groupBy("symbol", "day").applyInPandas(run, "symbol string, day long, mu double, branching double")


#: Horizons in days of the stream factory.
SPEEDS = (5, 10, 15, 20, 30, 40, 60, 90, 120, 160, 200, 250)


def stream_rules(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int) -> dict[str, np.ndarray]:  # noqa: E741
    """Signs of three rules at horizon n: two averages of the log price, a channel, the past return; NaN while too few rows are known."""
    y = np.log(c)
    average = np.sign(ema(y, 2 / (max(n // 4, 2) + 1), adjust=True, least=n) - ema(y, 2 / (n + 1), adjust=True, least=n))
    past = np.full(len(c), np.nan)
    past[n:] = np.sign(c[n:] / c[:-n] - 1) if len(c) > n else past[n:]
    return {"average": average, "channel": donchian(h, l, c, n, max(n // 2, 2)), "return": past}


def stream_factory(df: DataFrame, speeds: tuple[int, ...] = SPEEDS, target: float = 0.1, rate: float = 0.1) -> DataFrame:
    """(asset, date, rule, speed, position, gross, traded): each rule's sign times target over volatility, adjusted by ``rate`` a day; one group per asset and speed."""
    schema = "asset string, date date, rule string, speed int, position double, gross double, traded double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        h, l, c, n = pdf["high"].to_numpy(), pdf["low"].to_numpy(), pdf["close"].to_numpy(), int(pdf.speed.iloc[0])  # noqa: E741
        r = returns(c)
        vol = np.sqrt(pd.Series(r * r).ewm(span=n, min_periods=min(n, 60)).mean().to_numpy() * 252)
        out = []
        for rule, sign in stream_rules(h, l, c, n).items():
            with np.errstate(divide="ignore", invalid="ignore"):
                pos = partial_adjustment(sign * target / vol, rate)
            held = np.concatenate([[0.0], pos[:-1]])[: len(pos)]
            out.append(pd.DataFrame({"asset": pdf.asset, "date": pdf.date, "rule": rule, "speed": n, "position": pos, "gross": held * np.nan_to_num(r), "traded": np.abs(np.diff(pos, prepend=0.0))}))
        return pd.concat(out)

    spread = df.select("asset", "date", "high", "low", "close", F.explode(F.array(*map(F.lit, speeds))).alias("speed"))
    return spread.groupBy("asset", "speed").applyInPandas(run, schema)


def kalman(y: np.ndarray, transition: np.ndarray, observe: np.ndarray, q: np.ndarray, noise: float, start: np.ndarray | None = None, cap: float = math.inf) -> dict[str, np.ndarray]:
    """A linear filter with any number of states: forecast, surprise, z, gain of the first state and the states. ``observe`` is one row, or one a day.

    Missing values only predict; surprises beyond ``cap`` standard deviations are cut to that.
    """
    k = len(transition)
    a = np.zeros(k) if start is None else np.asarray(start, float)
    p = np.eye(k) * 1e6
    rows = np.broadcast_to(np.atleast_2d(observe), (len(y), k))
    out = {name: np.full(len(y), np.nan) for name in ("forecast", "surprise", "z", "gain")}
    states = np.empty((len(y), k))
    for i, v in enumerate(y):
        if i:
            a, p = transition @ a, transition @ p @ transition.T + q
        h = rows[i]
        f = h @ a
        out["forecast"][i] = f
        if not math.isnan(v):
            s = float(h @ p @ h + noise)
            gain = p @ h / s
            e = max(-cap, min(cap, (v - f) / math.sqrt(s))) * math.sqrt(s)
            out["surprise"][i], out["z"][i], out["gain"][i] = v - f, (v - f) / math.sqrt(s), gain[0]
            a = a + gain * e
            p = p - np.outer(gain, h @ p)
        states[i] = a
    return out | {"states": states}


def hedge_ratio(y: np.ndarray, x: np.ndarray, drift: float = 1e-4, noise: float = 1e-2) -> np.ndarray:
    """Slope of y on x that walks at random, with an intercept."""
    design = np.stack([x, np.ones(len(x))], 1)
    return kalman(y, np.eye(2), design, np.eye(2) * drift, noise)["states"][:, 0]


def hidden_volatility(h: np.ndarray, l: np.ndarray, drift: float = 0.01) -> np.ndarray:  # noqa: E741
    """Volatility from the log range: ln ln(H / L) observes ln sigma with mean 0.43 and sd 0.29; a walk at random underneath."""
    with np.errstate(divide="ignore"):
        y = np.log(np.log(h / l)) - 0.43
    y[~np.isfinite(y)] = np.nan
    return np.exp(kalman(y, np.eye(1), np.ones(1), np.eye(1) * drift, 0.29**2)["states"][:, 0])


def steady_gain(q_over_noise: float, rounds: int = 10_000) -> float:
    """Gain of a random walk plus noise once the filter has settled."""
    p = 1.0
    for _ in range(rounds):
        new = (p + q_over_noise) / (p + q_over_noise + 1)
        if abs(new - p) < 1e-15:
            break
        p = new
    return p
