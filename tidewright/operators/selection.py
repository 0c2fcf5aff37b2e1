"""Matrices that are fitted or carried from review to review: noise bands, sparse precision, spectral parity with a budget, hedges on trailing windows, and selection by class.

Pair tables come from Spark joins and sums; what runs in a group is the square of the number of assets, once a review.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import by_asset, divide, rolling
from tidewright.operators.risk import inverse_volatility, matrix


# --- noise band of a correlation matrix


def noise_density(x: np.ndarray, q: float, variance: float = 1.0) -> np.ndarray:
    """Density of the eigenvalues of pure noise of ``variance``, q = assets / rows, by Marchenko and Pastur."""
    low, high = variance * (1 - math.sqrt(q)) ** 2, variance * (1 + math.sqrt(q)) ** 2
    inside = np.maximum((high - x) * (x - low), 0.0)
    return np.sqrt(inside) / (2 * math.pi * variance * q * np.maximum(x, 1e-300))


def noise_variance(eigenvalues: np.ndarray, q: float, least: float = 1e-3, points: int = 500) -> float:
    """Variance, at most 1, whose noise density is nearest in squares to a Gaussian kernel density of the eigenvalues (Silverman's width), on an even grid."""
    v = np.asarray(eigenvalues, float)
    n = len(v)
    width = max(v.std(ddof=1) * (4 / (3 * n)) ** 0.2, 1e-9) if n > 1 else 1e-9
    x = np.linspace(max(v.min() / 2, 1e-6), v.max() * 1.05, points)
    seen = np.exp(-0.5 * ((x[:, None] - v) / width) ** 2).sum(1) / (n * width * math.sqrt(2 * math.pi))
    miss = lambda s: float(((noise_density(x, q, s) - seen) ** 2).sum())
    # a coarse look everywhere, then the golden section around the best
    grid = np.linspace(least, 1.0, 200)
    best = int(np.argmin([miss(s) for s in grid]))
    a, b = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    g = (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if miss(c) < miss(d) else (c, b)
    return (a + b) / 2


def shrink_noise(corr: np.ndarray, q: float, keep: float = 0.0, variance: float | None = 1.0, targeted: bool = False) -> tuple[np.ndarray, int]:
    """(correlations, number of signals): eigenvalues above the noise band stay. Those in it move to their mean, ``keep`` of the way staying; ``targeted`` shrinks what
    the noise part adds off the diagonal instead. ``variance`` None fits it. Nothing changes if all or none are signals."""
    v, e = np.linalg.eigh(corr)
    edge = (noise_variance(v, q) if variance is None else variance) * (1 + math.sqrt(q)) ** 2
    noise = v <= edge
    signals = int((~noise).sum())
    if signals in (0, len(v)):
        return corr.copy(), signals
    if targeted:
        rest = (e[:, noise] * v[noise]) @ e[:, noise].T
        return corr - (1 - keep) * (rest - np.diag(np.diag(rest))), signals
    w = np.where(noise, keep * v + (1 - keep) * v[noise].mean(), v)
    out = (e * w) @ e.T
    d = np.sqrt(np.diag(out))
    return out / np.outer(d, d), signals


def noise_bands(pair_rows: DataFrame, key: str) -> DataFrame:
    """(key, n_assets, variance, signals, fitted_signals, largest, shrunk, targeted): the fitted noise variance of each key's correlations, signals above the band at variance 1 and at
    the fitted one, and the mean absolute correlation before and after either shrinkage."""
    kind = dict(pair_rows.dtypes)[key]
    names = [key, "n_assets", "variance", "signals", "fitted_signals", "mean_abs", "shrunk_abs", "targeted_abs"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        assets, c = matrix(pdf, "corr")
        if len(assets) < 3:
            return pd.DataFrame(columns=names)
        q = len(c) / int(pdf.n.min())
        off = ~np.eye(len(c), dtype=bool)
        eigen, signals = shrink_noise(c, q, 0.0)
        _, fitted = shrink_noise(c, q, 0.0, None)
        aimed, _ = shrink_noise(c, q, 0.5, 1.0, True)
        mean = lambda m: float(np.abs(m[off]).mean())
        return pd.DataFrame([(pdf[key].iloc[0], len(c), noise_variance(np.linalg.eigvalsh(c), q), signals, fitted, mean(c), mean(eigen), mean(aimed))], columns=names)

    return pair_rows.groupBy(key).applyInPandas(run, f"{key} {kind}, n_assets long, variance double, signals long, fitted_signals long, mean_abs double, shrunk_abs double, targeted_abs double")


# --- sparse precision


def graphical_lasso(s: np.ndarray, penalty: float, tol: float = 1e-8, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, precision) that minimise -log det P + tr(S P) + penalty * sum of |P| off the diagonal.

    Block coordinate descent: each column of the covariance is a lasso on the others, solved by cyclic soft thresholding. Raises ArithmeticError where ``rounds`` don't settle it.
    """
    n = len(s)
    w = s.copy()
    beta = np.zeros((n, n))
    rest = [np.delete(np.arange(n), j) for j in range(n)]
    for _ in range(rounds):
        moved = 0.0
        for j in range(n):
            i = rest[j]
            block, target, b = w[np.ix_(i, i)], s[i, j], beta[j, i].copy()
            for _ in range(1000):
                step = 0.0
                for k in range(n - 1):
                    pull = target[k] - block[k] @ b + block[k, k] * b[k]
                    new = math.copysign(max(abs(pull) - penalty, 0.0), pull) / block[k, k]
                    step, b[k] = max(step, abs(new - b[k])), new
                if step < tol / 10:
                    break
            column = block @ b
            moved = max(moved, float(np.abs(column - w[i, j]).max(initial=0.0)))
            w[i, j] = w[j, i] = column
            beta[j, i] = b
        if moved < tol:
            break
    else:
        raise ArithmeticError("the penalised precision was not reached")
    p = np.zeros((n, n))
    for j in range(n):
        i = rest[j]
        p[j, j] = 1 / (w[j, j] - w[i, j] @ beta[j, i])
        p[i, j] = -beta[j, i] * p[j, j]
    return w, (p + p.T) / 2


def sparse_links(pair_rows: DataFrame, key: str, penalties: list[float]) -> DataFrame:
    """(key, penalty, a, b, partial): the pairs that stay linked in each key's penalised precision, with their partial correlation."""
    kind = dict(pair_rows.dtypes)[key]
    names = [key, "penalty", "a", "b", "partial"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        assets, c = matrix(pdf, "corr")
        out = []
        for x in penalties if len(assets) > 1 else []:
            _, p = graphical_lasso(c, x)
            d = np.sqrt(np.diag(p))
            out += [(pdf[key].iloc[0], x, assets[i], assets[j], -p[i, j] / (d[i] * d[j])) for i in range(len(c)) for j in range(i + 1, len(c)) if abs(p[i, j]) > 1e-6]
        return pd.DataFrame(out, columns=names)

    return pair_rows.groupBy(key).applyInPandas(run, f"{key} {kind}, penalty double, a string, b string, partial double")


# --- spectral parity with a budget, carried from date to date


def spectral_weights(c: np.ndarray, first: float | None = None, start: np.ndarray | None = None, rounds: int = 4000) -> tuple[np.ndarray, float]:
    """(weights, loss), long-only: shares of variance by principal component nearest to a budget in relative entropy, even or with ``first`` on the largest component.

    Multiplicative ascent on the simplex from ``start``; a step that does not improve is halved.
    """
    v, q = np.linalg.eigh(c / np.trace(c) * len(c))
    v = np.maximum(v, 0.0)
    n = len(c)
    budget = np.full(n, 1 / n) if first is None else np.append(np.full(n - 1, (1 - first) / (n - 1)), first)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        x = q.T @ w
        part = np.maximum(v * x * x, 1e-18)
        total = part.sum()
        p = np.maximum(part / total, 1e-15)
        if first is None:  # entropy of the shares themselves
            slope = np.log(p) + 1
            value = float((p * np.log(p)).sum())
        else:
            slope = -budget / p
            value = float((budget * np.log(budget / p)).sum())
        return value, q @ ((slope - (slope * p).sum()) * 2 * v * x / total)

    w = np.full(n, 1 / n) if start is None else np.maximum(start, 1e-12) / np.maximum(start, 1e-12).sum()
    value, g = loss(w)
    step = 0.1
    for _ in range(rounds):
        new = np.maximum(w * np.exp(np.clip(-step * (g - g @ w), -20, 20)), 1e-15)
        new /= new.sum()
        got, slope = loss(new)
        if got < value:
            gain, w, value, g, step = value - got, new, got, slope, min(step * 1.2, 5.0)
            if gain < 1e-13:
                break
        else:
            step /= 2
            if step < 1e-12:
                break
    return w, value


def carried_spectral(pair_rows: DataFrame, key: str, first: float | None = None, tolerance: float = 1e-3) -> DataFrame:
    """(key, asset, weight, loss, kept) of spectral parity at each key, in order of keys: the solution reached from the weights before stays unless a fresh start is better by ``tolerance``.

    The fold over keys is one group by nature; it reads a pair table a key, whatever the length of the data.
    """
    kind = dict(pair_rows.dtypes)[key]
    names = [key, "asset", "weight", "loss", "kept"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        before: dict[str, float] = {}
        out = []
        for at, part in pdf.groupby(key, sort=True):
            assets, c = matrix(part)
            if len(assets) < 2:
                continue
            w, loss = min((spectral_weights(c, first, s) for s in (None, inverse_volatility(c))), key=lambda x: x[1])
            kept = False
            old = np.array([before.get(a, 0.0) for a in assets])
            if old.sum() > 0:
                w2, loss2 = spectral_weights(c, first, old)
                if loss >= loss2 - tolerance:
                    w, loss, kept = w2, loss2, True
            before = dict(zip(assets, w, strict=True))
            out += [(at, a, float(x), float(loss), kept) for a, x in zip(assets, w, strict=True)]
        return pd.DataFrame(out, columns=names)

    return pair_rows.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(run, f"{key} {kind}, asset string, weight double, loss double, kept boolean")


# --- hedge on trailing windows


def trailing_pairs(returns: DataFrame, days: int = 756, every: int = 21, least: int = 250) -> DataFrame:
    """(block, a, b, n, cov, va, vb, corr) of returns (asset, date, r): sums over the ``days`` before each block of ``every`` dates, from the sums of the blocks in them.

    Dates are numbered over all assets; a block's pairs use nothing of the block itself. Sums of overlapping windows share their blocks, so each row is summed once.
    """
    dates = returns.select("date").distinct()
    calendar = dates.withColumn("block", F.floor((F.row_number().over(Window.orderBy("date")) - 1) / every))  # one row a date
    x = returns.where("r IS NOT NULL").join(calendar, "date")
    a = x.select("block", "date", F.col("asset").alias("a"), F.col("r").alias("__x"))
    b = x.select("date", F.col("asset").alias("b"), F.col("r").alias("__y"))
    xy = [F.count("*").alias("n"), F.sum("__x").alias("sx"), F.sum("__y").alias("sy"), F.sum(F.col("__x") * F.col("__y")).alias("sxy"), F.sum(F.col("__x") * F.col("__x")).alias("sxx"), F.sum(F.col("__y") * F.col("__y")).alias("syy")]
    sums = a.join(b, "date").where("a <= b").groupBy("block", "a", "b").agg(*xy)
    # every block has a row for each pair, also one in which the pair did not trade
    spine = calendar.select("block").distinct().crossJoin(F.broadcast(sums.select("a", "b").distinct()))
    w = Window.partitionBy("a", "b").orderBy("block").rangeBetween(-(days // every), -1)
    held = spine.join(sums, ["block", "a", "b"], "left").select("block", "a", "b", *[F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    n = F.col("n")
    of = lambda xy, x, y: (F.col(xy) - F.col(x) * F.col(y) / n) / (n - 1)
    out = held.where(n >= least).select("block", "a", "b", "n", of("sxy", "sx", "sy").alias("cov"), of("sxx", "sx", "sx").alias("va"), of("syy", "sy", "sy").alias("vb"))
    return out.select("*", divide(F.col("cov"), F.sqrt(F.col("va") * F.col("vb"))).alias("corr"))


def scaled_returns(returns: DataFrame, n: int = 126, least: int = 60) -> DataFrame:
    """Returns (asset, date, r) over their deviation of the ``n`` days before."""
    return returns.select("asset", "date", (F.col("r") / rolling(F.stddev_samp, F.col("r"), by_asset(), n, lag=1, least=least)).alias("r"))


def trailing_hedge(scores: DataFrame, returns: DataFrame, alpha: float = 0.5, days: int = 756, every: int = 21, least: int = 250) -> DataFrame:
    """(date, asset, weight): scores (date, asset, score) without their part along the first principal component of scaled returns (asset, date, r), and without ``alpha`` of that along
    the second; components are those of the ``days`` before, refreshed every ``every`` dates, so nothing of a day or after it is used. Days with fewer than three scored assets give none."""
    dates = returns.select("date").distinct()
    calendar = dates.withColumn("block", F.floor((F.row_number().over(Window.orderBy("date")) - 1) / every))
    asked = scores.where("score IS NOT NULL").join(calendar, "date").select("block", "date", "asset", "score")
    kind = dict(scores.dtypes)["date"]

    def run(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        names, c = matrix(p, "corr") if len(p) else ([], None)
        out = []
        if len(names) >= 3:
            v1, v2 = np.linalg.eigh(c)[1][:, [-1, -2]].T
            at = {x: i for i, x in enumerate(names)}
            for date, day in s[s.asset.isin(names)].groupby("date"):
                if len(day) >= 3:
                    i = [at[x] for x in day.asset]
                    x = day.score.to_numpy()
                    w = x - v1[i] * (v1[i] @ x) - alpha * v2[i] * (v2[i] @ x)
                    out += [(date, a, float(y)) for a, y in zip(day.asset, w, strict=True)]
        return pd.DataFrame(out, columns=["date", "asset", "weight"])

    pairs = trailing_pairs(returns, days, every, least)
    return asked.groupBy("block").cogroup(pairs.groupBy("block")).applyInPandas(run, f"date {kind}, asset string, weight double")


# --- selection by class


def absolute_ratio(corr: np.ndarray, chosen: list[int]) -> float:
    """Diversification ratio of equal risks with absolute correlations."""
    m = np.abs(corr[np.ix_(chosen, chosen)])
    return len(chosen) / math.sqrt(m.sum())


def slots(corr: np.ndarray, groups: dict[str, list[int]], rows: int, ceiling: int, least: int) -> dict[str, int]:
    """Slots of each class: its eigenvalues above the noise edge, one at least, the largest class giving first while all exceed ``ceiling``; then ``least`` at least."""
    out = {k: max(1, int((np.linalg.eigvalsh(corr[np.ix_(i, i)]) > (1 + math.sqrt(len(i) / rows)) ** 2).sum())) for k, i in groups.items()}
    while sum(out.values()) > ceiling and max(out.values()) > 1:
        out[max(out, key=lambda k: (out[k], k))] -= 1
    return {k: max(n, least) for k, n in out.items()}


def review(names: list[str], corr: np.ndarray, kind: dict[str, str], liquid: dict[str, float], rows: int, members: dict[str, list[str]], strikes: dict[str, int], floor: float, ceiling: int = 30, least: int = 2, same: float = 0.9) -> dict[str, list[str]]:
    """Members of each class after one review; ``strikes`` is updated.

    A member is flagged if it is below the liquidity ``floor`` (while its class has over ``least``), if a more liquid member correlates with it by ``same`` or more, or if it is the one whose loss costs
    the least diversification in a class over its slots; flagged at two reviews running it leaves. Free slots go to the most liquid first, then to what raises the diversification ratio most, while it rises;
    classes below ``least`` fill up from under the floor, the most liquid first. Members without data leave at once.
    """
    at = {x: i for i, x in enumerate(names)}
    groups: dict[str, list[int]] = {}
    for x in names:
        groups.setdefault(kind[x], []).append(at[x])
    room = slots(corr, groups, rows, ceiling, least)
    worth = lambda x: (-liquid.get(x, 0.0), x)
    alike = lambda x, y: abs(corr[at[x], at[y]]) >= same
    ratio = lambda xs: absolute_ratio(corr, [at[x] for x in xs])
    out = {}
    for k in sorted(groups):
        inside = [names[i] for i in groups[k]]
        held = [x for x in members.get(k, []) if x in at]
        flagged = set()
        for x in held:
            thin = liquid.get(x, 0.0) < floor and len(held) > least
            if thin or any(alike(x, y) and worth(y) < worth(x) for y in held if y != x):
                flagged.add(x)
        if len(held) > room[k]:
            flagged.add(max(sorted(held), key=lambda x: ratio([y for y in held if y != x])))
        for x in list(held):
            strikes[x] = strikes.get(x, 0) + 1 if x in flagged else 0
            if strikes[x] >= 2:
                held.remove(x)
                strikes[x] = 0
        free = lambda ok: sorted((x for x in inside if x not in held and ok(x) and not any(alike(x, y) for y in held)), key=worth)  # noqa: E731, B023
        while len(held) < room[k] and (options := free(lambda x: liquid.get(x, 0.0) >= floor)):
            best = options[0] if not held else max(options, key=lambda x: (ratio([*held, x]), [-y for y in map(ord, x)]))
            if len(held) > 1 and ratio([*held, best]) <= ratio(held):
                break
            held.append(best)
        while len(held) < least and (options := free(lambda x: True)):
            held.append(options[0])
        out[k] = held
    return out


def class_first(pair_rows: DataFrame, info: DataFrame, key: str, floor: float, ceiling: int = 30, least: int = 2) -> DataFrame:
    """(key, class, asset, place): members by class after each review, in order of ``key``. ``info`` is (key, asset, class, liquidity).

    Holdings and strikes are carried from review to review, so the fold is one group; it reads a pair table a review, whatever the length of the data.
    """
    kind = dict(pair_rows.dtypes)[key]
    names = [key, "class", "asset", "place"]

    def run(p: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        members: dict[str, list[str]] = {}
        strikes: dict[str, int] = {}
        out = []
        for at, part in p.groupby(key, sort=True):
            about = i[i[key] == at]
            known = dict(zip(about.asset, about["class"], strict=True))
            assets, c = matrix(part[part.a.isin(known) & part.b.isin(known)], "corr")
            if not assets:
                continue
            members = review(assets, c, known, dict(zip(about.asset, about.liquidity, strict=True)), int(part.n.min()), members, strikes, floor, ceiling, least)
            out += [(at, k, x, n) for k, held in members.items() for n, x in enumerate(held)]
        return pd.DataFrame(out, columns=names)

    whole = lambda df: df.withColumn("__all", F.lit(0)).groupBy("__all")
    return whole(pair_rows).cogroup(whole(info)).applyInPandas(run, f"{key} {kind}, class string, asset string, place long")
