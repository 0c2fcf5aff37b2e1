"""Queries of volatility, covariance, allocation, futures rolls and carry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import by_asset, r6_sql, rounded
from tidewright.operators import risk
from tidewright.operators.rolling import simple_return
from tidewright.registry import query

P = f"WITH {views.PANEL_SQL}"
W = "PARTITION BY asset ORDER BY date"


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


_F = f"({W} ROWS 19 PRECEDING)"
_ON = lambda c, x: f"CASE WHEN count({c}) OVER {_F} >= 20 THEN sqrt(greatest({x}, 0) * 252) END"
_A = lambda c: f"avg({c}) OVER {_F}"
_K = 0.34 / (1.34 + 21 / 19)


@query(
    f"""{P}, b AS (SELECT asset, date, ln(high / low) ** 2 hl, 0.5 * ln(high / low) ** 2 - {2 * math.log(2) - 1!r}::DOUBLE * ln(close / open) ** 2 gk, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) rs, ln(open / lag(close) OVER ({W})) "on", ln(close / open) oc FROM panel_bars)
    SELECT asset, date, {r(_ON('hl', f'{_A("hl")} / {4 * math.log(2)!r}::DOUBLE'), 'parkinson')}, {r(_ON('gk', _A('gk')), 'garman_klass')}, {r(_ON('rs', _A('rs')), 'rogers_satchell')},
      {r(_ON('"on"', f'var_samp("on") OVER {_F} + {_K!r}::DOUBLE * var_samp(oc) OVER {_F} + {1 - _K!r}::DOUBLE * {_A("rs")}'), 'yang_zhang')} FROM b"""
)
def range_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.range_volatility(views.panel_bars(spark, sf_dir)))


RETURNS = f"q AS (SELECT year(date) y, date, asset, ln(close) - lag(ln(close)) OVER ({W}) r FROM panel_bars)"
PAIRS = f"""{RETURNS}, p AS (SELECT x.y, x.asset a, z.asset b, count(*) n, covar_samp(x.r, z.r) cov, var_samp(x.r) va, var_samp(z.r) vb FROM q x JOIN q z ON x.y = z.y AND x.date = z.date AND x.asset <= z.asset WHERE x.r IS NOT NULL AND z.r IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.ln("close")
    x = views.panel_bars(spark, sf_dir).select(F.year("date").cast("long").alias("y"), F.col("date").alias("i"), "asset", (c - F.lag(c).over(by_asset())).alias("r"))
    return risk.pairs(x, "y")


@query(f"{P}, {PAIRS} SELECT y, a, b, n, {r('cov', 'cov')}, {r('va', 'va')}, {r('vb', 'vb')}, {r('cov / sqrt(va * vb)', '\"corr\"')} FROM p")
def pair_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pairs(spark, sf_dir))


@query(
    f"""{P}, {PAIRS}, w AS (SELECT y, a asset, (1 / sqrt(va)) / sum(1 / sqrt(va)) OVER (PARTITION BY y) weight FROM p WHERE a = b), v AS (SELECT p.y, sum((CASE WHEN a = b THEN 1 ELSE 2 END) * w1.weight * w2.weight * cov) v, sum(CASE WHEN a = b THEN w1.weight * sqrt(va) END) o FROM p JOIN w w1 ON p.y = w1.y AND a = w1.asset JOIN w w2 ON p.y = w2.y AND b = w2.asset GROUP BY 1)
    SELECT y, {r('v', 'variance')}, {r('sqrt(v)', 'vol')}, {r('o / sqrt(v)', 'ratio')} FROM v"""
)
def inverse_vol_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = _pairs(spark, sf_dir)
    inv = 1 / F.sqrt("va")
    w = p.where("a = b").select("y", F.col("a").alias("asset"), (inv / F.sum(inv).over(Window.partitionBy("y"))).alias("weight"))
    return rounded(risk.diversification(p, w, "y"))


@query()
def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests hold the invariants: weights add to 1, equal risk is equal, the minimum has no better neighbour."""
    return rounded(risk.allocate(_pairs(spark, sf_dir), "y"))


@query()
def correlation_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(risk.spectra(_pairs(spark, sf_dir), "y"))


@query()
def embedding_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of the embeddings as assets, vectors as days: a pair table of all their columns over any number of rows."""
    from tidewright.plans.selection import embedding_pairs

    return rounded(risk.spectra(embedding_pairs(spark, sf_dir), "y"))


# two contracts a month: the panel as front, and the same shifted in level as the next, expiring a month apart


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = views.panel_bars(spark, sf_dir).select("asset", "date", "close", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    m = F.year("date") * 12 + F.month("date") - 1 + F.col("k")
    return x.select("asset", "date", F.concat(F.lit("c"), m).alias("contract"), (F.col("close") + m - F.col("k")).alias("close"), F.last_day(F.add_months(F.trunc("date", "MM"), F.col("k"))).alias("expiry"))


@query(
    f"""{P}, x0 AS (SELECT asset, date, close, k, year(date) * 12 + month(date) - 1 + k m, last_day(cast(date_trunc('month', date) + to_months(cast(k AS INT)) AS DATE)) expiry FROM panel_bars, (VALUES (0), (1)) t(k)), c AS (SELECT asset, date, 'c' || m contract, close + m - k cl, expiry FROM x0),
    x AS (SELECT *, lag(cl) OVER (PARTITION BY asset, contract ORDER BY date) prev FROM c), h AS (SELECT asset, date, contract, cl FROM x WHERE expiry - date > 2 QUALIFY row_number() OVER (PARTITION BY asset, date ORDER BY expiry) = 1),
    b AS (SELECT *, coalesce(lag(contract) OVER ({W}), contract) hb FROM h), j AS (SELECT b.asset, b.date, b.contract, b.cl, coalesce(x.cl - x.prev, 0) ch FROM b LEFT JOIN x ON x.asset = b.asset AND x.date = b.date AND x.contract = b.hb)
    SELECT asset, date, contract, cl AS "close", {r('ch', '"change"')}, {r('first_value(cl) OVER (PARTITION BY asset ORDER BY date DESC) - coalesce(sum(ch) OVER (PARTITION BY asset ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)', 'adjusted')} FROM j"""
)
def futures_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.rolled(_contracts(spark, sf_dir))
    return rounded(out.withColumn("close", F.col("close").cast("double")))


@query(
    f"""{P}, x0 AS (SELECT asset, date, close, k, year(date) * 12 + month(date) - 1 + k m, last_day(cast(date_trunc('month', date) + to_months(cast(k AS INT)) AS DATE)) expiry FROM panel_bars, (VALUES (0), (1)) t(k)), c AS (SELECT asset, date, k, close + m - k cl, expiry FROM x0)
    SELECT a.asset, a.date, {r('ln(a.cl / b.cl) * 365 / (b.expiry - a.expiry)', 'carry')} FROM c a JOIN c b ON a.asset = b.asset AND a.date = b.date AND a.k = 0 AND b.k = 1"""
)
def roll_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _contracts(spark, sf_dir)
    both = c.groupBy("asset", "date").agg(F.min_by("close", "expiry").alias("front"), F.max_by("close", "expiry").alias("later"), F.datediff(F.max("expiry"), F.min("expiry")).alias("days"))
    return rounded(both.select("asset", "date", risk.carry(F.col("front"), F.col("later"), F.col("days")).alias("carry")))


@query(f"{P} SELECT asset, date, {r(f'-(ln(close) - CASE WHEN count(*) OVER w >= 100 THEN avg(ln(close)) OVER w END)', 'value')} FROM panel_bars WINDOW w AS ({W} ROWS BETWEEN 300 PRECEDING AND 200 PRECEDING)")
def value_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minus the distance of the log price from its mean of a lagged window."""
    w = by_asset().rowsBetween(-300, -200)
    x = F.ln("close")
    return rounded(views.panel_bars(spark, sf_dir).select("asset", "date", (-(x - F.when(F.count("*").over(w) >= 100, F.avg(x).over(w)))).alias("value")))


@query()
def market_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters, greedy choice and spanning-tree degree by year; tests hold their properties."""
    return risk.selections(_pairs(spark, sf_dir), "y")


@query()
def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility behind the daily range, and the slope of the close on the open, both by filters."""
    import numpy as np

    from tidewright.operators import kernels

    base = views.panel_bars(spark, sf_dir).select("asset", "date", "open", "high", "low", "close")
    a = lambda d, c: d[c].to_numpy(float)
    return rounded(kernels.per_asset(base, {"vol": lambda d: kernels.hidden_volatility(a(d, "high"), a(d, "low")), "beta": lambda d: kernels.hedge_ratio(np.log(a(d, "close")), np.log(a(d, "open")))}))
