"""Queries of fitted and carried matrices. Whole results are held against numpy in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import by_asset, r6_sql, rounded
from tidewright.operators import risk, selection
from tidewright.registry import query
from tidewright.session import table

P = f"WITH {views.PANEL_SQL}"
W = "PARTITION BY asset ORDER BY date"
#: Common days that a pair needs in three years: few, as the assets of these tables do not trade every day.
LEAST = 60
TRAILING = f"""q_ AS (SELECT asset, date, close / lag(close) OVER ({W}) - 1 r FROM panel_bars), z_ AS (SELECT asset, date, r / CASE WHEN count(r) OVER w >= 60 THEN stddev_samp(r) OVER w END r FROM q_ WINDOW w AS ({W} ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)),
    d_ AS (SELECT date, (row_number() OVER (ORDER BY date) - 1) // 21 b FROM (SELECT DISTINCT date FROM panel_bars)), x_ AS (SELECT b, z_.date, asset, r FROM z_ JOIN d_ USING (date) WHERE r IS NOT NULL), s_ AS (SELECT DISTINCT b "block" FROM d_),
    t_ AS (SELECT "block", x.asset a, y.asset b, count(*) n, covar_samp(x.r, y.r) cov, var_samp(x.r) va, var_samp(y.r) vb FROM s_ JOIN x_ x ON x.b >= "block" - 36 AND x.b < "block" JOIN x_ y ON x.date = y.date AND x.asset <= y.asset GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST})"""


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("close")
    return views.panel_bars(spark, sf_dir).select("asset", "date", (c / F.lag(c).over(by_asset()) - 1).alias("r"))


@query(f"{P}, {TRAILING} SELECT \"block\", a, b, n, {r6_sql('cov')} AS cov, {r6_sql('va')} AS va, {r6_sql('vb')} AS vb, {r6_sql('cov / sqrt(va * vb)')} AS \"corr\" FROM t_")
def trailing_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of scaled returns over the 756 days before every 21st day."""
    return rounded(selection.trailing_pairs(selection.scaled_returns(returns(spark, sf_dir)), least=LEAST))


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of the embeddings as assets, their vectors as days, a label as a period: a pair table over any number of rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("y"), F.col("vec_id").alias("i"), F.posexplode("embedding").alias("d", "r"))
    return risk.pairs(e.select("y", "i", F.format_string("d%03d", "d").alias("asset"), F.col("r").cast("double").alias("r")), "y", 5)


@query()
def noise_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.noise_bands(embedding_pairs(spark, sf_dir), "y"))


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.plans.risk import _pairs

    return _pairs(spark, sf_dir)


@query()
def sparse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.sparse_links(yearly(spark, sf_dir), "y", [0.02, 0.05, 0.1]))


@query()
def spectral_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly weights with 30 % of the risk on the first component, carried from year to year."""
    return rounded(selection.carried_spectral(yearly(spark, sf_dir), "y", 0.3))


@query()
def class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by class after each year's review: return flags as classes, traded volume as liquidity."""
    x = views.panel_bars(spark, sf_dir)
    info = x.groupBy(F.year("date").cast("long").alias("y"), "asset").agg(F.avg("volume").cast("double").alias("liquidity")).withColumn("class", F.substring("asset", 1, 1))
    return selection.class_first(yearly(spark, sf_dir), info, "y", 60.0, 4, 1)
