"""Queries of aggregations, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions.windows import r6_sql, rounded
from tidewright.operators import aggregates as agg
from tidewright.operators.rolling import simple_return
from tidewright.registry import query
from tidewright.session import table

P = f"WITH {views.PANEL_SQL}"
T = f"WITH {views.TAPE_SQL}"
W = "PARTITION BY asset ORDER BY date"


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


def _usd() -> F.Column:
    return (F.col("tick") * F.col("lots")).alias("usd")


@query(f"""{T} SELECT symbol, count(*) n, cast(sum(lots) AS BIGINT) lots, min(tick) lo, max(tick) hi, {r('sum(tick * lots) / sum(lots)', 'vwap')}, cast(sum(lots) FILTER (NOT is_buyer_maker) AS BIGINT) bought, count(DISTINCT tick) prices,
    count(DISTINCT ts_ms // 86400000) AS "days", max_by(tick, (ts_ms, id)) FILTER (is_buyer_maker) last_bid, max_by(tick, (ts_ms, id)) FILTER (NOT is_buyer_maker) last_ask FROM tape GROUP BY 1""")
def grouped_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    buy, at = ~F.col("is_buyer_maker"), F.struct("ts_ms", "id")
    return rounded(
        views.tape(spark, sf_dir).groupBy("symbol").agg(
            F.count("*").alias("n"), F.sum("lots").alias("lots"), F.min("tick").alias("lo"), F.max("tick").alias("hi"), (F.sum(F.col("tick") * F.col("lots")) / F.sum("lots")).alias("vwap"),
            F.sum(F.when(buy, F.col("lots"))).alias("bought"), F.countDistinct("tick").alias("prices"), F.countDistinct(F.expr("ts_ms div 86400000")).alias("days"),
            F.max_by("tick", F.when(~buy, at)).alias("last_bid"), F.max_by("tick", F.when(buy, at)).alias("last_ask"),
        )
    )


@query(f"{T}, s AS (SELECT symbol, tick, row_number() OVER (PARTITION BY symbol ORDER BY tick) - 1 k, count(*) OVER (PARTITION BY symbol) n FROM tape) SELECT symbol, " + ", ".join(f"max(tick) FILTER (k = floor({q} * (n - 1) + 0.5)) q{str(q)[2:]}" for q in (0.5, 0.9, 0.99, 0.999)) + " FROM s GROUP BY 1")
def nearest_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.nearest_quantiles(views.tape(spark, sf_dir), ["symbol"], "tick", [0.5, 0.9, 0.99, 0.999])


BINS = "bins AS (SELECT symbol, cast(floor(least(greatest(log10(tick * lots), 0), 8.999) / 0.05) AS BIGINT) bin, count(*) n, sum(tick * lots) total FROM tape GROUP BY 1, 2)"


@query(f"{T}, {BINS} SELECT symbol, bin, n, cast(total AS BIGINT) total FROM bins")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.binned(views.tape(spark, sf_dir).select("symbol", _usd()), ["symbol"], "usd").withColumnRenamed("usd", "total")


@query(f"{T}, {BINS}, u AS (SELECT symbol, bin, sum(n) OVER (PARTITION BY symbol ORDER BY bin) upto, sum(n) OVER (PARTITION BY symbol) al FROM bins) SELECT symbol, min(bin) bin FROM u WHERE upto >= 0.9 * al GROUP BY 1")
def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.binned_quantile(agg.binned(views.tape(spark, sf_dir).select("symbol", _usd()), ["symbol"], "usd"), ["symbol"], 0.9)


@query(
    f"""{T}, {BINS}, u AS (SELECT *, sum(n) OVER d above, sum(n) OVER (PARTITION BY symbol) al, sum(total) OVER (PARTITION BY symbol) ta FROM bins WINDOW d AS (PARTITION BY symbol ORDER BY bin DESC))
    SELECT symbol, {r('sum(least(greatest((0.1 * al - (above - n)) / n, 0), 1) * total) / max(ta)', 'top_share')}, {r('-regr_slope(ln(above / al), bin * 0.05 * 2.302585092994046)', 'tail')} FROM u GROUP BY 1"""
)
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.concentration(agg.binned(views.tape(spark, sf_dir).select("symbol", _usd()), ["symbol"], "usd"), ["symbol"], 0.1))


@query(
    f"""{P}, a AS (SELECT asset, ln(close) x FROM panel_bars), s AS (SELECT asset, count(x) c, count(x)::DOUBLE n, avg(x) m, sum(x ** 2) s2, sum(x ** 3) s3, sum(x ** 4) s4, quantile_cont(x, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) o FROM a GROUP BY 1),
    t AS (SELECT *, s2 / n - m * m m2, s3 / n - 3 * m * s2 / n + 2 * m * m * m m3, s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m * m * m * m m4 FROM s)
    SELECT asset, c n, {r('sqrt(n * (n - 1)) / (n - 2) * m3 / m2 ** 1.5', 'skew')}, {r('(n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6)', 'kurtosis')}, {r('(o[6] + o[2] - 2 * o[4]) / (o[6] - o[2])', 'bowley')}, {r('(o[7] - o[5] + o[3] - o[1]) / (o[6] - o[2])', 'moors')} FROM t"""
)
def distribution_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.shape(views.panel_bars(spark, sf_dir).select("asset", F.ln("close").alias("x")), ["asset"], "x"))


LAGS = [1, 2, 5, 10]
_LAGGED = " UNION ALL ".join(f"SELECT symbol, {k} lag, x, lag(x, {k}) OVER (PARTITION BY symbol ORDER BY ts_ms, id) y FROM s" for k in LAGS)


@query(
    f"""{T}, s AS (SELECT symbol, ts_ms, id, CASE WHEN is_buyer_maker THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END x FROM tape), l AS ({_LAGGED}), t AS (SELECT symbol, lag, count(*) n, sum(x) sx, sum(y) sy, sum(x * x) sxx, sum(y * y) syy, sum(x * y) sxy FROM l WHERE y IS NOT NULL GROUP BY 1, 2)
    SELECT symbol, lag, n, {r('(sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))', '"corr"')} FROM t"""
)
def lag_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = views.tape(spark, sf_dir).select("symbol", "ts_ms", "id", F.when(F.col("is_buyer_maker"), -1.0).otherwise(1.0).alias("x"))
    return rounded(agg.lag_correlation(agg.lag_sums(signs, ["symbol"], ["ts_ms", "id"], "x", LAGS), ["symbol"]))


@query(
    """WITH s AS (SELECT lang, quality = 1 up, least(floor(least(n_chars / 20000.0::DOUBLE, 1) * 4000), 3999) b FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, b, count(*) FILTER (up) u, count(*) FILTER (NOT up) d FROM s GROUP BY 1, 2),
    e AS (SELECT *, u * (sum(d) OVER (PARTITION BY lang ORDER BY b) - d + 0.5 * d) won FROM c) SELECT lang, floor(sum(won) / nullif(sum(u) * sum(d), 0) * 1e6 + 0.5) / 1e6 auc, cast(sum(u) AS BIGINT) n_up, cast(sum(d) AS BIGINT) n_down FROM e GROUP BY 1"""
)
def binned_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select("doc_id", "lang", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("score")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("up")), "doc_id")
    return rounded(agg.auc_from_bins(scored, ["lang"], "score", "up"))


_RESAMPLE = 'min_by(open, date) open, max(high) high, min(low) low, max_by(close, date) "close", sum(volume) volume, count(*) bars FROM panel_bars GROUP BY 1, 2'


@query(f"{P} SELECT asset, cast(date_trunc('week', date + 2) AS DATE) + 4 bucket, {_RESAMPLE}")
def friday_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.resample(views.panel_bars(spark, sf_dir), agg.friday_week(F.col("date")))


@query(f"{P} SELECT asset, cast(date_trunc('month', date) AS DATE) bucket, {_RESAMPLE}")
def month_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.resample(views.panel_bars(spark, sf_dir), F.trunc("date", "MM"))


@query(f"{P}, a AS (SELECT asset, date, close / lag(close) OVER ({W}) - 1 r FROM panel_bars) SELECT asset, cast(date_trunc('quarter', date) AS DATE) AS \"quarter\", count(r) n, {r('sum(r)', 's')}, {r('sum(r * r)', 'q')} FROM a GROUP BY 1, 2")
def quarter_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = views.panel_bars(spark, sf_dir).select("asset", "date", simple_return(F.col("close")).alias("r"))
    return rounded(base.groupBy("asset", F.trunc("date", "quarter").alias("quarter")).agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q")))


@query(f"{P} SELECT year(date) AS \"year\", " + ", ".join(f"sum(trades) FILTER (asset = '{a}')::BIGINT {a}" for a in ("AF", "NF", "NO", "RF")) + " FROM panel_bars GROUP BY 1")
def pivot_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.panel_bars(spark, sf_dir).groupBy(F.year("date").cast("long").alias("year")).pivot("asset", ["AF", "NF", "NO", "RF"]).agg(F.sum("trades"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) n, cast(sum(cast(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) cents FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("c", F.round(F.col("o_totalprice") * 100).cast("long"))
    a, b = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.groupingSets([[a, b], [a], []], a, b).agg(F.count("*").alias("n"), F.sum("c").alias("cents"))


@query("SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN -cast(l_quantity AS DECIMAL(18, 2)) ELSE cast(l_quantity AS DECIMAL(18, 2)) END)::DOUBLE AS \"position\" FROM lineitem GROUP BY 1")
def ledger_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net position by side, added as exact decimals."""
    q = F.col("l_quantity").cast("decimal(18,2)")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", -q).otherwise(q)).cast("double").alias("position"))


@query(f"{P}, a AS (SELECT asset, date, abs(close / lag(close) OVER ({W}) - 1) m FROM panel_bars) SELECT asset, date, {r('m', 'm')}, row_number() OVER (PARTITION BY asset ORDER BY m DESC NULLS LAST, date) AS \"rank\" FROM a QUALIFY \"rank\" <= 12")
def largest_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = views.panel_bars(spark, sf_dir).select("asset", "date", F.abs(simple_return(F.col("close"))).alias("m"))
    return rounded(agg.top_k(base, ["asset"], [F.desc_nulls_last("m"), F.asc("date")], 12))


@query(f"{P} SELECT asset, arg_max(date, (close, date)) top_date, arg_min(date, (close, date)) low_date, min(date) FILTER (close > 1500) first_above FROM panel_bars GROUP BY 1")
def arg_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.panel_bars(spark, sf_dir).groupBy("asset").agg(F.max_by("date", F.struct("close", "date")).alias("top_date"), F.min_by("date", F.struct("close", "date")).alias("low_date"), F.min(F.when(F.col("close") > 1500, F.col("date"))).alias("first_above"))


@query(f"{P}, d AS (SELECT asset, date FROM panel_bars), i AS (SELECT date FROM d WHERE asset = 'AF' INTERSECT SELECT date FROM d WHERE asset = 'RF'), e AS (SELECT date FROM i EXCEPT SELECT date FROM d WHERE asset = 'NF'), u AS (SELECT date FROM e UNION SELECT date FROM d WHERE asset = 'NO') SELECT date FROM u")
def day_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.panel_bars(spark, sf_dir).select("asset", "date")
    of = lambda a: d.where(F.col("asset") == a).select("date")
    return of("AF").intersect(of("RF")).subtract(of("NF")).union(of("NO")).distinct()


@query(f"{T}, a AS (SELECT *, ts_ms // 86400000 d FROM tape), b AS (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY id) i, row_number() OVER (PARTITION BY symbol, d ORDER BY (id * 1103515245 + 12345) % 2147483648, id) j FROM a) SELECT x.id, x.symbol, x.d, x.lots, y.lots shuffled FROM b x JOIN b y ON x.symbol = y.symbol AND x.d = y.d AND x.i = y.j")
def block_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tape(spark, sf_dir).select("id", "symbol", F.expr("ts_ms div 86400000").alias("d"), "lots")
    return agg.shuffled(t, ["symbol", "d"], "id", "lots")


@query("SELECT c_custkey AS k, c_acctbal AS v, NULL::VARCHAR AS \"label\" FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier ORDER BY 1, 2, 3")
def union_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("label"))
    return a.unionByName(b, allowMissingColumns=True).orderBy("k", "v", "label")
