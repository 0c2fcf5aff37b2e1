"""Queries of tests and resampling."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright import views
from tidewright.functions import normal
from tidewright.functions.windows import r6_sql, rounded
from tidewright.operators import inference as inf
from tidewright.plans.joins import HOURLY, hourly
from tidewright.plans.positions import DAILY, STREAMS, _streams, daily
from tidewright.registry import query
from tidewright.session import table

P, T = f"WITH {views.PANEL_SQL}", f"WITH {views.TAPE_SQL}"
DAY = 86_400_000


def r(x: str, name: str) -> str:
    return f"{r6_sql(x)} AS {name}"


_LAGS = 6
_MEAT = "e AS (SELECT date, net - a - b * x u, (net - a - b * x) * x v FROM d, fit), l AS (" + " UNION ALL ".join(f"SELECT {1.0 if k == 0 else 2 * (1 - k / (_LAGS + 1))!r}::DOUBLE w, u, v, lag(u, {k}) OVER (ORDER BY date) lu, lag(v, {k}) OVER (ORDER BY date) lv FROM e" for k in range(_LAGS + 1)) + "), meat AS (SELECT sum(w * u * lu) m11, sum(w * (u * lv + v * lu) / 2) m12, sum(w * v * lv) m22 FROM l)"


@query(
    f"""{P}, {DAILY}, d AS (SELECT date, net, x FROM (SELECT date, net, lag(net) OVER (ORDER BY date) x FROM daily) WHERE x IS NOT NULL), fit AS (SELECT count(*) n, regr_slope(net, x) b, regr_intercept(net, x) a, regr_r2(net, x) r2, sum(x) sx, sum(x * x) sxx FROM d), {_MEAT},
    i AS (SELECT *, sxx / (n * sxx - sx * sx) i11, -sx / (n * sxx - sx * sx) i12, n / (n * sxx - sx * sx) i22 FROM fit, meat)
    SELECT n, {r('a', 'a')}, {r('b', 'b')}, {r('r2', 'r2')}, {r('a / sqrt(i11 * i11 * m11 + 2 * i11 * i12 * m12 + i12 * i12 * m22)', 't_a')}, {r('b / sqrt(i12 * i12 * m11 + 2 * i12 * i22 * m12 + i22 * i22 * m22)', 't_b')} FROM i"""
)
def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).select("date", "net", F.lag("net").over(Window.orderBy("date")).alias("x"))
    return rounded(inf.ols(d, "net", "x", _LAGS))


@query(
    f"""{T}, {HOURLY}, a AS (SELECT symbol, ts_ms // {DAY} d, cast(tick - lag(tick) OVER (PARTITION BY symbol ORDER BY ts_ms) AS DOUBLE) x FROM hourly), p AS (SELECT symbol, d, sum(x) s, count(x) k FROM a WHERE x IS NOT NULL GROUP BY 1, 2), m AS (SELECT symbol, sum(s) / sum(k) m FROM p GROUP BY 1)
    SELECT symbol, {r('any_value(m)', 'mean')}, {r('sqrt(sum((s - k * m) ** 2) * count(*) / (count(*) - 1)) / sum(k)', 'se')}, count(*) clusters, cast(sum(k) AS BIGINT) n FROM p JOIN m USING (symbol) GROUP BY 1"""
)
def clustered_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    x = h.select("symbol", F.expr(f"ts_ms div {DAY}").alias("d"), (F.col("tick") - F.lag("tick").over(Window.partitionBy("symbol").orderBy("ts_ms"))).cast("double").alias("x"))
    return rounded(inf.clustered_mean(x, ["symbol"], "x", "d"))


SIGN_P = "least(2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 1)"
SIGNS = f"z AS (SELECT stream, count(*) FILTER (r <> 0) n, count(*) FILTER (r > 0) k FROM streams GROUP BY 1)"


@query(f"{P}, {STREAMS}, {SIGNS} SELECT stream, n, k positive, {r(SIGN_P, 'p')} FROM z")
def sign_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inf.sign_test(_streams(spark, sf_dir), ["stream"], "r"))


@query(
    f"""{P}, {STREAMS}, {SIGNS}, p AS (SELECT stream, {r6_sql(SIGN_P)} p FROM z), i AS (SELECT *, row_number() OVER (ORDER BY p, stream) i, count(*) OVER () m FROM p), q AS (SELECT *, min(least(p * m / i, 1)) OVER (ORDER BY i DESC) q FROM i) SELECT stream, p, {r('q', 'q')}, q <= 0.05 rejected FROM q"""
)
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rounded(inf.sign_test(_streams(spark, sf_dir), ["stream"], "r")).select("stream", "p")
    return rounded(inf.benjamini_hochberg(p, "p"))


@query(
    """WITH s AS (SELECT n_chars x, quality = 1 u FROM documents JOIN labels USING (doc_id)), k AS (SELECT u, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 rk FROM s), a AS (SELECT sum(rk) FILTER (u) rs, count(*) FILTER (u) p, count(*) FILTER (NOT u) q FROM k)
    SELECT floor((rs - p * (p + 1) / 2) / (p * q) * 1e6 + 0.5) / 1e6 auc, p n_up, q n_down FROM a"""
)
def rank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("u")), "doc_id")
    return rounded(inf.rank_auc(d, "n_chars", "u"))


_REPS = 50


@query(
    f"""{P}, {DAILY}, s AS (SELECT date_trunc('month', date) m, sum(net) s, count(net) k FROM daily GROUP BY 1), n AS (SELECT row_number() OVER (ORDER BY m) - 1 i, s, k, count(*) OVER () g FROM s), g AS (SELECT count(*) g FROM s),
    p AS (SELECT rep, {inf.draw_sql('0', 'rep', 'j')} % g i FROM range({_REPS}) a(rep), g, (SELECT unnest(range(g)) j FROM g)) SELECT rep, {r('sum(s) / sum(k)', 'mean')} FROM p JOIN n USING (i) GROUP BY 1"""
)
def month_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inf.bootstrap_means(daily(spark, sf_dir).withColumn("m", F.trunc("date", "MM")), "m", "net", _REPS))


@query(
    f"""{P}, {DAILY}, b AS (SELECT row_number() OVER (ORDER BY date) - 1 i, sum(net) OVER w s, count(net) OVER w k FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)), n AS (SELECT * FROM b WHERE k = 20), g AS (SELECT count(*) g FROM n),
    p AS (SELECT rep, {inf.draw_sql('0', 'rep', 'j')} % g i FROM range({_REPS}) a(rep), (SELECT g, unnest(range(cast(ceil(g / 20) AS BIGINT))) j FROM g)) SELECT rep, {r('sum(s) / sum(k)', 'mean')} FROM p JOIN n USING (i) GROUP BY 1"""
)
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inf.block_bootstrap(daily(spark, sf_dir), "date", "net", 20, _REPS))


@query(
    f"""{P}, {DAILY}, d AS (SELECT row_number() OVER (ORDER BY date) - 1 i, exposure p, net r FROM daily), n AS (SELECT count(*) n, sum(p * r) own FROM d), k AS (SELECT rep, n, own, {inf.draw_sql('0', 'rep')} % (n - 1) + 1 k FROM range({_REPS}) a(rep), n),
    s AS (SELECT rep, sum(d.p * e.r) score, any_value(own) own FROM d, k, d e WHERE e.i = (d.i + k) % n GROUP BY 1) SELECT {r('max(own)', 'own')}, {r(f'(1 + count(*) FILTER (score >= own)) / {1.0 + _REPS}', 'p')} FROM s"""
)
def rotation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inf.permutation_p(daily(spark, sf_dir), "exposure", "net", "date", _REPS))


def _splits_sql(blocks: int) -> str:
    import itertools

    rows = [f"({i}, {b}, {'true' if b in inside else 'false'})" for i, inside in enumerate(itertools.combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    return f"sp(split, block, inside) AS (VALUES {', '.join(rows)})"


@query(
    f"""{P}, {STREAMS}, {_splits_sql(6)}, d AS (SELECT date, ntile(6) OVER (ORDER BY date) - 1 block FROM (SELECT DISTINCT date FROM streams)), b AS (SELECT stream, block, sum(r) s, sum(r * r) q, count(r) n FROM streams JOIN d USING (date) GROUP BY 1, 2),
    h AS (SELECT split, stream, inside, sum(s) s, sum(q) q, sum(n) n FROM b JOIN sp USING (block) GROUP BY 1, 2, 3), x AS (SELECT split, stream, inside, s / n / nullif(sqrt(greatest((q - s * s / n) / (n - 1), 0)), 0) x FROM h), w AS (SELECT split, stream, max(x) FILTER (inside) a, max(x) FILTER (NOT inside) b FROM x GROUP BY 1, 2),
    k AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY a DESC, stream) best, rank() OVER (PARTITION BY split ORDER BY b) / (count(*) OVER (PARTITION BY split) + 1.0) omega FROM w)
    SELECT {r('avg(CASE WHEN omega <= 0.5 THEN 1.0 ELSE 0 END)', 'pbo')}, {r('avg(ln(omega / (1 - omega)))', 'logit')}, count(*) splits FROM k WHERE best = 1"""
)
def backtest_overfitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inf.overfitting(_streams(spark, sf_dir), 6))


_EULER = 0.5772156649015329
_Q = [NormalDist().inv_cdf(1 - 1 / x) for x in (18, 18 * 2.718281828459045)]
_BASE = f"sd * ({(1 - _EULER) * _Q[0] + _EULER * _Q[1]!r}::DOUBLE)"


@query(
    f"""{P}, {STREAMS}, m AS (SELECT stream, count(r) n, avg(r) m, avg(r * r) q2, avg(r * r * r) q3, avg(r * r * r * r) q4 FROM streams GROUP BY 1), c AS (SELECT *, q2 - m * m m2, q3 - 3 * m * q2 + 2 * m * m * m m3, q4 - 4 * m * q3 + 6 * m * m * q2 - 3 * m * m * m * m m4 FROM m),
    p AS (SELECT stream, n, m / sqrt(m2) sr, m3 / m2 ** 1.5 g3, m4 / (m2 * m2) g4 FROM c), t AS (SELECT stddev_samp(sr) sd, count(*) tries FROM p), b AS (SELECT p.*, t.* FROM p, t ORDER BY sr DESC, stream DESC LIMIT 1),
    z AS (SELECT *, (sr - {_BASE}) * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr) z FROM b) SELECT stream, {r('sr', 'sharpe')}, {r(_BASE, 'expected')}, {r(normal.cdf_sql('z'), 'dsr')}, tries FROM z"""
)
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inf.deflated_sharpe(_streams(spark, sf_dir)))


_D3 = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {c[1]} * {b[2]}) - {b[0]} * ({a[1]} * {c[2]} - {c[1]} * {a[2]}) + {c[0]} * ({a[1]} * {b[2]} - {b[1]} * {a[2]}))"
_K0, _K1, _K2, _RHS = ("n", "x1", "x2"), ("x1", "x2", "x3"), ("x2", "x3", "x4"), ("y0", "y1", "y2")


@query(
    f"""{P}, {DAILY}, d AS (SELECT net y, lag(net) OVER (ORDER BY date) x FROM daily), s AS (SELECT count(*)::DOUBLE n, sum(x) x1, sum(x ** 2) x2, sum(x ** 3) x3, sum(x ** 4) x4, sum(y) y0, sum(x * y) y1, sum(x * x * y) y2, sum(y * y) yy FROM d WHERE x IS NOT NULL),
    b AS (SELECT *, {_D3(_RHS, _K1, _K2)} / {_D3(_K0, _K1, _K2)} b0, {_D3(_K0, _RHS, _K2)} / {_D3(_K0, _K1, _K2)} b1, {_D3(_K0, _K1, _RHS)} / {_D3(_K0, _K1, _K2)} b2 FROM s)
    SELECT {r('b0', 'b0')}, {r('b1', 'b1')}, {r('b2', 'b2')}, {r('(b0 * y0 + b1 * y1 + b2 * y2 - y0 * y0 / n) / (yy - y0 * y0 / n)', 'r2')} FROM b"""
)
def smile_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests hold it against numpy's least squares."""
    d = daily(spark, sf_dir).select("net", F.lag("net").over(Window.orderBy("date")).alias("x"))
    return rounded(inf.smile(d, "net", "x"))


@query(f"{P}, {DAILY}, d AS (SELECT date, net, lag(net) OVER (ORDER BY date) f FROM daily), m AS (SELECT avg(net) m FROM d WHERE date < DATE '1999-01-01') SELECT {r('1 - sum((net - f) ** 2) / sum((net - m) ** 2)', 'r2')}, count(*) n FROM d, m WHERE date >= DATE '1999-01-01'")
def out_of_sample_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).select("date", "net", F.lag("net").over(Window.orderBy("date")).alias("f"))
    return rounded(inf.out_of_sample_r2(d, "net", "f", F.col("date") < F.lit("1999-01-01").cast("date")))


@query(
    f"""{P}, {STREAMS}, s AS (SELECT row_number() OVER (ORDER BY stream) - 1 i, s FROM (SELECT stream, sum(r) s FROM streams GROUP BY 1)), h AS (SELECT rep, s, {inf.draw_sql('0', 'rep', 'i')} % 2 = 0 l FROM s, range({_REPS}) a(rep)),
    p AS (SELECT rep, coalesce(sum(s) FILTER (l), 0) a, coalesce(sum(s) FILTER (NOT l), 0) b FROM h GROUP BY 1) SELECT {r('avg(CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE 0 END)', '"share"')}, count(*) splits FROM p"""
)
def half_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inf.split_pass_share(_streams(spark, sf_dir), _REPS))


@query()
def logit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests hold it against a Newton iteration in numpy."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.ln(F.col("n_chars") + 1).alias("ln_chars"))
    return rounded(inf.logit(d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"), "quality", ["ln_chars"]))
