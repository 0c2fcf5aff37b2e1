"""Order flow: imbalances, costs of taking and resting, sweeps, propagation, volume-synchronised toxicity, lead and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import normal
from tidewright.functions.windows import by_asset, divide, rolling, trailing, upto
from tidewright.operators.asof import asof, horizons
from tidewright.operators.ranges import passages
from tidewright.operators.rolling import simple_return

DAY = 86_400_000


def side() -> Column:
    return F.when(F.col("is_buyer_maker"), -1).otherwise(1)


def volume_signals(panel: DataFrame, n: int = 27, vol: int = 20) -> DataFrame:
    """On-balance volume, tick-rule imbalance over n bars, and bulk volume classification (2 Φ(r / σ before) - 1) V."""
    w = by_asset()
    base = panel.select("asset", "date", "volume", simple_return(F.col("close")).alias("r"), F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)).alias("s"))
    signed = base.select("*", (F.col("s") * F.col("volume")).alias("sv"), rolling(F.stddev_samp, F.col("r"), w, vol, lag=1).alias("sd"))
    return signed.select(
        "asset",
        "date",
        F.sum("sv").over(upto(w)).alias("obv"),
        divide(F.sum("sv").over(trailing(w, n)), F.sum("volume").over(trailing(w, n))).alias("imbalance"),
        ((2 * normal.cdf(divide(F.col("r"), F.col("sd"))) - 1) * F.col("volume")).alias("bvc"),
    )


def mids(tape: DataFrame) -> DataFrame:
    """(symbol, ts_ms, mid): after each trade, half the last buy plus half the last sell, one row a time; times with both only."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.when(c, F.col("tick")), ignorenulls=True).over(w)
    q = tape.select("symbol", "ts_ms", "id", last(~F.col("is_buyer_maker")).alias("ask"), last(F.col("is_buyer_maker")).alias("bid")).where("ask IS NOT NULL AND bid IS NOT NULL")
    return q.groupBy("symbol", "ts_ms").agg(F.max_by((F.col("ask") + F.col("bid")) / 2, "id").alias("mid"))


def trade_costs(tape: DataFrame, steps: list[int]) -> DataFrame:
    """By symbol: effective spread against the mid strictly before the trade, and what is left of it (realised) after each step, in bp."""
    m = mids(tape)
    before = asof(tape.select("id", "symbol", "ts_ms", side().alias("side"), "tick"), m, "symbol", "ts_ms", ["mid"], strict=True).where("mid IS NOT NULL").drop("ts_ms_matched").withColumnRenamed("mid", "before")
    later = horizons(before, m, "symbol", "ts_ms", "mid", steps)
    cost = lambda x: 1e4 * F.avg(F.col("side") * (F.col("tick") - x) / F.col("before"))
    return later.groupBy("symbol").agg(F.count("*").alias("n"), cost(F.col("before")).alias("effective"), *[cost(F.col(f"mid_{s}")).alias(f"realised_{s}") for s in steps])


def markouts(tape: DataFrame, steps: list[int]) -> DataFrame:
    """Size-weighted result of the resting side after each step, by size bucket."""
    rows = tape.select("id", "symbol", "ts_ms", side().alias("side"), "tick", "lots")
    later = horizons(rows, mids(tape), "symbol", "ts_ms", "mid", steps)
    bucket = F.when(F.col("lots") <= 5, "small").when(F.col("lots") <= 20, "medium").otherwise("large")
    mo = lambda s: divide(F.sum(F.col("lots") * -F.col("side") * (F.col(f"mid_{s}") - F.col("tick"))), F.sum(F.when(F.col(f"mid_{s}").isNotNull(), F.col("lots"))).cast("double"))
    return later.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), *[mo(s).alias(f"markout_{s}") for s in steps])


def sweeps(orders: DataFrame, tape: DataFrame, least: int, steps: list[int]) -> DataFrame:
    """Orders that moved the price by at least ``least`` ticks, with the price before them and at each step after."""
    last = tape.groupBy("symbol", "ts_ms").agg(F.max_by("tick", "id").alias("price"))
    before = asof(orders, last, "symbol", "ts_ms", ["price"], strict=True).withColumnRenamed("price", "before").drop("ts_ms_matched")
    moved = before.where(F.abs(F.col("last_tick") - F.col("before")) >= least)
    return horizons(moved, last, "symbol", "ts_ms", "price", steps)


def resting(tape: DataFrame, minutes: int, hold_ms: int) -> DataFrame:
    """An order left at the last price at the start of each slot: filled if a trade goes through it within ``hold_ms``, by symbol and side.

    First fills come from an equi-join on slots: an order meets only trades of its own slot.
    """
    slot = minutes * 60_000
    t = tape.withColumn("slot", F.floor(F.col("ts_ms") / slot))
    start = t.groupBy("symbol", "slot").agg(F.min_by("tick", F.struct("ts_ms", "id")).alias("price"), F.min(F.struct("ts_ms", "id")).alias("s"))
    after = t.join(start, ["symbol", "slot"]).where((F.struct("ts_ms", "id") > F.col("s")) & (F.col("ts_ms") <= F.col("s.ts_ms") + hold_ms))
    hit = after.groupBy("symbol", "slot").agg(F.min(F.when(F.col("tick") < F.col("price"), F.col("ts_ms"))).alias("bid_fill"), F.min(F.when(F.col("tick") > F.col("price"), F.col("ts_ms"))).alias("ask_fill"), F.max_by("tick", F.struct("ts_ms", "id")).alias("end"))
    all_ = start.join(hit, ["symbol", "slot"], "left")
    return all_.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(F.col("bid_fill").isNotNull().cast("double")).alias("bid_filled"), F.avg(F.col("ask_fill").isNotNull().cast("double")).alias("ask_filled"), F.avg(F.when(F.col("bid_fill").isNull(), F.col("end") - F.col("price"))).alias("bid_missed"))


def kyle(tape: DataFrame, ms: int) -> DataFrame:
    """By symbol: slopes of the price change of a block on its signed flow (linear, through the origin, signed root)."""
    at = F.struct("ts_ms", "id")
    b = tape.groupBy("symbol", F.floor(F.col("ts_ms") / ms).alias("b")).agg(F.sum(side() * F.col("lots")).cast("double").alias("q"), (F.max_by("tick", at) - F.min_by("tick", at)).cast("double").alias("dp"))
    root = F.signum("q") * F.sqrt(F.abs("q"))
    return b.groupBy("symbol").agg(F.count("*").alias("n"), F.regr_slope("dp", "q").alias("lam"), divide(F.sum(F.col("q") * F.col("dp")), F.sum(F.col("q") * F.col("q"))).alias("lam0"), divide(F.sum(root * F.col("dp")), F.sum(root * root)).alias("root"), F.regr_r2("dp", "q").alias("r2"))


def vpin(tape: DataFrame, bucket: int, n: int) -> DataFrame:
    """Equal-volume buckets, trades split at their edges in proportion, and the mean absolute imbalance of the last n."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", "id")
    run = tape.select("symbol", "ts_ms", "id", "lots", side().alias("side"), F.sum("lots").over(w).alias("upto"))
    lo, hi = F.floor((F.col("upto") - F.col("lots")) / bucket), F.floor((F.col("upto") - 1) / bucket)
    split = run.select("*", F.explode(F.sequence(lo, hi)).alias("bucket"))
    part = F.least("upto", (F.col("bucket") + 1) * bucket) - F.greatest(F.col("upto") - F.col("lots"), F.col("bucket") * bucket)
    b = split.select("symbol", "bucket", "side", "ts_ms", part.alias("part")).groupBy("symbol", "bucket").agg(F.max("ts_ms").alias("end_ms"), F.sum("part").alias("volume"), F.abs(F.sum(F.col("side") * F.col("part"))).alias("net"))
    full = b.where(F.col("volume") == bucket)
    v = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(-(n - 1), 0)
    return full.select("symbol", "bucket", "end_ms", F.when(F.count("*").over(v) >= n, F.sum("net").over(v) / (n * bucket)).alias("vpin"))


def response(tape: DataFrame, lags: list[int]) -> DataFrame:
    """Sign autocorrelation C(l) and price response R(l) = mean sign (p(t + l) - p(t)), by symbol and lag: inputs of the propagator."""
    w = Window.partitionBy("symbol").orderBy("ts_ms", "id")
    ls = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead(side(), k).over(w).alias("s2"), F.lead("tick", k).over(w).alias("p2")) for k in lags])
    each = tape.select("symbol", side().alias("s"), "tick", ls.alias("l")).select("symbol", "s", "tick", F.inline("l")).where("p2 IS NOT NULL")
    return each.groupBy("symbol", "lag").agg(F.avg(F.col("s") * F.col("s2")).alias("c"), F.avg(F.col("s") * (F.col("p2") - F.col("tick"))).alias("r"), F.count("*").alias("n"))


def lead_lag(a: DataFrame, b: DataFrame, lags: list[int]) -> DataFrame:
    """Hayashi-Yoshida covariance of two venues' price changes by shift of the second, normed: intervals that overlap share an hour's bucket, so pairs meet by equi-join."""
    def changes(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("symbol").orderBy("ts_ms")
        one = df.groupBy("symbol", "ts_ms").agg(F.max_by("tick", "id").alias("p"))
        return one.select("symbol", F.lag("ts_ms").over(w).alias("s"), F.col("ts_ms").alias("e"), (F.col("p") - F.lag("p").over(w)).alias("d")).where("s IS NOT NULL AND d <> 0")

    x, y = changes(a), changes(b)
    size = 3_600_000
    over = lambda df: df.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.col("e") - 1) / size))))
    shifted = y.select("symbol", F.explode(F.array(*map(F.lit, lags))).alias("lag"), "s", "e", F.col("d").alias("d2")).select("symbol", "lag", (F.col("s") - F.col("lag")).alias("s"), (F.col("e") - F.col("lag")).alias("e"), "d2")
    pairs = over(x).join(over(shifted).select("symbol", "b", "lag", F.col("s").alias("s2"), F.col("e").alias("e2"), "d2"), ["symbol", "b"]).where("s < e2 AND s2 < e")
    # a pair that shares several buckets counts in the first of them
    once = pairs.where(F.col("b") == F.floor(F.greatest("s", "s2") / size))
    norm = x.groupBy("symbol").agg(F.sum(F.col("d") * F.col("d")).alias("xx")).join(y.groupBy("symbol").agg(F.sum(F.col("d") * F.col("d")).alias("yy")), "symbol")
    return once.groupBy("symbol", "lag").agg(F.sum(F.col("d") * F.col("d2")).alias("xy")).join(norm, "symbol").select("symbol", "lag", divide(F.col("xy").cast("double"), F.sqrt(F.col("xx").cast("double") * F.col("yy"))).alias("rho"))


def average_ranks(df: DataFrame, keys: list[str], x: str) -> Column:
    w = Window.partitionBy(*keys).orderBy(x)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2.0


def value_ranks(counts: DataFrame, keys: list[str], x: str, pieces: int = 64) -> DataFrame:
    """(keys, x, rank) of counts (keys, x, __k), one row a value: ranks of the rows counted, less the mean rank of the key, ties averaged. A key with many values is cut at its quantiles, ranked
    piece by piece, and the pieces' totals are added."""
    bounds = counts.groupBy(*keys).agg(F.percentile_approx(x, [i / pieces for i in range(1, pieces)], 1000).alias("__q"), F.sum("__k").alias("__n"))
    cut = counts.join(F.broadcast(bounds), keys).select(*keys, x, "__k", "__n", F.size(F.filter("__q", lambda q: q < F.col(x))).alias("__piece"))
    own = Window.partitionBy(*keys).orderBy("__piece")
    totals = cut.groupBy(*keys, "__piece").agg(F.sum("__k").alias("__t")).select(*keys, "__piece", (F.sum("__t").over(own) - F.col("__t")).alias("__before"))
    upto = F.sum("__k").over(Window.partitionBy(*keys, "__piece").orderBy(x))
    ranked = cut.withColumn("__upto", upto).join(F.broadcast(totals), [*keys, "__piece"])
    return ranked.select(*keys, x, (F.col("__before") + F.col("__upto") - F.col("__k") / 2.0 - F.col("__n") / 2.0).alias("rank"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation by keys, ties averaged. Rows are counted by their pair of values first, and again by each value, so that what is ranked is values, not rows."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("__k"))
    count = lambda c: pairs.groupBy(*keys, c).agg(F.sum("__k").alias("__k"))
    rx = value_ranks(count(x), keys, x).withColumnRenamed("rank", "__rx")
    ry = value_ranks(count(y), keys, y).withColumnRenamed("rank", "__ry")
    s = lambda a, b: F.sum(F.col(a) * F.col(b) * F.col("__k"))
    return pairs.join(rx, [*keys, x]).join(ry, [*keys, y]).groupBy(*keys).agg(divide(s("__rx", "__ry"), F.sqrt(s("__rx", "__rx") * s("__ry", "__ry"))).alias("rho"), F.sum("__k").alias("n"))


def sliced_spearman(df: DataFrame, keys: list[str], x: str, y: str, slices: dict[str, Column]) -> DataFrame:
    """(keys, slice, rho, n): the rank correlation within each named condition, to see whether one of all rows is made by the slices' own levels (Simpson's paradox). Ranks are of the slice."""
    named = F.explode(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in slices.items()]), lambda s: s.isNotNull())).alias("slice")
    return spearman(df.select(*keys, x, y, named), [*keys, "slice"], x, y)


def flow_fifths(tape: DataFrame, ms: int) -> DataFrame:
    """Blocks by fifth of their signed flow: the move inside and in the next block, and its standard error clustered by day."""
    at = F.struct("ts_ms", "id")
    b = tape.groupBy("symbol", F.floor(F.col("ts_ms") / ms).alias("b")).agg(F.sum(side() * F.col("lots")).alias("q"), F.min_by("tick", at).alias("open"), F.max_by("tick", at).alias("close"))
    nxt = b.select("symbol", (F.col("b") - 1).alias("b"), (F.col("close") - F.col("open")).alias("next"))
    w = Window.partitionBy("symbol").orderBy("q", "b")
    five = b.join(nxt, ["symbol", "b"]).select("symbol", F.floor(F.col("b") * ms / DAY).alias("day"), (F.col("close") - F.col("open")).alias("move"), "next", F.ntile(5).over(w).cast("long").alias("fifth"))
    means = five.groupBy("symbol", "fifth").agg(F.avg("move").alias("move"), F.avg("next").alias("mean"), F.count("*").alias("n"))
    days = five.groupBy("symbol", "fifth", "day").agg(F.sum("next").alias("s"), F.count("*").alias("k")).join(means, ["symbol", "fifth"])
    e = F.col("s") - F.col("k") * F.col("mean")
    g = F.count("*")
    return days.groupBy("symbol", "fifth").agg(F.max("move").alias("move"), F.max("mean").alias("mean"), F.max("n").alias("n"), (F.sqrt(F.sum(e * e) * g / (g - 1)) / F.max("n")).alias("se"))


def styles(orders: DataFrame) -> DataFrame:
    """Share of lots by style and hour; the first rule that fits names an order: sliced (the size of the one before), large, other."""
    w = Window.partitionBy("symbol", F.expr("ts_ms div 3600000")).orderBy("ts_ms", "n")
    x = orders.withColumn("hour", F.expr("ts_ms div 3600000")).withColumn("sliced", (F.lag("lots").over(w) == F.col("lots")) & (F.lag("side").over(w) == F.col("side")))
    style = F.when(F.coalesce("sliced", F.lit(False)), "sliced").when(F.col("lots") >= 40, "large").otherwise("other")
    per = x.groupBy("symbol", "hour", style.alias("style")).agg(F.sum("lots").alias("lots"))
    return per.select("symbol", "hour", "style", (F.col("lots") / F.sum("lots").over(Window.partitionBy("symbol", "hour"))).alias("share"))


def capacity(panel: DataFrame, n: int = 20, bins: int = 10) -> DataFrame:
    """Mean |move| / σ by quantile bin of relative volume, and the log-log slope over the bins."""
    w = by_asset()
    base = panel.select("asset", "date", "volume", simple_return(F.col("close")).alias("r"))
    x = base.select("asset", "date", divide(F.col("volume"), rolling(F.avg, F.col("volume"), w, n, lag=1)).alias("x"), divide(F.abs("r"), rolling(F.stddev_samp, F.col("r"), w, n, lag=1)).alias("y")).where("x > 0 AND y > 0")
    binned = x.select("x", "y", F.ntile(bins).over(Window.partitionBy("asset").orderBy("x", "date")).cast("long").alias("bin")).groupBy("bin").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    slope = binned.agg(F.regr_slope(F.ln("y"), F.ln("x")).alias("slope"))
    return binned.crossJoin(F.broadcast(slope))  # one row


def window_pvalue(hours: DataFrame, at: int) -> DataFrame:
    """By symbol and day, the activity of one hour of the day against the same hour of all days: p = (1 + number at least as large) / (1 + n)."""
    h = hours.where(F.pmod(F.expr("ts_ms div 3600000"), F.lit(24)) == at)
    w = Window.partitionBy("symbol").orderBy(F.desc("lots"))
    n = F.count("*").over(Window.partitionBy("symbol"))
    return h.select("symbol", "ts_ms", "lots", (F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 0)) / n).alias("p"))


def early_warning(hours: DataFrame, fit_until: int, q: float = 0.95) -> DataFrame:
    """Flags of hours whose activity or move exceeds its quantile of the hours before ``fit_until``, and the lead to the next hour with the largest kind of move."""
    w = Window.partitionBy("symbol").orderBy("ts_ms")
    x = hours.withColumn("move", F.abs(F.col("tick") - F.lag("tick").over(w)))
    limits = x.where(F.col("ts_ms") < fit_until).groupBy("symbol").agg(F.percentile("lots", F.lit(q)).alias("l_lots"), F.percentile("move", F.lit(q)).alias("l_move"))
    f = x.where(F.col("ts_ms") >= fit_until).join(limits, "symbol").withColumn("active", F.col("lots") > F.col("l_lots")).withColumn("event", F.col("move") > F.col("l_move"))
    nxt = F.min(F.when(F.col("event"), F.col("ts_ms"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    return f.select("symbol", "ts_ms", "active", "event", nxt.alias("next_ms")).where("active").select("symbol", "ts_ms", "event", ((F.col("next_ms") - F.col("ts_ms")) / 3_600_000).alias("lead_hours"))


def cascades(hours: DataFrame) -> DataFrame:
    """Linear probability of a top-fifth move in the next hour given a top-fifth hour of flow now: slope with its standard error clustered by day."""
    w = Window.partitionBy("symbol").orderBy("ts_ms")
    base = hours.select("symbol", "ts_ms", "lots", F.abs(F.col("tick") - F.lag("tick").over(w)).alias("move")).where("move IS NOT NULL")
    five = base.select("symbol", "ts_ms", (F.ntile(5).over(Window.partitionBy("symbol").orderBy("lots", "ts_ms")) == 5).cast("double").alias("x"), (F.ntile(5).over(Window.partitionBy("symbol").orderBy("move", "ts_ms")) == 5).cast("double").alias("m"))
    xy = five.select("symbol", F.expr(f"ts_ms div {DAY}").alias("day"), "x", F.lead("m").over(w).alias("y")).where("y IS NOT NULL")
    fit = xy.groupBy("symbol").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("x").alias("mx"), F.count("*").alias("n"), F.var_pop("x").alias("vx"))
    scores = xy.join(fit, "symbol").groupBy("symbol", "day").agg(F.sum((F.col("x") - F.col("mx")) * (F.col("y") - F.col("a") - F.col("b") * F.col("x"))).alias("s"))
    g = F.count("*")
    return scores.join(fit, "symbol").groupBy("symbol").agg(F.max("b").alias("slope"), (F.sqrt(F.sum(F.col("s") * F.col("s")) * g / (g - 1)) / F.max(F.col("n") * F.col("vx"))).alias("se"), F.max("n").alias("n"))


def queue_fills(orders: DataFrame, tape: DataFrame, hold_ms: int, leaves: int = 512) -> DataFrame:
    """When a resting order (id, symbol, ts_ms, tick, side) is touched (Q0) and traded through (Q1) within ``hold_ms``: two first passages of the price,
    searched together in spans of ``hold_ms``."""
    down = F.col("side") < 0
    return passages(orders, tape, ["symbol"], "ts_ms", {"q0_ms": (F.col("tick"), F.col("tick"), down), "q1_ms": (F.col("tick") - F.col("side"), F.col("tick"), down)}, hold_ms, max(1, hold_ms // leaves))


def latency_walk(levels: DataFrame, size: float, steps: int = 1) -> DataFrame:
    """Price met against price expected when an order of ``size`` arrives ``steps`` checkpoints later."""
    from tidewright.operators.book import walk

    p = walk(levels, size).select("moment", "price")
    w = Window.orderBy("moment")
    return p.select("moment", "price", F.lead("price", steps).over(w).alias("met")).select("moment", "price", "met", (F.col("met") - F.col("price")).alias("slip"))


def repeated_orders(orders: DataFrame, least: int = 3, cv: float = 0.8) -> DataFrame:
    """Runs of orders of one size and side in a day with even gaps: at least ``least``, gap sd over mean below ``cv``."""
    day = F.expr(f"ts_ms div {DAY}")
    w = Window.partitionBy("symbol", "day", "side", "lots").orderBy("ts_ms", "n")
    x = orders.withColumn("day", day).withColumn("gap", F.col("ts_ms") - F.lag("ts_ms").over(w))
    g = x.groupBy("symbol", "day", "side", "lots").agg(F.count("*").alias("orders"), F.avg("gap").alias("gap_ms"), F.stddev_pop("gap").alias("sd"))
    return g.where((F.col("orders") >= least) & (F.col("sd") < cv * F.col("gap_ms"))).select("symbol", "day", "side", "lots", "orders", "gap_ms")


def crossing_flow(hours: DataFrame, fast: int = 6, slow: int = 24) -> DataFrame:
    """Activity in the hour after the fast mean crosses the slow one, less that of quiet hours of the same hour of the day."""
    w = Window.partitionBy("symbol").orderBy("ts_ms")
    mean = lambda n: F.when(F.count("tick").over(w.rowsBetween(-(n - 1), 0)) >= n, F.avg("tick").over(w.rowsBetween(-(n - 1), 0)))
    x = hours.select("symbol", "ts_ms", "lots", F.signum(mean(fast) - mean(slow)).alias("s"))
    x = x.select("symbol", F.pmod(F.expr("ts_ms div 3600000"), F.lit(24)).alias("hour"), F.lead("lots").over(w).alias("next"), (F.col("s") != F.lag("s").over(w)).alias("crossed")).where("next IS NOT NULL AND crossed IS NOT NULL")
    quiet = x.where("NOT crossed").groupBy("symbol", "hour").agg(F.avg("next").alias("base"))
    return x.where("crossed").join(quiet, ["symbol", "hour"]).groupBy("symbol").agg(F.avg(F.col("next") - F.col("base")).alias("excess"), F.count("*").alias("n"))


def kyle_variants(tape: DataFrame, ms: int) -> DataFrame:
    """By symbol: slope through the origin of a block's log return (in basis points) on the sum of signed roots of order values; and the slopes of the change
    between trades on bought and sold lots, beside the change of the side (a spread), by least squares.

    The three slopes solve normal equations of centred sums, written out, so one aggregation is all.
    """
    at = F.struct("ts_ms", "id")
    s = side().cast("double")
    blocks = tape.groupBy("symbol", F.floor(F.col("ts_ms") / ms).alias("b")).agg(F.sum(s * F.sqrt(F.col("lots") * F.col("tick") / 10.0)).alias("x"), (F.ln(F.max_by("tick", at).cast("double")) - F.ln(F.min_by("tick", at).cast("double"))).alias("r"))
    root = blocks.groupBy("symbol").agg((1e4 * divide(F.sum(F.col("x") * F.col("r")), F.sum(F.col("x") * F.col("x")))).alias("root_value"))
    w = Window.partitionBy("symbol", F.expr(f"ts_ms div {DAY}")).orderBy("ts_ms", "id")
    q = s * F.col("lots")
    t = tape.select("symbol", (F.col("tick") - F.lag("tick").over(w)).cast("double").alias("y"), F.greatest(q, F.lit(0.0)).alias("x1"), F.least(q, F.lit(0.0)).alias("x2"), (s - F.lag(s).over(w)).alias("x3")).where("y IS NOT NULL")
    pair = lambda a, b: F.covar_pop(a, b).alias(f"{a}{b}")
    names = ["x1", "x2", "x3"]
    m = t.groupBy("symbol").agg(F.count("*").alias("n"), *[pair(a, b) for i, a in enumerate(names) for b in [*names[i:], "y"]])
    c = lambda a, b: F.col(f"{min(a, b)}{max(a, b)}")

    def det(cols: list) -> Column:
        x, y, z = cols
        return x[0] * (y[1] * z[2] - y[2] * z[1]) - y[0] * (x[1] * z[2] - x[2] * z[1]) + z[0] * (x[1] * y[2] - x[2] * y[1])

    columns = [[c(a, b) for a in names] for b in [*names, "y"]]
    slopes = [divide(det([columns[3] if k == j else columns[k] for k in range(3)]), det(columns[:3])).alias(name) for j, name in enumerate(("bought", "sold", "spread"))]
    return root.join(m.select("symbol", "n", *slopes), "symbol")


def partial_spearman(df: DataFrame, keys: list[str], x: str, y: str, control: str) -> DataFrame:
    """Rank correlation of x and y by keys with the ranks of ``control`` held fixed."""
    there = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(control).isNotNull())
    ranked = there.select(*keys, *[average_ranks(there, keys, c).cast("double").alias(n) for c, n in ((x, "a"), (y, "b"), (control, "c"))])
    r = ranked.groupBy(*keys).agg(F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac"), F.corr("b", "c").alias("bc"), F.count("*").alias("n"))
    left = (1 - F.col("ac") * F.col("ac")) * (1 - F.col("bc") * F.col("bc"))
    return r.select(*keys, divide(F.col("ab") - F.col("ac") * F.col("bc"), F.sqrt(left)).alias("partial"), F.col("ab").alias("rho"), "n")


def first_beyond(hours: DataFrame, split: Column) -> DataFrame:
    """By symbol: the largest absolute change of an hour before ``split``, and the first hour from then on that exceeds it (ts_ms, move), null if none does."""
    w = Window.partitionBy("symbol").orderBy("ts_ms")
    moves = hours.select("symbol", "ts_ms", F.abs(F.col("tick") - F.lag("tick").over(w)).alias("move"), split.alias("split"))
    most = moves.groupBy("symbol").agg(F.max(F.when(F.col("ts_ms") < F.col("split"), F.col("move"))).alias("largest"))
    beyond = moves.join(most, "symbol").where("ts_ms >= split AND move > largest").groupBy("symbol").agg(F.min(F.struct("ts_ms", "move")).alias("f"))
    return most.join(beyond, "symbol", "left").select("symbol", "largest", "f.ts_ms", "f.move")
