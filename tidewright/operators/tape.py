"""Quality control and bars of a trade tape (id, symbol, ts_ms, tick, lots, is_buyer_maker).

Windows run by symbol and time. A tape with one symbol that dwarfs the rest is cut by day first; operators whose result needs the row before take
it from the day before through :func:`by_day`, which shuffles rows by (symbol, day) and only day edges by symbol.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import divide

DAY = 86_400_000


def day_of(ts: str = "ts_ms") -> Column:
    return F.expr(f"{ts} div {DAY}")


def by_day(tape: DataFrame, columns: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """``tape`` with ``prev_<c>``: columns of the row before in its symbol, across the edges of days, without a window over a whole symbol's rows.

    ``bucket`` takes the place of the day; it must not fall as ``order`` rises.
    """
    w = Window.partitionBy("symbol", "day").orderBy(*order)
    rows = tape.withColumn("day", day_of() if bucket is None else bucket)
    within = rows.select("*", *[F.lag(c).over(w).alias(f"__{c}") for c in columns], F.row_number().over(w).alias("__n"))
    ends = rows.groupBy("symbol", "day").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__e"))
    before = ends.select("symbol", "day", F.lag("__e").over(Window.partitionBy("symbol").orderBy("day")).alias("__e"))
    joined = within.join(before, ["symbol", "day"])
    return joined.select(*tape.columns, "day", *[F.when(F.col("__n") == 1, F.col(f"__e.{c}")).otherwise(F.col(f"__{c}")).alias(f"prev_{c}") for c in columns])


def integrity(tape: DataFrame, bucket: int = 1_000_000) -> DataFrame:
    """By symbol: rows, first and last id and time, jumps and repeats of the id, times that go backwards; continuous across buckets of ids."""
    rows = by_day(tape.select("symbol", "id", "ts_ms"), ["id", "ts_ms"], ["id", "ts_ms"], F.floor(F.col("id") / bucket))
    gap = F.col("id") - F.col("prev_id")
    return rows.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.count_if(gap > 1).alias("jumps"), F.count_if(gap < 1).alias("repeats"), F.count_if(F.col("ts_ms") < F.col("prev_ts_ms")).alias("backwards"),
    )


def holes(tape: DataFrame, seq: str = "seq") -> DataFrame:
    """(symbol, from_id, to_id, n, from_ms, to_ms): every missing range of the sequence."""
    x = by_day(tape, [seq, "ts_ms"], [seq, "ts_ms"])
    missing = x.where(F.col(seq) - F.col(f"prev_{seq}") > 1)
    return missing.select("symbol", F.col(f"prev_{seq}").alias("from_id"), F.col(seq).alias("to_id"), (F.col(seq) - F.col(f"prev_{seq}") - 1).alias("n"), F.col("prev_ts_ms").alias("from_ms"), F.col("ts_ms").alias("to_ms"))


def hole_days(found: DataFrame, least_ms: int = 0) -> DataFrame:
    """Days that a hole overlaps by at least ``least_ms``."""
    days = found.select("symbol", "from_id", "from_ms", "to_ms", F.explode(F.sequence(day_of("from_ms"), day_of("to_ms"))).alias("day"))
    overlap = F.least(F.col("to_ms"), (F.col("day") + 1) * DAY) - F.greatest(F.col("from_ms"), F.col("day") * DAY)
    return days.select("symbol", "from_id", "day", overlap.alias("overlap_ms")).where(F.col("overlap_ms") >= max(1, least_ms))


def patch_accounting(found: DataFrame, patches: DataFrame) -> DataFrame:
    """Patch rows strictly inside each hole, and its status. Holes of a symbol do not overlap, so the hole of a patch is the last one that starts before it: no range join."""
    a = found.select("symbol", F.col("from_id").alias("at"), F.lit(0).alias("k"), F.struct("from_id", "to_id", "n").alias("h"))
    b = patches.select("symbol", F.col("seq").alias("at"), F.lit(-1).alias("k"), F.lit(None).cast(a.schema["h"].dataType).alias("h"))
    w = Window.partitionBy("symbol").orderBy("at", "k")
    inside = a.unionByName(b).withColumn("hole", F.last("h", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("k = -1 AND at < hole.to_id")
    filled = inside.groupBy("symbol", F.col("hole.from_id").alias("from_id")).agg(F.countDistinct("at").alias("patched"))
    status = F.when(F.col("patched") >= F.col("n"), "filled").when(F.col("patched") > 0, "partly filled").otherwise("not in the archive")
    return found.join(filled, ["symbol", "from_id"], "left").withColumn("patched", F.coalesce("patched", F.lit(0))).withColumn("status", status)


def cleaned(raw: DataFrame, patches: DataFrame) -> DataFrame:
    """Raw rows and patches, one per (symbol, seq): the earliest. An aggregate, so repeats collapse before the shuffle."""
    both = raw.unionByName(patches)
    rest = [c for c in both.columns if c not in ("symbol", "seq")]
    return both.groupBy("symbol", "seq").agg(F.min_by(F.struct(*rest), F.struct("ts_ms", "tick", "lots")).alias("s")).select("symbol", "seq", "s.*")


def tick_size(tape: DataFrame) -> DataFrame:
    """Smallest step between distinct prices by symbol and day, and the power of ten nearest to it."""
    distinct = tape.select("symbol", day_of().alias("day"), "tick").distinct()
    step = distinct.select("symbol", "day", (F.col("tick") - F.lag("tick").over(Window.partitionBy("symbol", "day").orderBy("tick"))).alias("step"))
    least = step.where("step > 0").groupBy("symbol", "day").agg(F.min("step").alias("step"))
    return least.select("symbol", "day", "step", F.pow(F.lit(10.0), F.floor(F.log10(F.col("step").cast("double")) + 0.5)).alias("regime"))


def silence_flags(tape: DataFrame, ms: int = 3_600_000, examples: int | None = None) -> DataFrame:
    """Pauses longer than ``ms``, numbered by symbol and day; all, or the first ``examples`` of each."""
    x = by_day(tape, ["ts_ms"], ["ts_ms", "id"]).where(F.col("ts_ms") - F.col("prev_ts_ms") > ms)
    n = F.row_number().over(Window.partitionBy("symbol", "day").orderBy("ts_ms", "id"))
    found = x.select("symbol", "day", "id", F.col("prev_ts_ms").alias("from_ms"), "ts_ms", n.cast("long").alias("n"))
    return found if examples is None else found.where(F.col("n") <= examples)


def spikes(tape: DataFrame, before: int = 50, after: int = 10, least: float = 0.005, sds: float = 10.0, back: float = 0.2) -> DataFrame:
    """Prints far from the median of the rows before; reverting if the median after is within ``back`` of the way, else a jump.

    Ticks are whole, so a print exactly ``sds`` deviations away is told by whole numbers: (2 jump)^2 n (n - 1) against 4 sds^2 (n sum x^2 - (sum x)^2).
    """
    w = Window.partitionBy("symbol").orderBy("ts_ms", "id")
    p = F.col("tick").cast("double")
    early = w.rowsBetween(-before, -1)
    base = tape.select("symbol", "id", "ts_ms", "tick", p.alias("p")).select(
        "*",
        F.percentile("p", F.lit(0.5)).over(early).alias("m0"),
        F.sum("tick").over(early).alias("s1"),
        F.sum(F.col("tick") * F.col("tick")).over(early).alias("s2"),
        F.percentile("p", F.lit(0.5)).over(w.rowsBetween(1, after)).alias("m1"),
        F.count("p").over(early).alias("n"),
    )
    jump = F.col("p") - F.col("m0")
    whole = lambda c: c.cast("decimal(19,0)")
    spread = whole(F.col("n")) * whole(F.col("s2")) - whole(F.col("s1")) * whole(F.col("s1"))
    away = whole(2 * jump) * whole(2 * jump)
    far = away.cast("decimal(30,0)") * (F.col("n") * (F.col("n") - 1)).cast("decimal(8,0)") >= spread.cast("decimal(30,0)") * F.lit(4 * Decimal(str(sds)) ** 2)
    found = base.where((F.col("n") >= before) & (F.abs(jump) >= least * F.col("m0"))).where(far)
    return found.select("symbol", "id", "ts_ms", jump.alias("jump"), F.when(F.abs(F.col("m1") - F.col("m0")) <= back * F.abs(jump), "spike").otherwise("jump").alias("kind"))


def bursts(tape: DataFrame, ms: int = 3_600_000, times: float = 3.0) -> DataFrame:
    """Buckets with more than ``times`` their day's median count."""
    counts = tape.groupBy("symbol", day_of().alias("day"), (F.floor(F.col("ts_ms") / ms) * ms).alias("start_ms")).agg(F.count("*").alias("trades"))
    median = counts.groupBy("symbol", "day").agg(F.percentile("trades", F.lit(0.5)).alias("median"))
    return counts.join(median, ["symbol", "day"]).where(F.col("trades") > times * F.col("median"))


def bars(rows: DataFrame, keys: list[str], price: str = "tick") -> DataFrame:
    """Open, high, low, close, lots, dollars, signed dollars, trades, start and end by keys: one aggregate with map-side combine."""
    at = F.struct("ts_ms", "id")
    usd = F.col(price) * F.col("lots")
    return rows.groupBy(*keys).agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum("lots").alias("lots"), F.sum(usd).alias("usd"), F.sum(F.when(F.col("is_buyer_maker"), -usd).otherwise(usd)).alias("signed_usd"), F.count("*").alias("trades"),
    )


def time_bars(tape: DataFrame, ms: int) -> DataFrame:
    return bars(tape.withColumn("bar", F.floor(F.col("ts_ms") / ms) * ms), ["symbol", "bar"])


def clock_bars(tape: DataFrame, size: Column, threshold: int) -> DataFrame:
    """Bars of ``threshold`` units of ``size`` (1 for ticks, lots, dollars): floor(sum before this trade / threshold). The sums are prefix sums in two steps, by day and over days."""
    rows = tape.withColumn("day", day_of()).withColumn("size", size.cast("long"))
    w = Window.partitionBy("symbol", "day").orderBy("ts_ms", "id")
    days = rows.groupBy("symbol", "day").agg(F.sum("size").alias("d"))
    starts = days.select("symbol", "day", (F.sum("d").over(Window.partitionBy("symbol").orderBy("day")) - F.col("d")).alias("start"))
    run = rows.withColumn("within", F.sum("size").over(w) - F.col("size")).join(starts, ["symbol", "day"])
    return bars(run.withColumn("bar", F.floor((F.col("start") + F.col("within")) / threshold)), ["symbol", "bar"])


def realised(tape: DataFrame, seconds: list[int]) -> DataFrame:
    """By symbol, day and sampling interval: realised variance, bipower variation, jump share; the first return of a day is taken from the day before."""
    each = tape.select("symbol", "ts_ms", "id", F.ln(F.col("tick").cast("double")).alias("p"), F.explode(F.array(*map(F.lit, seconds))).alias("s"))
    last = each.groupBy("symbol", "s", F.floor(F.col("ts_ms") / (F.col("s") * 1000)).alias("b")).agg(F.max_by("p", F.struct("ts_ms", "id")).alias("p"))
    w = Window.partitionBy("symbol", "s").orderBy("b")
    r = last.select("symbol", "s", F.floor(F.col("b") * F.col("s") * 1000 / DAY).alias("day"), "b", (F.col("p") - F.lag("p").over(w)).alias("r"))
    both = r.select("*", F.abs(F.lag("r").over(w)).alias("r1"))
    rv, bv = F.sum(F.col("r") * F.col("r")), F.sum(F.abs("r") * F.col("r1")) * 1.5707963267948966
    return both.where("r IS NOT NULL").groupBy("symbol", "s", "day").agg(rv.alias("rv"), bv.alias("bipower"), F.greatest(1 - divide(bv, rv), F.lit(0.0)).alias("jump_share"), F.count("*").alias("n"))


def range_variance(bars_: DataFrame) -> DataFrame:
    """Parkinson's realised range by symbol and day, the order of extremes is left to :func:`paths`."""
    x = F.ln(F.col("high").cast("double") / F.col("low"))
    return bars_.groupBy("symbol", day_of("bar").alias("day")).agg((F.sum(x * x) / 2.772588722239781).alias("range_variance"), F.count("*").alias("bars"))


def paths(tape: DataFrame) -> DataFrame:
    """By symbol and day: which extreme came first, and the path's length over its range."""
    w = Window.partitionBy("symbol", "day").orderBy("ts_ms", "id")
    x = tape.withColumn("day", day_of()).withColumn("moved", F.abs(F.col("tick") - F.lag("tick").over(w)))
    at = F.struct("ts_ms", "id")
    high, low = F.min_by(at, F.struct(-F.col("tick"), "ts_ms", "id")), F.min_by(at, F.struct("tick", "ts_ms", "id"))
    return x.groupBy("symbol", "day").agg((high < low).alias("high_first"), divide(F.sum("moved").cast("double"), (F.max("tick") - F.min("tick")).cast("double")).alias("path"))


def spreads(tape: DataFrame, ms: int = 3_600_000) -> DataFrame:
    """Mid and spread by bucket from the aggressor: the last buy is the ask, the last sell the bid, where ask >= bid."""
    at, buy = F.struct("ts_ms", "id"), ~F.col("is_buyer_maker")
    q = tape.groupBy("symbol", (F.floor(F.col("ts_ms") / ms) * ms).alias("start_ms")).agg(F.max_by("tick", F.when(buy, at)).alias("ask"), F.max_by("tick", F.when(~buy, at)).alias("bid"))
    return q.where("ask >= bid").select("symbol", "start_ms", ((F.col("ask") + F.col("bid")) / 2).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"))


def orders(tape: DataFrame) -> DataFrame:
    """Taker orders: consecutive trades of one millisecond and side, with first and last price, lots and number of fills."""
    x = by_day(tape, ["ts_ms", "is_buyer_maker"], ["ts_ms", "id"])
    new = F.coalesce(((F.col("ts_ms") != F.col("prev_ts_ms")) | (F.col("is_buyer_maker") != F.col("prev_is_buyer_maker"))).cast("int"), F.lit(1))
    numbered = x.withColumn("new", new).withColumn("n", F.sum("new").over(Window.partitionBy("symbol", "ts_ms").orderBy("id")))
    at = F.struct("id")
    side = F.when(F.first("is_buyer_maker"), -1).otherwise(1)
    return numbered.groupBy("symbol", "ts_ms", "n").agg(F.min("id").alias("id"), side.alias("side"), F.sum("lots").alias("lots"), F.count("*").alias("fills"), F.min_by("tick", at).alias("first_tick"), F.max_by("tick", at).alias("last_tick"))


def variance_ratio(rv: DataFrame, base: int) -> DataFrame:
    """Mean RV at each interval over the mean at ``base``."""
    m = rv.groupBy("symbol", "s").agg(F.avg("rv").alias("rv"))
    one = m.where(F.col("s") == base).select("symbol", F.col("rv").alias("rv1"))
    return m.join(one, "symbol").select("symbol", "s", divide(F.col("rv"), F.col("rv1")).alias("ratio"))


def volume_profile(tape: DataFrame, width: int = 50) -> DataFrame:
    usd = F.col("tick") * F.col("lots")
    return tape.groupBy("symbol", (F.floor(F.col("tick") / width) * width).alias("level")).agg(F.sum(usd).alias("usd"), F.sum(F.when(F.col("is_buyer_maker"), -usd).otherwise(usd)).alias("net"))


def slot_tests(tape: DataFrame, hours: list[int]) -> DataFrame:
    """Mean trades of scheduled hours against the hour before and after, by symbol and hour of the day."""
    h = tape.groupBy("symbol", F.expr("ts_ms div 3600000").alias("h")).agg(F.count("*").alias("n"))
    spread = h.select("symbol", "n", F.explode(F.array(*[F.struct((F.col("h") - k).alias("h"), F.lit(k).alias("k")) for k in (-1, 0, 1)])).alias("e")).select("symbol", "n", "e.h", "e.k")
    at = spread.where(F.pmod("h", F.lit(24)).isin(hours))
    per = at.groupBy("symbol", "h").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in ((-1, "before"), (0, "inside"), (1, "after"))])
    return per.groupBy("symbol", F.pmod("h", F.lit(24)).alias("hour")).agg(F.avg("before").alias("before"), F.avg("inside").alias("inside"), F.avg("after").alias("after"), F.count("*").alias("days"))
