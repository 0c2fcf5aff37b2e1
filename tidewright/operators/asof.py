"""As-of, interval and calendar joins, built from unions, windows and bucketed equi-joins, so that none nests loops over both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Length of the spans of ``on`` that as-of joins sort apart: a day of milliseconds.
SPAN = 86_400_000


def asof(left: DataFrame, right: DataFrame, by: str, on: str, values: list[str], strict: bool = False, forward: bool = False, tolerance: int | None = None, span: int = SPAN) -> DataFrame:
    """``left`` with ``values`` of the last right row whose ``on`` is at most the left one (before it if strict; after it if forward), null if older than ``tolerance``.

    Both sides are shuffled once on ``by`` and the span of ``on``, and sorted once, so one key of a long history is many tasks. Into each span goes the
    right row that holds at its start (at its end if forward), found by a window over one row a key and span. Equal right times keep the last in
    order of all values. A right row's null values are values too.
    """
    cols = left.columns
    keep = F.struct(F.col(on).alias("__at"), *values)
    before = 0 if strict else 1  # left rows come first at equal times where the match is strict
    if forward:
        before = 1 - before
    a = left.select(F.col(by).alias("__by"), F.col(on).alias("__on"), F.lit(before).alias("__k"), F.struct(*cols).alias("__l"), F.lit(None).cast(right.select(keep.alias("s")).schema["s"].dataType).alias("__r"))
    b = right.select(F.col(by).alias("__by"), F.col(on).alias("__on"), F.lit(1 - before).alias("__k"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), keep.alias("__r"))
    bucket = F.floor(F.col("__on") / span)
    a, b = a.withColumn("__span", bucket), b.withColumn("__span", bucket)
    edge = (F.min if forward else F.max)(F.struct("__on", "__k", "__r")).alias("__e")
    spans = b.groupBy("__by", "__span").agg(edge).unionByName(a.select("__by", "__span").distinct(), allowMissingColumns=True).groupBy("__by", "__span").agg(F.max("__e").alias("__e"))
    order = Window.partitionBy("__by").orderBy(F.desc("__span") if forward else "__span").rowsBetween(Window.unboundedPreceding, -1)
    held = spans.select("__by", "__span", F.last("__e", ignorenulls=True).over(order).alias("__e")).where("__e IS NOT NULL")
    b = b.unionByName(held.select("__by", "__span", "__e.__on", "__e.__k", "__e.__r"), allowMissingColumns=True)
    # frames that grow from the start keep one value; those that end at the last row would be evaluated anew for each row
    order = ("__on", "__k", "__r")
    w = Window.partitionBy("__by", "__span").orderBy(*[F.desc(c) if forward else F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    match = F.last("__r", ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("__m", match).where("__l IS NOT NULL")
    if tolerance is not None:
        out = out.withColumn("__m", F.when(F.abs(F.col("__on") - F.col("__m.__at")) <= tolerance, F.col("__m")))
    return out.select("__l.*", F.col("__m.__at").alias(f"{on}_matched"), *[F.col(f"__m.{v}").alias(v) for v in values])


def horizons(left: DataFrame, right: DataFrame, by: str, on: str, value: str, steps: list[int]) -> DataFrame:
    """``left`` with ``value`` at each step after ``on``: one as-of join over rows shifted by every step, not one per step.

    ``left`` needs a column ``id`` that names its rows.
    """
    rest = [c for c in left.columns if c != "id"]
    shifted = left.select("*", F.explode(F.array(*map(F.lit, steps))).alias("__step")).withColumn("__from", F.col(on)).withColumn(on, F.col(on) + F.col("__step"))
    found = asof(shifted, right, by, on, [value])
    own = F.first(F.struct(*[(F.col("__from") if c == on else F.col(c)).alias(c) for c in rest])).alias("__own")  # the left side is read once
    wide = found.groupBy("id").agg(own, *[F.max(F.when(F.col("__step") == s, F.col(value))).alias(f"{value}_{s}") for s in steps])
    return wide.select("id", *[F.col(f"__own.{c}").alias(c) for c in rest], *[f"{value}_{s}" for s in steps])


def in_intervals(points: DataFrame, intervals: DataFrame, by: str, at: str, start: str, end: str, bucket: int) -> DataFrame:
    """Pairs of points and intervals with start <= at < end, through an equi-join on time buckets of size ``bucket``."""
    a = points.withColumn("__b", F.floor(F.col(at) / bucket))
    b = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket)))).where(F.col(end) > F.col(start))
    return a.join(b, [by, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def spine(df: DataFrame, by: str, on: str, step: int) -> DataFrame:
    """(by, on): every multiple of ``step`` from a key's first time to its last."""
    edges = df.groupBy(by).agg(F.floor(F.min(on) / step).alias("a"), F.floor(F.max(on) / step).alias("b"))
    return edges.select(by, F.explode(F.transform(F.sequence("a", "b"), lambda x: x * step)).alias(on))


def densify(df: DataFrame, by: str, on: str, step: int, fill: list[str], zero: list[str]) -> DataFrame:
    """``df`` on its spine: ``fill`` columns repeat the last value, ``zero`` columns are 0 where there is no row."""
    full = spine(df, by, on, step).join(df.withColumn(on, F.floor(F.col(on) / step) * step), [by, on], "left")
    w = Window.partitionBy(by).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    return full.select(by, on, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in fill], *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])


def available_from(month: Column, months: int, day: int) -> Column:
    """The day from which a month's value may be used: the given day, ``months`` later."""
    return F.date_add(F.add_months(F.trunc(month, "MM"), months), day - 1)


def event_windows(events: DataFrame, bars: DataFrame, by: str, on: str, step: int, before: int, after: int, carry: list[str] | None = None) -> DataFrame:
    """Bars around events by offset, with the events' columns ``carry``: every event is exploded to its offsets and equi-joined, so the plan has no range join."""
    each = events.select(by, *(carry or []), F.col(on).alias("event"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"))
    return each.withColumn(on, (F.floor(F.col("event") / step) + F.col("offset")) * step).join(bars, [by, on])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the latest by ``order``: the state after upserts. Partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__s")).select(*keys, "__s.*")


def differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that one side lacks, or whose values differ: (key, mine, theirs, kind)."""
    a, b = left.select(key, F.col(value).alias("mine")), right.select(key, F.col(value).alias("theirs"))
    kind = F.when(F.col("mine").isNull(), "unknown here").when(F.col("theirs").isNull(), "missing there").when(F.col("mine") != F.col("theirs"), "differs")
    return a.join(b, key, "full").withColumn("kind", kind).where("kind IS NOT NULL")
