"""Work that goes on from one batch to the next: what a batch leaves unfinished is a small state table, written, and read by the next batch.

A run over several chunks gives the rows of one run over all. State holds one row a symbol or open lot, never the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.asof import asof
from tidewright.operators.ranges import running
from tidewright.session import materialise

Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def in_chunks(chunks: list[DataFrame], step: Step) -> tuple[DataFrame, DataFrame]:
    """(all rows that are finished, the last state) of ``step(chunk, state)`` over ``chunks``; the state is written between them, so a batch can be run again from it."""
    state, done = None, []
    for k, chunk in enumerate(chunks):
        rows, state = step(chunk, state)
        done.append(materialise(rows, f"chunk-{k}"))
        state = materialise(state, f"state-{k}")
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out, state


# --- bars of a number of lots

PART = "part struct<start_ms:bigint,end_ms:bigint,first:struct<ts_ms:bigint,id:bigint>,last:struct<ts_ms:bigint,id:bigint>,open:bigint,high:bigint,low:bigint,close:bigint,lots:bigint,trades:bigint>"
BAR = ("start_ms", "end_ms", "open", "high", "low", "close", "lots", "trades")


def lot_bars(size: int) -> Step:
    """Step of bars (symbol, bar, BAR) of ``size`` lots over trades (id, symbol, ts_ms, tick, lots), each chunk later than the one before: a trade belongs to the bar in which the lots before it end.

    State: (symbol, total, bar, part), the lots so far and the open bar, whose part merges with the next chunk's.
    """

    def step(trades: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        at = F.struct("ts_ms", "id")
        sums = running(trades.withColumn("__at", at), ["symbol"], "ts_ms", ["lots"]).withColumnRenamed("lots", "__upto")
        own = Window.partitionBy("symbol", "ts_ms").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
        # the sum up to a time, less the trades of that time from this one on
        x = trades.join(sums, ["symbol", "ts_ms"]).withColumn("__before", F.col("__upto") - F.sum("lots").over(own))
        if state is not None:
            held = state.select("symbol", F.col("total").alias("__total"))
            x = x.join(held, "symbol", "left").withColumn("__before", F.col("__before") + F.coalesce("__total", F.lit(0)))
        one = F.struct(
            F.col("ts_ms").alias("start_ms"), F.col("ts_ms").alias("end_ms"), at.alias("first"), at.alias("last"), F.col("tick").alias("open"), F.col("tick").alias("high"),
            F.col("tick").alias("low"), F.col("tick").alias("close"), F.col("lots").alias("lots"), F.lit(1).cast("long").alias("trades"),
        )
        parts = x.select("symbol", F.floor(F.col("__before") / size).alias("bar"), one.alias("part"))
        totals = x.groupBy("symbol").agg(F.max(F.col("__before") + F.col("lots")).alias("total"))
        if state is not None:
            parts = parts.unionByName(state.where("part IS NOT NULL").select("symbol", "bar", "part"))
            totals = totals.unionByName(state.select("symbol", "total")).groupBy("symbol").agg(F.max("total").alias("total"))
        p = lambda c: F.col(f"part.{c}")
        merged = F.struct(
            F.min(p("start_ms")).alias("start_ms"), F.max(p("end_ms")).alias("end_ms"), F.min(p("first")).alias("first"), F.max(p("last")).alias("last"), F.min_by(p("open"), p("first")).alias("open"),
            F.max(p("high")).alias("high"), F.min(p("low")).alias("low"), F.max_by(p("close"), p("last")).alias("close"), F.sum(p("lots")).alias("lots"), F.sum(p("trades")).alias("trades"),
        )
        bars = materialise(parts.groupBy("symbol", "bar").agg(merged.alias("part")).join(totals, "symbol"), "bars")
        open_ = F.col("bar") >= F.floor(F.col("total") / size)
        closed = bars.where(~open_).select("symbol", "bar", *[F.col(f"part.{c}").alias(c) for c in BAR])
        left = bars.groupBy("symbol").agg(F.max("total").alias("total"), F.max(F.when(open_, F.col("bar"))).alias("bar"), F.max_by("part", F.when(open_, F.col("bar"))).alias("part"))
        return closed, left

    return step


def unfinished(state: DataFrame) -> DataFrame:
    """The open bars of a state of :func:`lot_bars`, as bars."""
    return state.where("part IS NOT NULL").select("symbol", "bar", *[F.col(f"part.{c}").alias(c) for c in BAR])


# --- lots that are matched first in, first out


def _ends(lots: DataFrame, name: str) -> DataFrame:
    """(symbol, upto, name): the running sum of lots of one side in order of (ts_ms, id), and the fill that ends there."""
    w = Window.partitionBy("symbol", "ts_ms").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    sums = running(lots, ["symbol"], "ts_ms", ["lots"]).withColumnRenamed("lots", "__upto")
    x = lots.join(sums, ["symbol", "ts_ms"]).withColumn("upto", F.col("__upto") - F.sum("lots").over(w) + F.col("lots"))
    return x.select("symbol", "upto", F.struct("ts_ms", "id", "tick", "lots").alias(name))


def match_lots(fills: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Step that pairs bought with sold lots, first in, first out, over fills (id, symbol, ts_ms, side, tick, lots), each chunk later than the one before.

    Whichever side came first, the n-th lot bought closes with the n-th sold: both sides are laid end to end, and between two ends of either there is one pair of fills. Finished: (symbol, buy_id,
    sell_id, lots, result), result in ticks times lots. State: the lots of the side that is ahead, the first of them perhaps in part.
    """
    all_ = fills.select("id", "symbol", "ts_ms", "side", "tick", "lots")
    if state is not None:
        all_ = all_.unionByName(state.select(*all_.columns))
    buys, sells = _ends(all_.where("side > 0"), "buy"), _ends(all_.where("side < 0"), "sell")
    both = materialise(buys.select("symbol", "upto", "buy").unionByName(sells.select("symbol", "upto", "sell"), allowMissingColumns=True), "ends")
    cuts = both.select("symbol", "upto").distinct()
    # a stretch ends at each cut and belongs to the first fill of either side that ends there or later
    span = 1 << 20
    met = asof(cuts, both.where("buy IS NOT NULL").select("symbol", "upto", "buy"), "symbol", "upto", ["buy"], forward=True, span=span).withColumnRenamed("upto_matched", "buy_end")
    met = asof(met, both.where("sell IS NOT NULL").select("symbol", "upto", "sell"), "symbol", "upto", ["sell"], forward=True, span=span).withColumnRenamed("upto_matched", "sell_end")
    day = Window.partitionBy("symbol", F.floor(F.col("upto") / span)).orderBy("upto")
    edges = met.groupBy("symbol", F.floor(F.col("upto") / span).alias("__s")).agg(F.max("upto").alias("__e"))
    before = edges.select("symbol", "__s", F.lag("__e").over(Window.partitionBy("symbol").orderBy("__s")).alias("__e"))
    x = met.withColumn("__s", F.floor(F.col("upto") / span)).withColumn("__p", F.lag("upto").over(day)).join(before, ["symbol", "__s"], "left")
    n = F.col("upto") - F.coalesce("__p", "__e", F.lit(0))
    stretches = materialise(x.select("symbol", "buy", "sell", n.alias("n")).where("n > 0"), "stretches")
    paired = stretches.where("buy IS NOT NULL AND sell IS NOT NULL")
    done = paired.select("symbol", F.col("buy.id").alias("buy_id"), F.col("sell.id").alias("sell_id"), F.col("n").alias("lots"), (F.col("n") * (F.col("sell.tick") - F.col("buy.tick"))).alias("result"))
    own: Column = F.coalesce("buy", "sell")
    left = stretches.where("buy IS NULL OR sell IS NULL").select("symbol", own.alias("f"), F.when(F.col("buy").isNotNull(), 1).otherwise(-1).alias("side"), "n")
    lots = left.groupBy("symbol", "side", "f.id", "f.ts_ms", "f.tick").agg(F.sum("n").alias("lots"))
    return done, lots.select("id", "symbol", "ts_ms", "side", "tick", "lots")
