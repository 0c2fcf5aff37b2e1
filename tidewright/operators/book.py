"""Order books from level changes (ts_ms, u, side, tick, size): size 0 removes a level, else the level has that size from then on.

A level's size holds until its next change, so the book at any moment is a set of intervals: no replay is needed for a query at chosen
moments. Where every update counts, days are folded apart, each from the book at its start.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.windows import divide
from tidewright.operators.asof import asof

DAY = 86_400_000


def intervals(deltas: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each change with ``next_u`` and ``next_ms``, when its level changes again. Partitions are levels, so a busy market spreads."""
    w = Window.partitionBy(*(by or []), "side", "tick").orderBy("u")
    return deltas.select("*", F.lead("u").over(w).alias("next_u"), F.lead("ts_ms").over(w).alias("next_ms"))


def checkpoints(deltas: DataFrame, ms: int, by: list[str] | None = None) -> DataFrame:
    """(moment, side, tick, size), after the columns ``by`` that name a book: the book just before each multiple of ``ms`` up to its last change.
    Changes are exploded to the moments they hold at, not joined to them."""
    by = by or []
    edge = deltas.groupBy(*by).agg(F.max("ts_ms").alias("end"))
    held = intervals(deltas, by).where("size > 0")
    held = held.join(edge, by) if by else held.crossJoin(F.broadcast(edge))  # one row
    first = F.floor(F.col("ts_ms") / ms) + 1
    last = F.floor((F.coalesce("next_ms", F.col("end"))) / ms)
    # equal times: of several changes of a level at one time only the last one lasts, and its first moment comes after them all
    moments = held.where(last >= first).select(*by, "side", "tick", "size", F.explode(F.sequence(first, last)).alias("m"))
    return moments.select(*by, (F.col("m") * ms).alias("moment"), "side", "tick", "size")


def states(levels: DataFrame, best: int = 5) -> DataFrame:
    """Best prices, their sizes, sizes of the best five, imbalances, mid, microprice and spread at each moment of a book with levels."""
    rank = F.row_number().over(Window.partitionBy("moment", "side").orderBy(F.col("tick") * -F.col("side")))
    top = levels.withColumn("k", rank).where(F.col("k") <= best)
    bid, ask = F.col("side") == 1, F.col("side") == -1
    s = lambda c: F.sum(F.when(c, F.col("size")))
    q = top.groupBy("moment").agg(F.max(F.when(bid, F.col("tick"))).alias("bid"), F.min(F.when(ask, F.col("tick"))).alias("ask"), s(bid & (F.col("k") == 1)).alias("q_bid"), s(ask & (F.col("k") == 1)).alias("q_ask"), s(bid).alias("q_bid5"), s(ask).alias("q_ask5"))
    return measures(q)


def imbalance(b: Column, a: Column) -> Column:
    return divide(b - a, b + a)


def measures(q: DataFrame) -> DataFrame:
    return q.select(
        "*",
        ((F.col("bid") + F.col("ask")) / 2).alias("mid"),
        (F.col("ask") - F.col("bid")).alias("spread"),
        imbalance(F.col("q_bid"), F.col("q_ask")).alias("i1"),
        imbalance(F.col("q_bid5"), F.col("q_ask5")).alias("i5"),
        divide(F.col("bid") * F.col("q_ask") + F.col("ask") * F.col("q_bid"), F.col("q_bid") + F.col("q_ask")).alias("microprice"),
    )


def depth(levels: DataFrame, band: float = 0.0005) -> DataFrame:
    """Size within ``band`` of the mid on both sides at each moment."""
    q = levels.groupBy("moment").agg(F.max(F.when(F.col("side") == 1, F.col("tick"))).alias("bid"), F.min(F.when(F.col("side") == -1, F.col("tick"))).alias("ask")).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    near = levels.join(q, "moment").where(F.abs(F.col("tick") - F.col("mid")) <= band * F.col("mid"))
    s = lambda x: F.coalesce(F.sum(F.when(F.col("side") == x, F.col("size"))), F.lit(0.0))
    return near.groupBy("moment").agg(s(1).alias("depth_bid"), s(-1).alias("depth_ask"))


def walk(levels: DataFrame, size: float, side: int = -1) -> DataFrame:
    """Mean price of taking ``size`` from one side at each moment, worst tick, and cost against the best; null where the book is too thin."""
    order = Window.partitionBy("moment").orderBy(F.col("tick") * -F.col("side"))
    own = levels.where(F.col("side") == side)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    took = own.withColumn("take", F.least("size", F.greatest(F.lit(size) - before, F.lit(0.0))))
    sums = took.groupBy("moment").agg(F.sum("take").alias("got"), F.sum(F.col("take") * F.col("tick")).alias("paid"), F.max(F.when(F.col("take") > 0, F.col("tick") * -F.col("side"))).alias("w"), F.min(F.col("tick") * -F.col("side")).alias("b"))
    enough = F.col("got") >= size - 1e-9
    price = F.when(enough, F.col("paid") / F.col("got"))
    return sums.select("moment", price.alias("price"), F.when(enough, F.col("w") * -side).alias("worst"), (F.abs(price - F.col("b") * -side)).alias("cost"))


#: Length of the spans that are folded apart.
SPAN = 3_600_000
ARROW = {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


class Ladder:
    """Levels of one book by side (1 bids, -1 asks), kept in order: a change costs a search, not a sort."""

    def __init__(self) -> None:
        self.keys: dict[int, list[int]] = {1: [], -1: []}  # the best first: minus the tick for bids
        self.sizes: dict[int, dict[int, float]] = {1: {}, -1: {}}

    def put(self, side: int, tick: int, size: float) -> None:
        at, held, key = self.keys[side], self.sizes[side], -side * tick
        if size > 0:
            if key not in held:
                bisect.insort(at, key)
            held[key] = size
        elif held.pop(key, None) is not None:
            at.pop(bisect.bisect_left(at, key))

    def best(self, side: int) -> int | None:
        return -side * self.keys[side][0] if self.keys[side] else None

    def levels(self) -> list[tuple[int, int, float]]:
        return [(s, -s * k, self.sizes[s][k]) for s in (1, -1) for k in self.keys[s]]


def _best_levels(book: Ladder, side: int, best: int) -> tuple:
    keys = book.keys[side][:best]
    return [-side * k for k in keys], [book.sizes[side][k] for k in keys]


def _best_state(book: Ladder, side: int, best: int) -> tuple:
    keys = book.keys[side][:best]
    if not keys:
        return None, None, None
    total = 0.0
    for k in keys:
        total += book.sizes[side][k]
    return -side * keys[0], book.sizes[side][keys[0]], total


def _fold(deltas: DataFrame, ms: int, by: list[str], best: int, taken: Callable[[Ladder, int, int], tuple], kinds: dict[str, str]) -> DataFrame:
    """``by``, ts_ms, u and the columns ``kinds``, which are what ``taken`` finds on the bids and then on the asks, after every update.

    Spark sorts the changes of each span of ``ms`` behind the levels that hold at its start (k = 0); a task walks its spans row by row, so it holds one book, however long a span is.
    """
    opening = checkpoints(deltas, ms, by).select(*by, (F.col("moment") / ms).cast("long").alias("bucket"), F.lit(0).alias("k"), F.col("moment").alias("ts_ms"), F.lit(0).cast("long").alias("u"), "side", F.col("tick").cast("long").alias("tick"), F.col("size").cast("double").alias("size"))
    rows = deltas.select(*by, F.floor(F.col("ts_ms") / ms).alias("bucket"), F.lit(1).alias("k"), "ts_ms", "u", "side", F.col("tick").cast("long").alias("tick"), F.coalesce(F.col("size").cast("double"), F.lit(0.0)).alias("size"))
    group = ["bucket", *by]  # a number first: most rows are told apart by the sort's prefix
    ordered = rows.unionByName(opening).repartition(*group).sortWithinPartitions(*group, "k", "u")
    schema = ", ".join([*(f"`{c}` {deltas.schema[c].dataType.simpleString()}" for c in by), "ts_ms long", "u long", *(f"{c} {t}" for c, t in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, book, found = None, Ladder(), {}
        for b in batches:
            out = []
            for key, k, side, tick, size in zip(zip(*(b[c].to_pylist() for c in group), strict=True), *(b[c].to_pylist() for c in ("k", "side", "tick", "size")), strict=True):
                if key != at:
                    at, book, found = key, Ladder(), {}
                if tick is not None:
                    book.put(side, tick, size)
                    found.pop(side, None)  # what is known of the other side still holds
                if k == 1:
                    if 1 not in found:
                        found[1] = taken(book, 1, best)
                    if -1 not in found:
                        found[-1] = taken(book, -1, best)
                    out.append(found[1] + found[-1])
            own = b.filter(pc.equal(b["k"], 1)).select([*by, "ts_ms", "u"])
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            types = [ARROW[t] for t in kinds.values()]
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=[*own.schema.names, *kinds])

    return ordered.mapInArrow(run, schema)


def fold_levels(deltas: DataFrame, best: int = 10, ms: int = SPAN, by: list[str] | None = None) -> DataFrame:
    """The ``best`` levels of both sides after every update, fewer where the book is thin, after the columns ``by`` that name a book. Spans of ``ms`` are folded
    apart: each starts from the levels that hold at its start."""
    kinds = {"bid": "array<long>", "bid_size": "array<double>", "ask": "array<long>", "ask_size": "array<double>"}
    return _fold(deltas, ms, by or [], best, _best_levels, kinds)


def fold_states(deltas: DataFrame, ms: int = SPAN, by: list[str] | None = None) -> DataFrame:
    """The book's state after every update: best prices, their sizes, sizes of the best five; null where a side is empty."""
    kinds = {"bid": "long", "q_bid": "double", "q_bid5": "double", "ask": "long", "q_ask": "double", "q_ask5": "double"}
    return _fold(deltas, ms, by or [], 5, _best_state, kinds).select(*(by or []), "ts_ms", "u", "bid", "ask", "q_bid", "q_ask", "q_bid5", "q_ask5")


def level_flow(levels: DataFrame, ms: int, best: int = 10) -> DataFrame:
    """(moment, level, ofi, n): order-flow imbalance at each of the ``best`` levels by bucket, between updates of one day at which both sides have them all."""
    w = Window.partitionBy(F.floor(F.col("ts_ms") / DAY)).orderBy("u")
    full = levels.where((F.size("bid") >= best) & (F.size("ask") >= best))
    x = full.select("ts_ms", *[y for c in ("bid", "bid_size", "ask", "ask_size") for y in (c, F.lag(c).over(w).alias(f"p_{c}"))]).where("p_bid IS NOT NULL")

    def change(i: Column) -> Column:
        now, was = (lambda c: F.get(c, i)), (lambda c: F.get(f"p_{c}", i))
        bid = F.when(now("bid") >= was("bid"), now("bid_size")).otherwise(0.0) - F.when(now("bid") <= was("bid"), was("bid_size")).otherwise(0.0)
        ask = F.when(now("ask") <= was("ask"), now("ask_size")).otherwise(0.0) - F.when(now("ask") >= was("ask"), was("ask_size")).otherwise(0.0)
        return bid - ask

    each = x.select((F.floor(F.col("ts_ms") / ms) * ms).alias("moment"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(best - 1)), change)).alias("level", "e"))
    return each.groupBy("moment", (F.col("level") + 1).cast("long").alias("level")).agg(F.sum("e").alias("ofi"), F.count("*").alias("n"))


def hidden_flow(state: DataFrame, trades: DataFrame) -> DataFrame:
    """By day: size traded, refilled within the same update (hidden), added and cancelled at an unchanged best bid. Trades are (ts_ms, tick, size).

    Trades of a price are summed over time once, and every update looks its sum up as of its time; so what traded between two updates is a difference.
    """
    w = Window.partitionBy("day").orderBy("u")
    x = state.where("bid IS NOT NULL").select(F.floor(F.col("ts_ms") / DAY).alias("day"), "u", "ts_ms", "bid", "q_bid")
    day = F.floor(F.col("ts_ms") / DAY)
    sums = trades.groupBy("tick", "ts_ms").agg(F.sum("size").alias("s")).withColumn("upto", F.sum("s").over(Window.partitionBy("tick", day).orderBy("ts_ms")))
    price = lambda c, t: F.concat_ws("/", c, F.floor(t / DAY))
    known = sums.select(price(F.col("tick"), F.col("ts_ms")).alias("at"), "ts_ms", "upto")
    asked = x.select("day", "u", "ts_ms", "q_bid", "bid", price(F.col("bid"), F.col("ts_ms")).alias("at"))
    found = asof(asked, known, "at", "ts_ms", ["upto"]).withColumn("upto", F.coalesce("upto", F.lit(0.0)))
    step = found.select("day", "bid", F.lag("bid").over(w).alias("before"), (F.col("q_bid") - F.lag("q_bid").over(w)).alias("dq"), (F.col("upto") - F.lag("upto").over(w)).alias("traded")).where("bid = before")
    net = F.col("dq") + F.col("traded")
    added = F.greatest(net, F.lit(0.0))
    s = lambda c: F.sum(c)
    return step.groupBy("day").agg(F.count("*").alias("n"), s("traded").alias("traded"), s(F.least(added, "traded")).alias("hidden"), s(added).alias("added"), s(F.greatest(-net, F.lit(0.0))).alias("cancelled"))


def verify(deltas: DataFrame, snapshots: DataFrame, ms: int) -> DataFrame:
    """Levels in which the rebuilt book and snapshots (moment, side, tick, size) differ; empty if all agree."""
    rebuilt = checkpoints(deltas, ms).join(snapshots.select("moment").distinct(), "moment", "left_semi").withColumnRenamed("size", "rebuilt")
    return rebuilt.join(snapshots, ["moment", "side", "tick"], "full").where(~F.col("rebuilt").eqNullSafe(F.col("size")))


def feed_gaps(deltas: DataFrame, ms: int) -> DataFrame:
    """Pauses of the feed longer than ``ms``."""
    w = Window.partitionBy(F.floor(F.col("ts_ms") / DAY)).orderBy("u")
    within = deltas.select("ts_ms", "u", F.lag("ts_ms").over(w).alias("start_ms"))
    edges = deltas.groupBy(F.floor(F.col("ts_ms") / DAY).alias("d")).agg(F.max("ts_ms").alias("end"), F.min("ts_ms").alias("begin"), F.min("u").alias("u"))
    across = edges.select(F.col("begin").alias("ts_ms"), "u", F.lag("end").over(Window.orderBy("d")).alias("start_ms"))
    both = within.where("start_ms IS NOT NULL").unionByName(across.where("start_ms IS NOT NULL"))
    return both.where(F.col("ts_ms") - F.col("start_ms") > ms).select("start_ms", F.col("ts_ms").alias("end_ms"), ((F.col("ts_ms") - F.col("start_ms")) / 1000.0).alias("seconds"))


def mid_samples(state: DataFrame, seed: int = 0) -> DataFrame:
    """One update of each run of constant mid, chosen by an arithmetic hash of u, with whether the day's next mid is higher. Runs end with the day, so days are windows of their own."""
    day = F.floor(F.col("ts_ms") / DAY)
    w = Window.partitionBy("day").orderBy("u")
    mids = state.where("bid IS NOT NULL AND ask IS NOT NULL").select(day.alias("day"), "u", "ts_ms", (F.col("bid") + F.col("ask")).alias("mid2"), "q_bid", "q_ask")
    numbered = mids.withColumn("new", F.coalesce((F.col("mid2") != F.lag("mid2").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    pick = (F.col("u") * 1103515245 + 12345 + seed) % 2147483648
    one = numbered.groupBy("day", "run").agg(F.min_by(F.struct("u", "ts_ms", "mid2", "q_bid", "q_ask"), F.struct(pick, "u")).alias("s"))
    nxt = F.lead("s.mid2").over(Window.partitionBy("day").orderBy("run"))
    return one.select("day", "run", "s.u", "s.ts_ms", "s.mid2", imbalance(F.col("s.q_bid"), F.col("s.q_ask")).alias("i1"), (nxt > F.col("s.mid2")).alias("up"))


def order_flow_imbalance(state: DataFrame, ms: int) -> DataFrame:
    """Order-flow imbalance of the best level by bucket: size added at or above the bid less size added at or below the ask, update by update."""
    w = Window.partitionBy(F.floor(F.col("ts_ms") / DAY)).orderBy("u")
    x = state.where("bid IS NOT NULL AND ask IS NOT NULL").select("*", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("bid", "ask", "q_bid", "q_ask")]).where("p_bid IS NOT NULL")
    c = F.col
    b = F.when(c("bid") >= c("p_bid"), c("q_bid")).otherwise(0.0) - F.when(c("bid") <= c("p_bid"), c("p_q_bid")).otherwise(0.0)
    a = F.when(c("ask") <= c("p_ask"), c("q_ask")).otherwise(0.0) - F.when(c("ask") >= c("p_ask"), c("p_q_ask")).otherwise(0.0)
    return x.groupBy((F.floor(c("ts_ms") / ms) * ms).alias("moment")).agg(F.sum(b - a).alias("ofi"), F.count("*").alias("n"))


def imbalance_bands(samples: DataFrame, bands: int = 10) -> DataFrame:
    """Share of up moves by band of imbalance."""
    band = F.least(F.floor((F.col("i1") + 1) / 2 * bands), F.lit(bands - 1))
    return samples.where("up IS NOT NULL AND i1 IS NOT NULL").groupBy(band.alias("band")).agg(F.avg(F.col("up").cast("double")).alias("p_up"), F.count("*").alias("n"))


def pulls(deltas: DataFrame) -> DataFrame:
    """Size that levels lost between changes, by day and side: removals and reductions, and how many levels fell to nothing."""
    w = Window.partitionBy("side", "tick").orderBy("u")
    x = deltas.select("ts_ms", "side", "size", F.lag("size").over(w).alias("before")).where(F.col("before") > F.col("size"))
    return x.groupBy(F.expr(f"ts_ms div {DAY}").alias("day"), "side").agg(F.sum(F.col("before") - F.col("size")).alias("lost"), F.count_if(F.col("size") == 0).alias("emptied"), F.count("*").alias("n"))
