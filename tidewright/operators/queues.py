"""Queues at the levels of order books: what was added, traded and cancelled, refills, short-lived orders, and where an order stands in line.

Changes are (by…, ts_ms, u, side, tick, size), trades (by…, ts_ms, side, tick, size) with the side they hit, ``by`` naming the book. A level is a queue of its own: everything
here is partitioned by book, side and tick, and finds the rest (the best price, what traded since the last update) by joins as of a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.asof import SPAN, asof
from tidewright.operators.ranges import asof_steps, first_passage, passages, running
from tidewright.session import materialise


def last_of_time(changes: DataFrame, by: list[str]) -> DataFrame:
    """Of several changes of a level at one time the last."""
    return changes.groupBy(*by, "side", "tick", "ts_ms").agg(F.max("u").alias("u"), F.max_by("size", "u").alias("size"))


def level_events(changes: DataFrame, trades: DataFrame, by: list[str], span: int = SPAN) -> DataFrame:
    """Each update of a level with its ``old`` size and the parts of the change: ``added``, or ``traded`` and ``cancelled``; ``hit`` is all that traded at the level.

    What trades between two updates of a book, up to the time of the second, belongs to the second, and counts where that changes the
    level: a decrease is traded up to what was hit, and the rest was cancelled. Before a book's first update nothing is known of it.
    """
    return events_of(last_of_time(changes, by), trades, by, span)


def events_of(known: DataFrame, trades: DataFrame, by: list[str], span: int = SPAN) -> DataFrame:
    """:func:`level_events` of changes that are the last of their level and time already."""
    level = [*by, "side", "tick"]
    key = F.struct(*by)
    updates = known.groupBy(*by, "ts_ms").agg(F.max("u").alias("__u")).select(key.alias("__book"), "ts_ms", "__u")
    first = known.groupBy(*by).agg(F.min("ts_ms").alias("__from"))
    later = trades.join(first, by).where(F.col("ts_ms") > F.col("__from")).select(key.alias("__book"), "side", "tick", "ts_ms", "size")
    met = asof(later, updates, "__book", "ts_ms", ["__u"], forward=True, span=span).where("ts_ms_matched IS NOT NULL")
    hits = met.groupBy(*[F.col(f"__book.{c}").alias(c) for c in by], "side", "tick", F.col("ts_ms_matched").alias("ts_ms")).agg(F.sum("size").alias("hit"))
    w = Window.partitionBy(*level).orderBy("ts_ms")
    x = known.join(hits, [*level, "ts_ms"], "left").select(*level, "ts_ms", "u", "size", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce(F.lag("size").over(w), F.lit(0)).alias("old"))
    less = F.greatest(F.col("old") - F.col("size"), F.lit(0))
    traded = F.least(less, F.col("hit"))
    return x.select("*", F.greatest(F.col("size") - F.col("old"), F.lit(0)).alias("added"), traded.alias("traded"), (less - traded).alias("cancelled"))


def best_before(changes: DataFrame, by: list[str], span: int) -> DataFrame:
    """(by, ts_ms, best_bid, best_ask): the best prices before each update of a book, null where a side was empty or nothing came before."""
    from tidewright.operators.book import fold_states

    after = fold_states(last_of_time(changes, by), span, by).groupBy(*by, "ts_ms").agg(F.max_by(F.struct("bid", "ask"), "u").alias("s"))
    day = Window.partitionBy(*by, F.floor(F.col("ts_ms") / SPAN)).orderBy("ts_ms")
    edges = after.groupBy(*by, F.floor(F.col("ts_ms") / SPAN).alias("__day")).agg(F.max_by("s", "ts_ms").alias("__last"))
    held = edges.select(*by, "__day", F.lag("__last").over(Window.partitionBy(*by).orderBy("__day")).alias("__last"))
    x = after.select(*by, "ts_ms", F.lag("s").over(day).alias("s"), F.floor(F.col("ts_ms") / SPAN).alias("__day")).join(held, [*by, "__day"], "left")
    s = F.coalesce("s", "__last")
    return x.select(*by, "ts_ms", s["bid"].alias("best_bid"), s["ask"].alias("best_ask"))


def _own_best() -> Column:
    return F.when(F.col("side") == 1, F.col("best_bid")).otherwise(F.col("best_ask"))


def queue_totals(events: DataFrame, best: DataFrame, by: list[str]) -> DataFrame:
    """By book and side: what was added to, traded from and cancelled from the level that was the best before the update, and the number of such updates."""
    at = events.join(best, [*by, "ts_ms"]).where(F.col("tick") == _own_best())
    sums = [F.sum(c).alias(c) for c in ("added", "traded", "cancelled")]
    return at.groupBy(*by, "side").agg(*sums, F.count("*").alias("n"))


def refills(events: DataFrame, by: list[str], within: int, most: int = 80, near: int = 20) -> DataFrame:
    """(by, side, tick, ts_ms): levels of which trades hit ``most`` percent or more, and that stand within ``near`` percent of that size again: at once, or by the next change after
    they fell to nothing, ``within`` milliseconds at most."""
    w = Window.partitionBy(*by, "side", "tick").orderBy("ts_ms")
    eaten = (F.col("old") > 0) & (100 * F.col("hit") >= most * F.col("old")) & (F.col("size") < F.col("old"))
    alike = lambda old: 100 * F.abs(F.col("size") - old) <= near * old
    x = events.where("size <> old OR size = 0").select(*by, "side", "tick", "ts_ms", "size", "old", eaten.alias("eaten"), (F.col("added") > 0).alias("grows"))
    gone = F.when(F.col("old") > 0, F.struct(F.col("ts_ms").alias("at"), F.col("old").alias("old"), (F.col("eaten") & (F.col("size") == 0)).alias("away")))
    x = x.withColumn("was", F.last(gone, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    again = F.col("grows") & (F.col("old") == 0) & F.col("was.away") & (F.col("ts_ms") - F.col("was.at") <= within) & alike(F.col("was.old"))
    once = F.col("eaten") & (F.col("size") > 0) & alike(F.col("old"))
    return x.where(again | once).select(*by, "side", "tick", "ts_ms")


def refill_chains(found: DataFrame, by: list[str], gap: int, least: int = 3) -> DataFrame:
    """(by, side, tick, start_ms, end_ms, refills): icebergs, ``least`` refills of a level or more with no pause over ``gap`` milliseconds."""
    level = [*by, "side", "tick"]
    w = Window.partitionBy(*level).orderBy("ts_ms")
    new = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(w) > gap).cast("int"), F.lit(1))
    runs = found.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    chains = runs.groupBy(*level, "__run").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("refills"))
    return chains.where(F.col("refills") >= least).drop("__run")


def short_lived(events: DataFrame, best: DataFrame, by: list[str], least: float, within: int, leaf: int, far: int = 9, rest: int = 20) -> DataFrame:
    """Spoof candidates: increases of ``least`` or more, one to ``far`` ticks behind the best, each followed until no more than ``rest`` percent of it stands.

    (by, side, tick, ts_ms, added, off, life_ms, traded): ``life_ms`` is null where it still stands after ``within`` milliseconds; ``traded`` says whether trades hit the
    level in that time. Each increase is followed by itself, also where a later one joins the same level.
    """
    level = [*by, "side", "tick"]
    off = F.abs(F.col("tick") - _own_best())
    found = events.where(F.col("added") >= least).join(best, [*by, "ts_ms"]).withColumn("off", off).where(F.col("off").between(1, far))
    found = found.select(*level, "ts_ms", "added", "off", (100 * F.col("old") + rest * F.col("added")).alias("__limit"))
    asked = {"__gone": (F.col("__limit"), 100 * F.col("size"), F.lit(False)), "__hit": (F.lit(1), F.col("hit"), F.lit(True))}
    out = passages(found, events, level, "ts_ms", asked, within, leaf)
    hit = F.coalesce(F.col("__hit") <= F.coalesce("__gone", F.col("ts_ms") + within), F.lit(False))
    return out.select(*level, "ts_ms", "added", "off", (F.col("__gone") - F.col("ts_ms")).alias("life_ms"), hit.alias("traded"))


def _line(ahead: np.ndarray, shown: np.ndarray, joined: np.ndarray, until: np.ndarray, power: float, at: np.ndarray, kind: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Time at which each order of a level is reached, or -1: all orders of the level step through its events together.

    ``at``, ``kind`` (0 trade, 1 change) and ``size`` are the level's events in order. Each order holds what stands ahead of it and what the level
    shows less the trades since.
    """
    front, whole = ahead.astype(float), shown.astype(float)
    reached = np.full(len(ahead), -1, np.int64)
    order = np.argsort(joined, kind="stable")
    live = np.zeros(0, np.int64)
    nxt = 0
    for t, k, s in zip(at.tolist(), kind.tolist(), size.tolist(), strict=True):
        while nxt < len(order) and joined[order[nxt]] < t:
            live = np.append(live, order[nxt])
            nxt += 1
        live = live[until[live] >= t]
        if not len(live):
            continue
        f, w = front[live], whole[live]
        if k == 0:
            done = s > f
            reached[live[done]] = t
            front[live], whole[live] = f - s, w - s
            live = live[~done]
        else:
            lost = np.maximum(w - s, 0.0)
            share = np.minimum(f / np.maximum(w, 1e-12), 1.0)
            # of what is cancelled a share**power stands ahead; behind the order no more can go than stands there
            behind = np.where(share < 1, (1 - share**power) * lost if np.isfinite(power) else lost, 0.0)
            behind = np.minimum(behind, np.maximum(w - f, 0.0))
            front[live] = np.where(lost > 0, np.maximum(f - (lost - behind), 0.0), f)
            whole[live] = s
    return reached


LINE = "id long, reached long"


def queue_reached(orders: DataFrame, changes: DataFrame, trades: DataFrame, by: list[str], hold_ms: int, power: float = 1.0) -> DataFrame:
    """(id, ahead, reached_ms): orders (id, by, side, tick, ts_ms) join the end of their level's line; when trades reach them within ``hold_ms``, null if not.

    ``ahead`` is what the level shows at its last change less what traded there since; an order on a level that never showed is at its front. A trade eats the front and fills the
    order if it is larger than what stands ahead. A decrease beyond the trades is a cancellation: of it x^``power`` stands ahead of the order, x the share that stands ahead.
    Trades come before changes of the same time. Levels are cut into spans of ``hold_ms`` by the orders that join in them; the events of a span and the one after it go to its task.
    """
    level = [*by, "side", "tick"]
    key = F.struct(*level)
    known = last_of_time(changes, by).select(key.alias("__level"), "ts_ms", F.col("size").cast("double").alias("size"))
    each = trades.select(key.alias("__level"), "ts_ms", F.col("size").cast("double").alias("size"))
    sums = running(each, ["__level"], "ts_ms", ["size"]).withColumnRenamed("size", "__upto")
    # at each time of a level: what it shows, what has traded so far, and what had traded at its last change
    both = known.select("__level", "ts_ms", F.col("size").alias("__size")).unionByName(sums, allowMissingColumns=True).groupBy("__level", "ts_ms").agg(F.max("__size").alias("__size"), F.max("__upto").alias("__upto"))
    sofar = Window.partitionBy("__level").orderBy("ts_ms")
    filled = both.select("__level", "ts_ms", F.last("__size", ignorenulls=True).over(sofar).alias("shown"), F.coalesce(F.last("__upto", ignorenulls=True).over(sofar), F.lit(0.0)).alias("__upto"), F.col("__size").isNotNull().alias("__changed"))
    state = filled.withColumn("__then", F.last(F.when(F.col("__changed"), F.col("__upto")), ignorenulls=True).over(sofar))
    met = asof(orders.select("id", key.alias("__level"), "ts_ms"), state.select("__level", "ts_ms", "shown", "__upto", "__then"), "__level", "ts_ms", ["shown", "__upto", "__then"])
    # on a level that never showed nothing stands ahead, whatever traded there
    since = F.when(F.col("shown").isNull(), 0.0).otherwise(F.col("__upto") - F.col("__then"))
    shown = F.coalesce("shown", F.lit(0.0))
    lined = materialise(met.select("id", "__level", "ts_ms", F.greatest(shown - since, F.lit(0.0)).alias("ahead"), (shown - since).alias("whole")), "orders-in-line")
    span = lambda c: F.floor(F.col(c) / hold_ms)
    queue = lined.select(F.col("__level"), span("ts_ms").alias("__span"), F.lit(2).alias("kind"), "ts_ms", F.col("ahead").alias("size"), "id", "whole")
    spread = lambda df, k: df.select("__level", F.explode(F.array(span("ts_ms"), span("ts_ms") - 1)).alias("__span"), F.lit(k).alias("kind"), "ts_ms", "size", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("whole"))
    # only spans in which an order joins need their events
    asked = queue.select("__level", "__span").distinct()
    happened = spread(each, 0).unionByName(spread(known, 1)).join(asked, ["__level", "__span"], "left_semi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        o = pdf[pdf.kind == 2]
        e = pdf[pdf.kind < 2].sort_values(["ts_ms", "kind"], kind="stable")
        t = o.ts_ms.to_numpy()
        got = _line(o["size"].to_numpy(), o.whole.to_numpy(), t, t + hold_ms, power, e.ts_ms.to_numpy(), e.kind.to_numpy(), e["size"].to_numpy())
        return pd.DataFrame({"id": o.id.astype("int64"), "reached": got})

    reached = queue.unionByName(happened).groupBy("__level", "__span").applyInPandas(run, LINE)
    return lined.select("id", "ahead").join(reached, "id", "left").select("id", "ahead", F.when(F.col("reached") >= 0, F.col("reached")).alias("reached_ms"))


def queue_rules(orders: DataFrame, changes: DataFrame, trades: DataFrame, by: list[str], hold_ms: int, power: float = 1.0, leaves: int = 512) -> DataFrame:
    """Orders with ``ahead`` and their fill times under three rules: ``q0_ms`` a trade at their price or through it, ``q1_ms`` a trade through it, ``q2_ms`` their turn in the queue or a trade through."""
    # trades against bids are sold at or below them, those against asks bought at or above
    down = F.col("side") < 0
    asked = {"q0_ms": (F.col("tick"), F.col("tick"), down), "q1_ms": (F.col("tick") - F.col("side"), F.col("tick"), down)}
    wide = passages(orders, trades, [*by, "side"], "ts_ms", asked, hold_ms, max(1, hold_ms // leaves))
    line = queue_reached(orders, changes, trades, by, hold_ms, power)
    return wide.join(line, "id", "left").withColumn("q2_ms", F.least("q1_ms", "reached_ms")).drop("reached_ms")


def refill_times(shocks: DataFrame, depth: DataFrame, by: list[str], within: int, leaf: int, share: int = 90) -> DataFrame:
    """(id, refill_ms): how long after each shock (id, by, side, ts_ms, before) the depth (by, side, ts_ms, depth) of its side first stands at ``share`` percent of ``before`` again; null beyond ``within``."""
    asked = shocks.withColumn("__limit", share * F.col("before"))
    scaled = depth.withColumn("__depth", 100 * F.col("depth"))
    met = first_passage(asked, scaled, [*by, "side"], "ts_ms", "__limit", "__depth", F.lit(True), within, leaf)
    return shocks.select("id", "ts_ms").join(met, "id", "left").select("id", (F.col("passed") - F.col("ts_ms")).alias("refill_ms"))


def matched_curves(curves: DataFrame) -> DataFrame:
    """(step, shocks, controls, cells, n): mean ratio after shocks, and that of controls of the same cells, each cell weighing as many as it holds shocks. Curves are (step, cell, shock, ratio); cells
    without controls are left out of both sides."""
    means = curves.where("ratio IS NOT NULL").groupBy("step", "cell").agg(
        F.avg(F.when(F.col("shock"), F.col("ratio"))).alias("s"), F.avg(F.when(~F.col("shock"), F.col("ratio"))).alias("c"), F.count_if(F.col("shock")).alias("k")
    )
    both = means.where("s IS NOT NULL AND c IS NOT NULL")
    weighed = lambda c: F.sum(F.col(c) * F.col("k")) / F.sum("k")
    return both.groupBy("step").agg(weighed("s").alias("shocks"), weighed("c").alias("controls"), F.count("*").alias("cells"), F.sum("k").alias("n"))


def depth_around(updates: DataFrame, depth: DataFrame, by: list[str], steps: list[int]) -> DataFrame:
    """``updates`` (by, side, ts_ms) with the depth of their side ``before`` them, and ``after``, an array of what it is at each of ``steps`` after them; updates without a depth before have no row."""
    # times are whole: what holds just before one is what holds a millisecond earlier
    names = [f"__after_{k}" for k in steps]
    met = asof_steps(updates, depth, [*by, "side"], "ts_ms", "depth", {"before": -1, **dict(zip(names, steps, strict=True))})
    return met.where("before IS NOT NULL").select(*updates.columns, "before", F.array(*names).alias("after"))


def refill_curves(shocks: DataFrame, steps: list[int]) -> DataFrame:
    """A row for each step after a shock (before, after and others): ``ratio`` is the depth at it over that ``before``. Nothing is joined: a shock's own row holds its depths."""
    at = F.explode(F.arrays_zip(F.array(*map(F.lit, steps)).alias("step"), F.col("after").alias("depth")))
    rest = [c for c in shocks.columns if c not in ("before", "after")]
    return shocks.select(*rest, "before", at.alias("__at")).select(*rest, "__at.step", (F.col("__at.depth") / F.col("before")).alias("ratio"))


def resting_share(trades: DataFrame, changes: DataFrame, by: list[str], shifts: list[int], span: int = SPAN) -> DataFrame:
    """(by, shift, n, standing): how many trades' prices stand in the book on the side they hit, ``shift`` milliseconds after their time, for a grid of shifts: the shift at which most
    stand is the lag of the trades' clock. A level stands from a change to a positive size until its next change; all shifts go through one as-of join."""
    key = F.struct(*by, "side", "tick")
    known = last_of_time(changes, by).select(key.alias("__level"), "ts_ms", "size")
    asked = trades.select(key.alias("__level"), F.col("ts_ms").alias("__t"), F.explode(F.array(*map(F.lit, shifts))).alias("shift")).withColumn("ts_ms", F.col("__t") + F.col("shift"))
    met = asof(asked, known, "__level", "ts_ms", ["size"], span=span)
    stands = F.coalesce(F.col("size") > 0, F.lit(False))
    return met.groupBy(*[F.col(f"__level.{c}").alias(c) for c in by], "shift").agg(F.count("*").alias("n"), F.count_if(stands).alias("standing"))
