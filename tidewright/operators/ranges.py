"""Aggregates over ranges of time, and first passages, without pairs of rows and ranges.

Counts and sums are differences of running sums at the two ends. Extremes and first passages are found in spans of time as long as a range may last: Spark sends each
range to the span it starts in, and each row to its own span and the one before, so a range meets all its rows in one task. There a tree of extremes
over the sorted rows answers each range in as many steps as the rows of two spans have doublings, however close they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tidewright.operators.asof import SPAN, asof


def running(rows: DataFrame, by: list[str], at: str, values: list[str], span: int = SPAN) -> DataFrame:
    """(by, at) with the running sums of ``values`` up to and with that time: inside spans, plus the totals of the spans before, one row each."""
    one = rows.groupBy(*by, at).agg(*[F.sum(v).alias(v) for v in values]).withColumn("__span", F.floor(F.col(at) / span))
    inside = Window.partitionBy(*by, "__span").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    totals = one.groupBy(*by, "__span").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "__span", *[F.sum(f"__t_{v}").over(earlier).alias(f"__b_{v}") for v in values])
    sums = one.select(*by, at, "__span", *[F.sum(v).over(inside).alias(v) for v in values]).join(before, [*by, "__span"])
    return sums.select(*by, at, *[(F.col(v) + F.coalesce(f"__b_{v}", F.lit(0))).alias(v) for v in values])


def range_sums(ranges: DataFrame, rows: DataFrame, by: str, at: str, start: str, end: str, values: list[str], id_: str = "id", span: int = SPAN) -> DataFrame:
    """(id, sums of ``values``) of the rows with start <= at < end, 0 where there are none. ``id_`` names the ranges."""
    edges = F.explode(F.array(F.struct(F.col(start).alias(at), F.lit(-1).alias("sign")), F.struct(F.col(end).alias(at), F.lit(1).alias("sign")))).alias("e")
    asked = ranges.select(F.col(id_).alias("__id"), by, edges).select("__id", by, f"e.{at}", F.col("e.sign").alias("__sign"))
    sums = running(rows, [by], at, values, span)
    met = asof(asked, sums, by, at, values, strict=True, span=span)
    return met.groupBy(F.col("__id").alias(id_)).agg(*[F.sum(F.coalesce(v, F.lit(0)) * F.col("__sign")).alias(v) for v in values])


def _pieces(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[tuple[list[pa.RecordBatch], bool]]:
    """The rows of each value of ``group``, of batches sorted by it, as a list of slices, and whether it is the last that ends in its batch."""
    held, last = [], None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new = np.zeros(n - 1, bool)
        for c in group:
            x, y = b[c].slice(1), b[c].slice(0, n - 1)
            same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
            new |= ~same.to_numpy(zero_copy_only=False)
        ends = (np.flatnonzero(new) + 1).tolist()
        if held and tuple(b[c][0].as_py() for c in group) != last:
            yield held, not ends
            held = []
        start = 0
        for i, end in enumerate(ends):
            yield [*held, b.slice(start, end - start)], i == len(ends) - 1
            held, start = [], end
        held.append(b.slice(start))
        last = tuple(b[c][n - 1].as_py() for c in group)
    if held:
        yield held, True


def meet(points: DataFrame, start: str, series: DataFrame, by: list[str], at: str, length: int, columns: dict[str, str | DataType], run: Callable[[pa.Table, pa.Table], list[np.ndarray | pa.Array | pa.ChunkedArray]], reach: int | None = None) -> DataFrame:
    """``points`` with new ``columns`` (names and types) that ``run(points, rows)`` finds in each span of ``length`` of a key: the rows from a point's ``start`` to ``reach`` after it (``length`` if
    not given, which is the most) are all there. Spark sorts the spans; a task takes one after the other from its batches, as a group of its own for each would cost more than the few rows of most."""
    span = lambda c: F.floor(F.col(c) / length)
    own = F.struct(*points.columns)
    group = ["__span", *by]  # a number first: rows of different spans are told apart by the sort's prefix
    a = points.select(*by, span(start).alias("__span"), own.alias("__point"))
    near = F.array(span(at), span(at) - 1)
    if reach is not None:
        near = F.when(F.col(at) - span(at) * length <= reach, near).otherwise(F.array(span(at)))
    b = series.select(*by, F.explode(near).alias("__span"), F.struct(*[c for c in series.columns if c not in by]).alias("__row"))
    schema = StructType().add("__point", points.select(own.alias("p")).schema["p"].dataType)
    for c, kind in columns.items():
        schema = schema.add(c, kind)

    def find(rows: pa.Table) -> pa.Table:
        there = rows["__point"].is_valid()
        p = rows["__point"].filter(there).combine_chunks()
        names = [f.name for f in p.type]
        r = rows["__row"].filter(pc.invert(there)).combine_chunks()
        found = run(pa.table(p.flatten(), names=names), pa.table(r.flatten(), names=[f.name for f in r.type]))
        return pa.table([p, *(pa.array(x) if isinstance(x, np.ndarray) else x for x in found)], names=["__point", *columns])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for piece, last in _pieces(batches, group):
            rows = pa.Table.from_batches(piece)
            if rows["__point"].null_count < len(rows):
                done.append(find(rows))
            if last and done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done = []

    both = a.unionByName(b, allowMissingColumns=True).repartition(*group).sortWithinPartitions(*group)
    return both.mapInArrow(walk, schema).select("__point.*", *columns)


def asof_steps(points: DataFrame, series: DataFrame, by: list[str], at: str, value: str, steps: dict[str, int], span: int = SPAN) -> DataFrame:
    """``points`` with a column for each name of ``steps``: the ``value`` of the last row of ``series`` at most that step after a point's ``at``, null if there is none; of equal times the largest.

    All steps are found in one pass over spans, ``span`` long or as long as the steps lie apart. To the rows of each span comes what holds at its start, so that a value may be as old as it likes.
    """
    low = min(steps.values())
    length = max(span, max(steps.values()) - low)
    kind = series.schema[value].dataType
    known = series.where(F.col(at).isNotNull()).select(*by, F.col(at).cast("long").alias("__at"), F.lit(1).alias("__own"), F.col(value).alias("__v"))
    sought = points.select(*points.columns, (F.col(at).cast("long") + low).alias("__t"))
    place = lambda c: F.floor(F.col(c) / length).alias("__span")
    ends = known.groupBy(*by, place("__at")).agg(F.max(F.struct("__at", "__v")).alias("__e")).unionByName(sought.select(*by, place("__t")).distinct(), allowMissingColumns=True)
    earlier = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = ends.groupBy(*by, "__span").agg(F.max("__e").alias("__e")).withColumn("__e", F.last("__e", ignorenulls=True).over(earlier))
    held = spans.where("__e IS NOT NULL").select(*by, (F.col("__span") * length).alias("__at"), F.lit(0).alias("__own"), F.col("__e.__v").alias("__v"))

    def run(p: pa.Table, r: pa.Table) -> list[pa.ChunkedArray]:
        r = r.sort_by([("__at", "ascending"), ("__own", "ascending"), ("__v", "ascending")])
        t, x = r["__at"].to_numpy(), pc.fill_null(p["__t"], np.iinfo(np.int64).min // 2).to_numpy()
        last = [np.searchsorted(t, x + (s - low), "right") - 1 for s in steps.values()]
        return [r["__v"].take(pa.array(i, mask=i < 0)) for i in last]

    met = meet(sought, "__t", known.unionByName(held), by, "__at", length, dict.fromkeys(steps, kind), run, max(steps.values()) - low)
    return met.select(*points.columns, *steps)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    x = column.to_numpy()
    return x.astype(np.int64) if np.issubdtype(x.dtype, np.integer) else np.where(np.isnan(x), np.inf, x) if np.issubdtype(x.dtype, np.floating) else x.astype(float)


def _tree(values: np.ndarray) -> np.ndarray:
    """Largest values of aligned blocks: the values from half of the array on, the parent of node i at i // 2."""
    half = 1 << max(0, (len(values) - 1).bit_length())
    least = np.iinfo(np.int64).min if values.dtype == np.int64 else -np.inf
    tree = np.full(2 * half, least, values.dtype)
    tree[half : half + len(values)] = values
    while half > 1:
        tree[half // 2 : half] = np.maximum(tree[half : 2 * half : 2], tree[half + 1 : 2 * half : 2])
        half //= 2
    return tree


def _first(values: np.ndarray, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Place of the first value at or after ``start`` that is at least ``limit``, or the number of values: up the tree to the first block that holds one, then down into it."""
    n, tree = len(values), _tree(values)
    half = len(tree) // 2
    found = np.full(len(start), n, np.int64)
    todo = np.flatnonzero(start < n)
    node = start[todo] + half
    met = []
    while len(todo):
        hit = tree[node] >= limit[todo]
        met.append((todo[hit], node[hit]))
        todo, node = todo[~hit], node[~hit] + 1
        node //= node & -node
        going = node > 1
        todo, node = todo[going], node[going]
    if met:
        which, node = (np.concatenate(x) for x in zip(*met, strict=True))
        for _ in range(half.bit_length() - 1):
            lower = node < half
            child = np.where(lower, 2 * node, node)
            node = np.where(lower, child + (tree[child] < limit[which]), node)
        found[which] = node - half
    return np.minimum(found, n)


def _largest(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Largest value of each range of places, start < end."""
    tree = _tree(values)
    low, high = start + len(tree) // 2, end + len(tree) // 2
    out = np.full(len(start), tree.dtype.type(np.iinfo(np.int64).min if tree.dtype == np.int64 else -np.inf))
    while (open_ := low < high).any():
        left, right = open_ & (low % 2 == 1), open_ & (high % 2 == 1)
        out[left] = np.maximum(out[left], tree[low[left]])
        out[right] = np.maximum(out[right], tree[high[right] - 1])
        low, high = (low + left) // 2, (high - right) // 2
    return out


def range_totals(ranges: DataFrame, rows: DataFrame, by: str, at: str, start: str, end: str, sums: list[str], value: str, length: int) -> DataFrame:
    """``ranges`` of at most ``length`` that hold rows with start <= at < end, with n, the sums of the whole numbers ``sums`` and the least and largest ``value`` (lo, hi) of those: one pass for all."""
    kind = "double" if dict(rows.dtypes)[value] in ("double", "float") else "long"

    def run(p: pa.Table, r: pa.Table) -> list[np.ndarray]:
        r = r.sort_by("__at")
        t = r["__at"].to_numpy()
        a, z = (np.searchsorted(t, p[c].to_numpy()) for c in (start, end))
        n = z - a
        upto = [np.concatenate([[0], np.cumsum(r[c].to_numpy())]) for c in sums]
        v, some = _numbers(r["__v"]), n > 0
        ends = []
        for x, sign in ((-v, -1), (v, 1)):
            y = np.zeros(len(n), v.dtype)
            y[some] = sign * _largest(x, a[some], z[some])
            ends.append(y)
        return [n, *(u[z] - u[a] for u in upto), *ends]

    known = rows.where(F.col(value).isNotNull()).select(by, F.col(at).alias("__at"), *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in sums], F.col(value).cast(kind).alias("__v"))
    asked = ranges.where((F.col(end) > F.col(start)) & (F.col(end) - F.col(start) <= length))
    return meet(asked, start, known, [by], "__at", length, {"n": "long", **dict.fromkeys(sums, "long"), "lo": kind, "hi": kind}, run).where("n > 0")


def range_extremes(ranges: DataFrame, rows: DataFrame, by: str, at: str, start: str, end: str, value: str, leaf: int, length: int, id_: str = "id") -> DataFrame:
    """(id, lo, hi) of ``value`` over the rows with start <= at < end, for ranges that hold rows. Spans are ``length`` long, ``leaf`` at least; ranges longer than that are cut into pieces."""
    span = max(length, leaf)
    cut = F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(span).cast("long"))).alias("__s")
    pieces = ranges.where(F.col(end) > F.col(start)).select(F.col(id_).alias("__id"), by, F.col(end).alias("__end"), cut)
    pieces = pieces.select("__id", by, "__s", F.least(F.col("__end"), F.col("__s") + span).alias("__e"))
    return range_totals(pieces, rows, by, at, "__s", "__e", [], value, span).groupBy(F.col("__id").alias(id_)).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def passages(points: DataFrame, series: DataFrame, by: list[str], at: str, asked: dict[str, tuple[Column, Column, Column]], within: int, leaf: int = 1, until: str | None = None) -> DataFrame:
    """``points`` with a column for each name of ``asked`` (limit, value, up): the first time of ``series`` after a point's ``at``, ``within`` of it (and no later than its ``until``), at which
    the series' value is at least the point's limit (where ``up``, a column of the points) or at most it; null if there is none. Spans are ``within`` long, ``leaf`` at least."""
    last = F.col(at) + within if until is None else F.least(F.col(at) + within, F.col(until))
    own = F.struct(*points.columns).alias("__own")
    sought = points.select(own, *by, F.col(at).cast("long").alias("__t"), last.cast("long").alias("__u"), *[x for k, (limit, _, up) in asked.items() for x in (limit.alias(f"__limit_{k}"), up.alias(f"__up_{k}"))])
    known = series.select(*by, F.col(at).cast("long").alias("__at"), *[v.alias(f"__v_{k}") for k, (_, v, _) in asked.items()])

    names = list(asked)

    def run(p: pa.Table, r: pa.Table) -> list[pa.Array]:
        r = r.sort_by("__at")
        t, u = p["__t"].to_numpy(), pc.fill_null(p["__u"], np.iinfo(np.int64).min).to_numpy()
        out = []
        for k in names:
            there = r[f"__v_{k}"].is_valid()
            v, when = _numbers(r[f"__v_{k}"].filter(there)), r["__at"].filter(there).to_numpy()
            some, rises = p[f"__limit_{k}"].is_valid().to_numpy(), pc.fill_null(p[f"__up_{k}"], False).to_numpy()
            passed = np.full(len(t), np.iinfo(np.int64).max)
            for sign, side in ((1, some & rises), (-1, some & ~rises)):
                at_ = np.flatnonzero(side)
                if len(at_) and len(v):
                    limit = sign * p[f"__limit_{k}"].take(pa.array(at_)).to_numpy()
                    place = _first(sign * v, np.searchsorted(when, t[at_], "right"), limit)
                    passed[at_] = np.append(when, np.iinfo(np.int64).max)[place]
            out.append(pa.array(passed, mask=passed > u))
        return out

    met = meet(sought, "__t", known, by, "__at", max(within, leaf), dict.fromkeys(names, "long"), run)
    return met.select("__own.*", *names)


def first_passage(points: DataFrame, series: DataFrame, by: list[str], at: str, limit: str, value: str, up: Column, within: int, leaf: int, id_: str = "id", until: str | None = None) -> DataFrame:
    """(id, passed): the first time of ``series`` after each point's ``at``, ``within`` of it (and no later than its ``until``), at which ``value`` is at least ``limit``
    (where ``up``) or at most ``limit``; points without one have no row. ``id_`` names the points; null limits are never passed."""
    return passages(points, series, by, at, {"passed": (F.col(limit), F.col(value), up)}, within, leaf, until).where("passed IS NOT NULL").select(id_, "passed")
