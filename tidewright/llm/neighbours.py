"""Approximate nearest neighbours by a forest of sorted hash strings.

Each of ``TREES`` trees projects a vector on ``CELLS`` Gaussian directions and writes the directions in order of their absolute
projection, with signs: a long string whose prefix of length x is shared by two vectors with a probability that depends on their
cosine alone. A tree is the sorted array of these strings; the vectors under a prefix are one stretch of it. Queries are put into the
arrays, meet the vectors under their longest prefixes first, and all trees ascend together, one symbol a round, until the fifth
best cosine of a query says that a vector as near was met in some tree with probability ``RECALL``. Queries that no prefix settles
meet all vectors, in blocks, so no vector is out of reach. Cosines are computed in double precision on the vectors themselves.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import materialise

NEAREST = 5
TREES, CELLS, SYMBOLS = 32, 64, 8
#: A symbol is a direction and its sign.
BITS = 7
#: Probability with which a vector as near as the last of the five found must have been met.
RECALL = 0.9
#: Components of the vectors of one bucket in one block; a larger bucket is split, and its queries go to each part.
BLOCK = 1 << 19
#: Queries searched exactly to see which prefix lengths settle queries at all. It decides which rounds run, not what is found.
PILOT = 64
#: A prefix length that settles fewer of the pilot queries has no round of its own.
WORTH = 0.05
SEED = 20240607
_SPLIT = 256
HITS = "query_id long, q long, vec_id long, score double"


@functools.lru_cache(maxsize=4)
def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, TREES * CELLS))


def strings(vectors: np.ndarray) -> np.ndarray:
    """Hash strings of each row for each tree, ``SYMBOLS`` symbols of ``BITS`` bits, the first symbol highest."""
    out = np.empty((len(vectors), TREES), np.int64)
    for a in range(0, len(vectors), _SPLIT):
        y = (vectors[a : a + _SPLIT] @ directions(vectors.shape[1])).reshape(-1, TREES, CELLS)
        size = np.abs(y)
        top = np.argpartition(size, CELLS - SYMBOLS, axis=2)[:, :, CELLS - SYMBOLS :]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 2), axis=2, kind="stable"), 2)
        symbol = top * 2 + (np.take_along_axis(y, top, 2) > 0)
        code = np.zeros(symbol.shape[:2], np.int64)
        for k in range(SYMBOLS):
            code = (code << BITS) | symbol[:, :, k]
        out[a : a + _SPLIT] = code
    return out


@functools.lru_cache(maxsize=1)
def settled_from(recall: float = RECALL) -> tuple[float, ...]:
    """For prefix lengths 1 to ``SYMBOLS``: the cosine from which two vectors share a prefix in some tree with probability ``recall``.

    Probabilities are counted on pairs of Gaussian vectors of known correlation, which is all they depend on.
    """
    rng = np.random.default_rng(SEED)
    one, two = rng.standard_normal((2, 16_384, CELLS))
    order = lambda y: np.argsort(-np.abs(y), axis=1, kind="stable")[:, :SYMBOLS]
    symbols = lambda y: (lambda o: o * 2 + (np.take_along_axis(y, o, 1) > 0))(order(y))
    base = symbols(one)
    grid = np.concatenate([np.arange(0, 0.9, 0.03), np.linspace(0.9, 1, 21)])
    shared = np.stack([np.cumprod(base == symbols(s * one + np.sqrt(max(0, 1 - s * s)) * two), axis=1).mean(0) for s in grid])
    met = 1 - (1 - shared) ** TREES
    return tuple(float(grid[np.argmax(met[:, x] >= recall)]) for x in range(SYMBOLS))


def usable(vectors: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vectors.isNotNull() & F.forall(vectors, lambda x: F.coalesce(finite(x), F.lit(False))) & F.exists(vectors, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two each, which rounds nothing, so that no square leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _encoded(rows: DataFrame) -> DataFrame:
    """(vec_id, v, dim) with ``codes``, one string a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                codes = strings(_scaled(_matrix(part.column(1))))
                flat = pa.array(codes.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * TREES), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["vec_id", "v", "dim", "codes"])

    return rows.mapInArrow(run, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, dim int, codes array<long>")


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``q`` with the same row of ``v``; the same two vectors always give the same bits."""
    q, v = _scaled(q), _scaled(v)
    return (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nearest(ids: np.ndarray, v: np.ndarray, uv: np.ndarray, qid: np.ndarray, qv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the nearest rows of ``v`` to each query, ties to smaller ids. The product only preselects."""
    rows, found, score = [], [], []
    for a in range(0, len(qid), _SPLIT):
        s = _unit(qv[a : a + _SPLIT]) @ uv.T
        s[qid[a : a + _SPLIT, None] == ids[None, :]] = -np.inf
        k = min(NEAREST, len(ids))
        least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
        i, j = np.nonzero(s >= np.maximum(least, -2)[:, None] - 1e-12)
        exact = _cosines(qv[a + i], v[j]) if len(i) else np.zeros(0)
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i, "left")
        top = nth < NEAREST
        rows.append(a + i[top])
        found.append(ids[j[top]])
        score.append(exact[top])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(score)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks a sorted array: the vectors of a bucket's part come first and are held, its queries follow and are answered."""
    key, held_ids, held = None, [], []
    ready = None
    for batch in batches:
        tree, prefix, part, dim = (batch.column(k).to_numpy() for k in range(4))
        asks, ids, number = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(), batch.column(6).to_numpy()
        cut = np.flatnonzero((tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1]) | (dim[1:] != dim[:-1]) | (asks[1:] != asks[:-1])) + 1
        out: list[tuple] = []
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, batch.num_rows).tolist(), strict=True):
            here = (tree[a], prefix[a], part[a], dim[a])
            if here != key:
                key, held_ids, held, ready = here, [], [], None
            if not asks[a]:
                held_ids.append(ids[a:b])
                held.append(batch.column(7).slice(a, b - a))
            elif held:
                if ready is None:
                    v = np.concatenate([_matrix(x) for x in held])
                    ready = np.concatenate(held_ids), v, _unit(v)
                row, found, score = _nearest(*ready, ids[a:b], _matrix(batch.column(7).slice(a, b - a)))
                out.append((ids[a:b][row], number[a:b][row], found, score))
        if out:
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "q", "vec_id", "score"])


ROW = ("tree", "prefix", "part", "dim", "asks", "vec_id", "q", "v")


def _meet(rows: DataFrame, queries: DataFrame, level: int) -> DataFrame:
    """HITS of ``queries`` among the vectors that share their prefix of ``level`` symbols in some tree; at level 0 among all vectors."""
    if level:
        tree = lambda df: df.select("*", F.posexplode("codes").alias("tree", "code")).withColumn("prefix", F.shiftright("code", BITS * (SYMBOLS - level)))
    else:
        tree = lambda df: df.withColumn("tree", F.lit(-1)).withColumn("prefix", F.lit(0).cast("long"))
    key = ["tree", "prefix", "dim"]
    asked = tree(queries).select(*key, "vec_id", "q", "v")
    there = tree(rows).select(*key, "vec_id", "v")
    # buckets of over a block are split; their list is written first, so that Spark knows its size and broadcasts it or not
    room = F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / F.col("dim")))
    large = there.groupBy(*key).count().where(F.col("count") > room).select(*key, F.ceil(F.col("count") / room).cast("int").alias("parts"))
    large = materialise(large, f"large-{level}")
    parts = F.coalesce("parts", F.lit(1))
    there = there.join(large, key, "left").select(*key, F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", F.lit(0).cast("long").alias("q"), "v")
    asked = asked.join(large, key, "left").select(*key, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("asks"), "vec_id", "q", "v")
    both = there.select(*ROW).unionByName(asked.select(*ROW))
    return both.repartition("tree", "prefix", "dim", "part").sortWithinPartitions("tree", "prefix", "dim", "part", "asks").mapInArrow(_met, HITS)


def _best(hits: DataFrame) -> DataFrame:
    """The nearest five of each query; a row met in several trees counts once."""
    by = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= NEAREST)


def _prepared(vectors: DataFrame, vec: str, id_: str) -> DataFrame:
    """Distinct usable rows (vec_id, v); float vectors stay floats, all others become doubles."""
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vec).alias("v")).where(F.col(id_).isNotNull())
    if rows.schema["v"].dataType.simpleString() != "array<float>":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    return rows.where(usable(F.col("v"))).distinct()


def search(vectors: DataFrame, queries: Column, vec: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the five nearest found of each row of ``vectors`` that meets the condition ``queries`` on its id.

    Null ids and vectors that are null, zero or hold null or non-finite components take no part; vectors of different lengths are never
    neighbours. Of rows that repeat id and vector one counts; rows that share an id only are no candidates of each other. Only the six
    smallest ids of one vector are candidates, as the others lose every tie; all are queries. Other columns are ignored, an
    empty table gives none.
    """
    rows = _prepared(vectors, vec, id_)
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    # the limit goes below the exchange, so copies of one vector do not meet in one task
    first = F.row_number().over(same)
    base = rows.withColumn("__n", first).where(F.col("__n") <= NEAREST + 1).drop("__n")
    base = materialise(_encoded(base.withColumn("dim", F.size("v"))), "forest")
    asking = materialise(_encoded(rows.where(queries.cast("boolean")).withColumn("dim", F.size("v"))).withColumn("q", F.xxhash64("v")), "queries")
    pilot = asking.orderBy(F.xxhash64("vec_id"), "vec_id", "q").limit(PILOT)
    pilot = materialise(pilot, "pilot")
    last = materialise(_best(_meet(base, pilot, 0)), "pilot-hits")
    enough = settled_from()
    share = [F.avg((F.col("s") >= c).cast("int")) for c in enough]
    got = last.groupBy("query_id", "q").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == NEAREST).agg(*(F.coalesce(x, F.lit(0.0)).alias(f"_{k}") for k, x in enumerate(share))).first()
    found = [last]
    left = asking.join(pilot.select("vec_id", "q"), ["vec_id", "q"], "left_anti")
    before = 0.0
    for level in range(SYMBOLS, 0, -1):
        if got[level - 1] - before < WORTH:
            continue
        before = got[level - 1]
        hits = materialise(_best(_meet(base, left, level)), f"hits-{level}")
        done = hits.where((F.col("rank") == NEAREST) & (F.col("score") >= enough[level - 1])).select("query_id", "q")
        found.append(hits.join(done, ["query_id", "q"], "left_semi"))
        left = left.join(done.select(F.col("query_id").alias("vec_id"), "q"), ["vec_id", "q"], "left_anti")
        left = materialise(left, f"left-{level}")
    found.append(_best(_meet(base, left, 0)))
    out = functools.reduce(DataFrame.unionByName, found)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
