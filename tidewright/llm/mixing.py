"""Mixing sources to target weights.

The words of each source, in an order fixed by hashes of the ids, are cut into blocks of a fixed length. Targets give each source a
number of slots. Every slot of every output shard draws its source with the targets as weights, so a shard's source counts are one multinomial
draw. Over all shards a source has then drawn some slots too many or too few, about the root of its number: the last ones of those that drew too many are
handed to those that drew too few, so that the mix meets its targets. The j-th slot of a source takes the block that the source's own
permutation gives for j modulo its blocks: every block is used before any is used again. Blocks are joined by their index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.asof import asof
from tidewright.session import materialise

WORDS = r"[^\x20\x09-\x0D]+"
#: Words a block, blocks a shard, share of all words that the mix takes, times that a source may be taken, weights by rank.
BLOCK, SHARD_BLOCKS, TOTAL, MOST, WEIGHTS = 64, 4096, 1.5, 2.0, (3, 1, 2)
#: Documents that one prefix sum runs over, and slots that one row is expanded to, about.
CHUNK = 100_000
#: Chunks that the documents are dealt into at least, so that a source that holds most of them is many tasks.
CHUNKS = 256
#: Slots that are numbered together.
NUMBERED = 1 << 14
U = np.uint64


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0 … n-1 for each row's n and key: a Feistel network, walked until it falls below n."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64), 2)
    half = ((bits + 1) // 2).astype(U)
    mask = (U(1) << half) - U(1)
    out, todo = x.astype(U), np.arange(len(x))
    limit, key = n.astype(U), key.astype(np.int64).view(U)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(5):
            z = (right + k) * U(0x9E3779B97F4A7C15) + U((r + 1) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)
            z = (z ^ (z >> U(29))) * U(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> U(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def targets(sources: DataFrame, total: float = TOTAL, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (key, source, source_size) with weight and target, in words.

    Sources by code point, null last, get the weights in turn; what is above ``most`` times a source's size is shared again
    by weight. That ends where the targets are min(cap, level * weight): sources sorted by cap / weight are capped from the least on,
    and running sums give the level. The windows run over one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    caps = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    given = caps.withColumn("before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    given = given.withColumn("w_all", F.sum("weight").over(whole)).withColumn("t_all", total * F.sum("source_size").over(whole))
    level = (F.col("t_all") - F.col("before")) / (F.col("w_all") - F.col("w_before"))
    # the first source in this order whose cap is not below its share fixes the level for itself and all after it
    fits = F.when(level * F.col("weight") <= F.col("cap"), level)
    given = given.withColumn("level", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return given.select("key", "source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def sized(docs: DataFrame, texts: bool = False) -> DataFrame:
    """(uid, doc_id, source, key, size, and text if asked for): size counts the words of the whole text; a null text has none. Written once."""
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    rows = docs.select("doc_id", source.alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), *([text.alias("text")] if texts else []))
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("source")))
    return materialise(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", key.alias("key"), "size", *(["text"] if texts else [])), "sized")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, block, uid, doc_id, first, words, at): the words of each document of :func:`sized` that lie in its source's blocks, from word ``at`` of the block on; none for size 0.

    The places are prefix sums in two steps, within chunks of a source and over its chunks, so a large source is no large group.
    """
    chunks = max(CHUNKS, -(-rows.count() // CHUNK))
    dealt = rows.where("size > 0").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)).cast("int"))
    sums = dealt.groupBy("key", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = F.sum("chunk_size").over(Window.partitionBy("key").orderBy("chunk")) - F.col("chunk_size")
    starts = sums.select("key", "chunk", before.alias("chunk_start"))
    within = F.sum("size").over(Window.partitionBy("key", "chunk").orderBy("doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = dealt.withColumn("within", within).join(starts, ["key", "chunk"]).withColumn("start", F.col("chunk_start") + F.col("within"))
    lo = F.floor(F.col("start") / block)
    hi = F.floor((F.col("start") + F.col("size") - 1) / block)
    each = placed.select("key", "uid", "doc_id", "start", "size", F.explode(F.sequence(lo, hi)).alias("block"))
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    at = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    return each.select("key", "block", "uid", "doc_id", first.alias("first"), (last - first).alias("words"), at.alias("at"))


def drawn(counted: DataFrame, total: int, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """(id, key) for the ``total`` slots of all shards: each draws a source with the weights m of ``counted`` (key, m, start, where start sums the m before).

    A slot's number is hashed to a point of the line on which the sources lie one after another. Up to CHUNK sources go to every task; beyond that the points
    meet the sources' beginnings in an as-of join.
    """
    spark = counted.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // (10 * CHUNK)))
    ids = spark.range(0, total, 1, tasks).select("id", F.pmod(F.xxhash64(F.lit(seed), F.floor(F.col("id") / shard_blocks), F.col("id") % shard_blocks), F.lit(max(total, 1))).alias("point"))
    lines = counted.where("m > 0").select("key", F.col("start").alias("point"))
    if lines.count() > CHUNK:
        one = F.lit(0).alias("one")
        return asof(ids.select("id", "point", one), lines.select("key", "point", one), "one", "point", ["key"], span=CHUNK).select("id", "key")
    held = lines.orderBy("point").toPandas()
    starts, keys = spark.sparkContext.broadcast(held["point"].to_numpy(np.int64)), spark.sparkContext.broadcast(pa.array(held["key"], pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(starts.value, batch.column(1).to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), keys.value.take(pa.array(at))], names=["id", "key"])

    return ids.mapInArrow(run, "id long, key string")


def slots(wanted: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """(shard, position, key, block, epoch): every slot of the mix, from the targets. The windows without a key run over one row a source."""
    n = F.ceil(F.col("source_size") / block)
    m = F.least(F.round(F.col("target") * n / F.col("source_size")), F.floor(F.lit(MOST) * n)).cast("long")
    counted = wanted.where("source_size > 0").select("key", n.cast("long").alias("n"), m.alias("m"))
    counted = materialise(counted.withColumn("start", F.sum("m").over(Window.orderBy("key")) - F.col("m")), "weights")
    total = counted.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    # number the slots of each source: within chunks of slots, and over chunks
    got = materialise(drawn(counted, total, shard_blocks, seed).withColumn("chunk", F.floor(F.col("id") / NUMBERED)), "drawn")
    sums = got.groupBy("key", "chunk").agg(F.count("*").alias("k"))
    starts = sums.select("key", "chunk", (F.sum("k").over(Window.partitionBy("key").orderBy("chunk")) - F.col("k")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("id")) - 1
    numbered = got.withColumn("r", rank).join(starts, ["key", "chunk"]).select("id", "key", (F.col("before") + F.col("r")).alias("j"))
    totals = counted.join(sums.groupBy("key").agg(F.sum("k").alias("k")), "key", "left").select("key", "n", "m", F.coalesce("k", F.lit(0)).alias("k"))
    over, under = F.greatest(F.col("k") - F.col("m"), F.lit(0)), F.greatest(F.col("m") - F.col("k"), F.lit(0))
    line = Window.orderBy("key")
    totals = materialise(totals.withColumn("over", F.sum(over).over(line) - over).withColumn("under", F.sum(under).over(line) - under), "draws")
    few = totals.count() <= CHUNK
    of = lambda *c: (F.broadcast if few else lambda x: x)(totals.select("key", *c))
    numbered = numbered.join(of("m", "over"), "key")
    extra = numbered.where("j >= m").select("id", (F.col("over") + F.col("j") - F.col("m")).alias("turn"))
    lacking = totals.where("k < m").select("key", F.col("k"), "under", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - F.col("k") - 1)).alias("i"))
    handed = extra.join(lacking.select("key", (F.col("under") + F.col("i")).alias("turn"), (F.col("k") + F.col("i")).alias("j")), "turn").select("id", "key", "j")
    final = numbered.where("j < m").select("id", "key", "j").unionByName(handed).join(of("n"), "key").select("id", "key", "j", "n", F.xxhash64(F.lit(seed), "key").alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, j, n, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
            yield pa.RecordBatch.from_arrays([pa.array(at // shard_blocks), pa.array(at % shard_blocks), batch.column(1), pa.array(permute(j % n, n, salt)), pa.array(j // n)], names=["shard", "position", "key", "block", "epoch"])

    return final.mapInArrow(run, "shard long, position long, key string, block long, epoch long")


def mix(docs: DataFrame, seed: int = 0, texts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mixture, rows, wanted). ``mixture`` has (shard, position, epoch, key, block, uid, doc_id, first, words): the words of documents
    that each slot holds, in order of ``first`` within documents. ``rows`` are :func:`sized`, ``wanted`` the targets by source.

    Empty tables give empty ones; texts without words are in no block; repeated rows are documents of their own (uid); a null id is ordered
    first. Reruns agree, except which of several equal rows has which share. The join's keys, (source, block), hold at most a block of words.
    """
    rows = sized(docs, texts)
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    wanted = materialise(targets(sources), "targets")
    # slots come from a table of one row a source, so the optimiser takes them for few: the hint keeps them from being broadcast
    return slots(wanted, seed=seed).hint("merge").join(pieces(rows), ["key", "block"]), rows, wanted


def shards(docs: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(shard, position, key, epoch, text): the mix itself. A text is a block's words, joined by single spaces; the last block of a source may be short."""
    rows = sized(docs, texts=True)
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    wanted = materialise(targets(sources), "targets")
    # a document meets its own pieces, and its words are cut before the pieces of a block meet
    placed = pieces(rows.drop("text"), block).groupBy("key", "uid").agg(F.collect_list(F.struct("block", "first", "words", "at")).alias("p"))
    cut = placed.join(rows.select("uid", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("w")), "uid").select("key", "w", F.explode("p").alias("p"))
    cut = cut.select("key", "p.block", "p.at", F.array_join(F.slice("w", (F.col("p.first") + 1).cast("int"), F.col("p.words").cast("int")), " ").alias("t"))
    blocks = cut.groupBy("key", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), " ").alias("text"))
    return slots(wanted, block, seed=seed).hint("merge").join(blocks, ["key", "block"]).select("shard", "position", "key", "epoch", "text")


def taken(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source) and taken, the words that the mix takes of it."""
    mixture, rows, wanted = mix(docs, seed)
    used = mixture.groupBy("uid").agg(F.sum("words").alias("taken"))
    out = rows.join(used, "uid", "left").join(F.broadcast(wanted.select("key", "source_size", "target")) if wanted.count() <= CHUNK else wanted.select("key", "source_size", "target"), "key")
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
