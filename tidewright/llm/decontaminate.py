"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the tokens of a window and ignore the rest, so a hash survives substitutions at the ignored places. Hashes
of test items (seeds) are joined with those of the documents, and around each hit the ungapped alignment is verified word by word.

The documents are read once, however many test items there are. A bitmap of fixed size over the seeds' hashes goes to every task and lets
most windows of most texts fall at once; what it lets through, right or wrong, meets the seeds in a shuffle join. Equal texts are looked at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textnum as tn
from tidewright.session import materialise

#: Masks of weight 7: 1 is hashed, 0 is ignored. Together they find every overlap: any pattern of 13 equal words or more with a fifth of others at most holds one of the
#: masks somewhere, whatever its length. A test walks all patterns up to 120 words; a longer one falls into parts of 20 to 40 words, of which one has a fifth at most.
MASKS = ("11101111", "110011111", "1111010011", "110100010111", "1110100001011")
#: An overlap has at least so many equal words, or the whole item if that is shorter, and this share of its words equal.
MIN_WORDS, MIN_SHARE = 13, 0.8
#: Items of so many words or more have the seeds of all masks.
SPAN = max(map(len, MASKS))
#: What a word counts, in whole numbers: a sum of 0 or more means the share.
EQUAL, OTHER = 1, -4
#: Items of fewer words overlap nothing: any text may hold them.
MIN_ITEM = 5
#: Bits of the bitmap over the seeds (8 MB). A larger test set fills it, lets more windows through to the join, and loses nothing.
FILTER_BITS = 1 << 26
#: Words of a text in one row; tasks that a hot key is dealt over, and hot keys at most.
TILE, SALTS, HOT = 4096, 64, 512
#: Up to so many overlapping texts are broadcast to the documents (about 10 MB); more are joined by a shuffle.
BROADCAST_TEXTS = 200_000
_MULT = 0xD6E8FEB86659FD93
SCHEMA = "item_id long, first_word long, n_words long, n_matched long"


def _word_hashes(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = tn.lower_latin(buf)
    start, end, first = tn.words(low, at, tn.PUNCT)
    return tn.span_hash(tn.prefix_hash(low), start, end), first


def _spaced(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash under ``mask`` of the window at each place of h (windows may cross texts)."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out *= np.uint64(_MULT)
            out += h[i : i + n]
    return tn.mix(out)


def _masks(n: int) -> list[str]:
    """Masks that the seeds of an item of n words have: a short item must stand whole."""
    return list(MASKS) if n >= SPAN else ["1" * n]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, item_id, words) of items with enough words; words as hashes."""
    for batch in batches:
        for a, b, buf, at in tn.slices(batch.column(2)):
            h, first = _word_hashes(buf, at)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            rows = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["item", "item_id", "words"])
            yield rows.filter(pa.array(np.diff(first) >= MIN_ITEM))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, item, place) of every masked window of the items (item, words)."""
    for batch in batches:
        for i in range(batch.num_rows):
            w = batch.column(1)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            keys = [_spaced(w, mask) for mask in _masks(len(w))]
            place = np.concatenate([np.arange(len(k), dtype=np.int32) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array([batch.column(0)[i].as_py()] * len(place), pa.binary()), pa.array(place)], names=["key", "item", "place"])


@dataclass
class Filter:
    """The masks in use, and the words of the bitmap that are not 0."""

    masks: list[str]
    at: np.ndarray
    word: np.ndarray
    bits: int

    def bitmap(self) -> np.ndarray:
        out = np.zeros(self.bits // 64, np.uint64)
        out[self.at] = self.word
        return out

    def windows(self, bitmap: np.ndarray, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, key) of the windows inside one text that the bitmap lets through, in order of place."""
        places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for mask in self.masks:
            k = _spaced(h, mask)
            low = k & np.uint64(self.bits - 1)
            at = np.flatnonzero((bitmap[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1))
            end = first[np.searchsorted(first, at, "right")] if len(at) else at
            at = at[at + len(mask) <= end]
            places.append(at)
            keys.append(k[at])
        place, key = np.concatenate(places), np.concatenate(keys)
        order = np.argsort(place, kind="stable")
        return place[order], key[order]


HITS = "t1 long, t2 long, tile int, places array<int>, keys array<long>, words array<long>"


def _hits(seen: Filter, tile: int):
    """From rows (t1, t2, text) the tiles of all texts that have a window which the bitmap lets through, with these windows and the words' hashes."""

    def lists(values: np.ndarray, cut: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = seen.bitmap()
        for batch in batches:
            for a, _, buf, at in tn.slices(batch.column(2)):
                h, first = _word_hashes(buf, at)
                place, key = seen.windows(bitmap, h, first)
                for i in np.unique(np.searchsorted(first, place, "right") - 1).tolist():
                    lo, hi = int(first[i]), int(first[i + 1])
                    own = slice(*np.searchsorted(place, [lo, hi]).tolist())
                    p, k, w = place[own] - lo, key[own], h[lo:hi]
                    starts = np.arange(0, hi - lo, tile)
                    names = [pa.array([batch.column(c)[a + i].as_py()] * len(starts), pa.int64()) for c in (0, 1)]
                    cut = np.append(np.searchsorted(p, starts), len(p))
                    yield pa.RecordBatch.from_arrays(
                        [*names, pa.array((starts // tile).astype(np.int32)), lists(p, cut, pa.int32()), lists(k.view(np.int64), cut, pa.int64()), lists(w.view(np.int64), np.append(starts, len(w)), pa.int64())],
                        names=[x.split()[0] for x in HITS.split(", ")],
                    )

    return run


def best_segment(same: np.ndarray) -> tuple[int, int, int]:
    """(begin, end, equal words) of the segment with the share that has the most equal words; its first and last word are equal.

    An equal word counts 1, another -4, in whole numbers; for each end the earliest start whose sum so far is no larger.
    """
    total = np.concatenate([[0], np.cumsum(np.where(same, EQUAL, OTHER))])
    equal = np.concatenate([[0], np.cumsum(same)])
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    end = int(np.argmax(equal - equal[start]))
    inside = np.flatnonzero(same[start[end] : end]) + start[end]
    return (int(inside[0]), int(inside[-1]) + 1, len(inside)) if len(inside) else (0, 0, 0)


OVERLAP = "t1 long, t2 long, item binary, first_word long, n_words long, n_matched long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (t1, t2, item, diagonal, window, words) those whose best segment is an overlap. The window holds the text's words from the later of 0 and the diagonal on."""
    for batch in batches:
        found, rows = [], []
        window, words = batch.column(4), batch.column(5)
        for i, diagonal in enumerate(batch.column(3).to_pylist()):
            w = words[i].values.to_numpy(zero_copy_only=False)
            skip = max(0, -diagonal)
            t = window[i].values.to_numpy(zero_copy_only=False)[: len(w) - skip]
            begin, end, matched = best_segment(t == w[skip : skip + len(t)])
            if end > begin and matched >= min(MIN_WORDS, len(w)):
                rows.append(i)
                found.append((max(0, diagonal) + begin, end - begin, matched))
        if rows:
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))], names=[x.split()[0] for x in OVERLAP.split(", ")])


def _salted(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """Hits (t1, t2, at, key) with the seeds of their key. The HOT keys that most hits have are dealt over SALTS tasks, with the seeds of each copied to all of them."""
    hot = hits.groupBy("key").agg(F.count("*").alias("n")).where(f"n >= {SALTS}").orderBy(F.desc("n"), "key").limit(HOT).select("key").toPandas()
    hot = F.broadcast(hits.sparkSession.createDataFrame(hot, "key long").withColumn("hot", F.lit(True)))
    a = hits.join(hot, "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("t1", "t2", "at"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return a.join(seeds.join(hot, "key", "left").withColumn("salt", F.explode(every)).drop("hot"), ["key", "salt"])


def _names(text: Column) -> list[Column]:
    """Two hashes that name a text; a null is an empty one."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit("t"), whole).alias("t2")]


def _overlapping(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, item, first_word, n_words, n_matched) of the texts and items that overlap, the best of each pair; and the items (item, item_id, words)."""
    spark = docs.sparkSession
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    named = named.select(F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "text"))).alias("item"), "item_id", "text")
    items = materialise(named.mapInArrow(_items, "item binary, item_id long, words array<long>"), "items")
    seeds = materialise(items.select("item", "words").mapInArrow(_seeds, "key long, item binary, place int"), "seeds")
    short = [r.n for r in items.select(F.size("words").alias("n")).where(F.col("n") < SPAN).distinct().collect()]
    low = seeds.select(F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("b"))
    words = low.groupBy(F.expr("shiftrightunsigned(b, 6)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 AS int)))").alias("word")).toPandas()
    seen = Filter([*MASKS, *("1" * n for n in sorted(short))], words["at"].to_numpy(np.int64), words["word"].to_numpy(np.int64).view(np.uint64), FILTER_BITS)
    sent, tile = spark.sparkContext.broadcast(seen), TILE
    passed = docs.select(*_names(F.col("text")), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: _hits(sent.value, tile)(batches), HITS)
    once = passed.groupBy("t1", "t2", "tile").agg(F.first(F.struct("places", "keys", "words")).alias("h"))
    tiles = materialise(once.select("t1", "t2", "tile", "h.*"), "hits")
    hits = tiles.select("t1", "t2", F.explode(F.arrays_zip("places", "keys")).alias("h")).select("t1", "t2", F.col("h.places").alias("at"), F.col("h.keys").alias("key"))
    met = _salted(hits, seeds).select("t1", "t2", "item", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    # from here on a hot key is rows that meet one row each: adaptive execution splits it
    placed = met.join(items.select("item", "words"), "item").withColumn("begin", F.greatest("diagonal", F.lit(0))).withColumn("last", F.col("diagonal") + F.size("words") - 1)
    parts = placed.withColumn("tile", F.explode(F.sequence(F.floor(F.col("begin") / TILE).cast("int"), F.floor(F.col("last") / TILE).cast("int"))))
    held = parts.join(tiles.select("t1", "t2", "tile", F.col("words").alias("text")), ["t1", "t2", "tile"])
    offset = F.col("tile") * TILE
    cut = F.slice("text", F.greatest(F.col("begin") - offset, F.lit(0)) + 1, F.greatest(F.col("last") + 1 - F.greatest("begin", offset), F.lit(0)).cast("int"))
    windows = held.groupBy("t1", "t2", "item", "diagonal").agg(F.sort_array(F.collect_list(F.struct("tile", cut.alias("w")))).alias("parts"), F.first("words").alias("words"))
    pairs = windows.select("t1", "t2", "item", "diagonal", F.flatten("parts.w").alias("window"), "words")
    verified = pairs.mapInArrow(_verify, OVERLAP)
    best = verified.groupBy("t1", "t2", "item").agg(F.max_by(F.struct("first_word", "n_words", "n_matched"), F.struct("n_matched", -F.col("first_word"))).alias("o"))
    return materialise(best.select("t1", "t2", "item", "o.*"), "overlaps"), items


def overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row for each document and item that overlap: columns ``keep`` of docs (doc_id by default), then SCHEMA.

    Of several overlaps of a pair the one with the most equal words counts, then the first. Words are runs of letters, digits and
    non-ASCII characters, in lower case. Null and empty texts and items overlap nothing; an item of 5 to 12 words must stand whole, one of fewer overlaps
    nothing; repeated documents report each, repeated test rows once; null ids stay null.
    """
    keep = ["doc_id"] if keep is None else keep
    found, items = _overlapping(docs, benchmark)
    named = [x.split()[0] for x in SCHEMA.split(", ")]
    report = materialise(found.join(items.select("item", "item_id"), "item").select(F.struct("t1", "t2").alias("t"), *named), "report")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in keep], F.struct(*_names(F.col("text"))).alias("t"))
    both = rows.join(F.broadcast(report) if report.count() <= BROADCAST_TEXTS else report, "t")
    return both.select(*[F.col(f"`__{c}`").alias(c) for c in keep], *named)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text overlaps no test item (see :func:`overlaps`), with all their columns."""
    found = _overlapping(docs, benchmark)[0].select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).distinct()
    t1, t2 = _names(docs["text"])
    same = (t1 == found["__t1"]) & (t2 == found["__t2"])
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found, same, "left_anti")
