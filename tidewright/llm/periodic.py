"""Periodic runs of words: each text's word ids are compared with every shift of themselves.

A run is a stretch of words with smallest period q, at least ``MIN_LENGTH`` words and ``MIN_EXP`` periods long, that neither neighbour
extends. At shift q such a stretch shows as consecutive matches ``length - q`` long, so every shift up to n / MIN_EXP is compared
whole and the true stretches are measured. A stretch of period q also matches at multiples of q, with the same ends: the smallest
shift names its period. Texts in which this is much work are dealt out as ranges of shifts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textnum as tn
from tidewright.session import materialise

MIN_LENGTH, MIN_EXP = 6, 4
#: Comparisons in one range of shifts of one text, about half a second's; a text with more is dealt out.
RANGE_WORK = 1 << 30
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def scan(ids: np.ndarray, first: np.ndarray, low: int = 1, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs with low <= period < high in the concatenated words ``ids`` of several texts.

    ``first`` are the ends of the texts, longest text first; words of different texts have different ids. Only the texts that
    are long enough for a shift are compared with it.
    """
    sizes = np.diff(first)
    top = int(sizes[0]) // MIN_EXP if len(sizes) else 0
    high = top + 1 if high is None else min(high, top + 1)
    found = []
    for q in range(low, high):
        need = max(MIN_LENGTH, MIN_EXP * q) - q
        # texts are sorted by length, so those with at least need + q words are a prefix
        a = ids[: first[np.searchsorted(-sizes, -(need + q), "right")]]
        same = a[q:] == a[:-q]
        # a stretch of ``need`` matches holds one of every ``need`` places: only there can it be
        marks = np.flatnonzero(same[need - 1 :: need])
        if not len(marks):
            continue
        marks = marks * need + need - 1
        breaks = np.flatnonzero(~same)
        k = np.unique(np.searchsorted(breaks, marks))
        start = np.where(k > 0, breaks[np.maximum(k, 1) - 1] + 1, 0) if len(breaks) else np.zeros(1, np.int64)
        end = np.where(k < len(breaks), breaks[np.minimum(k, len(breaks) - 1)], len(same)) if len(breaks) else np.array([len(same)])
        long = end - start >= need
        found.append((start[long], end[long] - start[long] + q, np.full(int(long.sum()), q)))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    s, n, q = (np.concatenate(x) for x in zip(*found, strict=True))
    # the same stretch at a multiple of its period comes later: the first is the period
    order = np.lexsort((q, n, s))
    s, n, q = s[order], n[order], q[order]
    once = np.append(True, (s[1:] != s[:-1]) | (n[1:] != n[:-1]))[: len(s)]
    s, n, q = s[once], n[once], q[once]
    order = np.lexsort((q, s))
    return s[order], n[order], q[order]


def _ordered(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends of each text in turn, index of its first; ids and ends with the longest text first, and that order."""
    start, end, first = tn.words(buf, at, tn.SPACE)
    h = tn.span_hash(tn.prefix_hash(buf), start, end)
    # words of one text have equal ids if they are equal, words of two texts never
    _, ids = np.unique(tn.mix(h + tn.owners(first).astype(tn.U) * tn.U(0xA24BAED4963EE407)), return_inverse=True)
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    ends = np.concatenate([[0], np.cumsum(sizes[order])])
    words = np.repeat(first[:-1][order] - ends[:-1], sizes[order]) + np.arange(ends[-1])
    return start, end, first, ids[words].astype(np.int32), ends, order


def _collapsed(data: bytes, start: np.ndarray, end: np.ndarray, runs: list[tuple[int, int, int]]) -> str:
    """The words that no run repeats, joined by one space."""
    stays = np.ones(len(start), bool)
    for s, n, q in runs:
        stays[s + q : s + n] = False
    return b" ".join([data[a:b] for a, b in zip(start[stays].tolist(), end[stays].tolist(), strict=True)]).decode()


def _as_arrow(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
    values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _whole(docs: DataFrame, own: list[str]) -> DataFrame:
    """n_words, runs and collapsed of texts that one task scans at all shifts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, at in tn.slices(batch.column(len(own))):
                start, end, first, ids, ends, order = _ordered(buf, at)
                s, n, q = scan(ids, ends)
                text = np.searchsorted(ends, s, "right") - 1
                runs: list[list[tuple[int, int, int]]] = [[] for _ in range(b - a)]
                for t, x in zip(order[text].tolist(), zip((s - ends[text]).tolist(), n.tolist(), q.tolist(), strict=True), strict=True):
                    runs[t].append(x)
                data = buf.tobytes()
                short = [_collapsed(data, start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], sorted(r)) for i, r in enumerate(runs)]
                out = [batch.column(i).slice(a, b - a) for i in range(len(own))]
                out += [pa.array(np.diff(first)), _as_arrow([sorted(r, key=lambda x: (x[0], x[2])) for r in runs]), pa.array(short, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=[*own, "n_words", "runs", "collapsed"])

    return docs.select(*own, "__text").mapInArrow(run, _schema(docs, own, f"n_words long, runs {RUNS}, collapsed string"))


def _schema(docs: DataFrame, own: list[str], more: str) -> str:
    return ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own), more])


def _ranges(texts: DataFrame, work: int) -> DataFrame:
    """(__key, start, length, period) of texts (__key, __text), each range of shifts a row of its own that any machine may take."""
    words = F.col("n")
    step = F.greatest(F.lit(1).cast("long"), F.floor(work / F.greatest(words, F.lit(1))).cast("long"))
    texts = texts.withColumn("n", F.regexp_count("__text", F.lit(WORD)).cast("long"))
    dealt = texts.withColumn("low", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(words / MIN_EXP).cast("long") + 1, step))).withColumn("high", F.col("low") + step)
    dealt = dealt.repartition("__key", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for _, _, buf, at in tn.slices(batch.column(1).slice(i, 1)):
                    *_, ids, ends, _ = _ordered(buf, at)
                    s, n, q = scan(ids, ends, batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                    key = pa.array([batch.column(0)[i].as_py()] * len(s), pa.string())
                    yield pa.RecordBatch.from_arrays([key, pa.array(s), pa.array(n), pa.array(q)], names=["__key", "start", "length", "period"])

    return dealt.select("__key", "__text", "low", "high").mapInArrow(run, "__key string, start long, length long, period long")


def _finish(docs: DataFrame, own: list[str]) -> DataFrame:
    """n_words, runs and collapsed of texts whose ``runs`` are known."""
    k = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, at in tn.slices(batch.column(k)):
                start, end, first = tn.words(buf, at, tn.SPACE)
                runs = [[(x["start"], x["length"], x["period"]) for x in r or []] for r in batch.column(k + 1).slice(a, b - a).to_pylist()]
                data = buf.tobytes()
                short = [_collapsed(data, start[first[i] : first[i + 1]], end[first[i] : first[i + 1]], r) for i, r in enumerate(runs)]
                out = [batch.column(i).slice(a, b - a) for i in range(k)]
                out += [pa.array(np.diff(first)), _as_arrow([sorted(r, key=lambda x: (x[0], x[2])) for r in runs]), pa.array(short, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=[*own, "n_words", "runs", "collapsed"])

    return docs.select(*own, "__text", "runs").mapInArrow(run, _schema(docs, own, f"n_words long, runs {RUNS}, collapsed string"))


def bytes_of(text: Column) -> Column:
    return F.octet_length(F.coalesce(text.cast("string"), F.lit("")))


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, work: int = RANGE_WORK, size: str | None = None) -> DataFrame:
    """``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` for each row of ``docs``.

    ``collapsed`` has the words that no run holds after its first period, joined by one space. A null or empty text has no words, no runs
    and an empty ``collapsed``; repeated rows count alike; an empty table gives none; columns of ``docs`` named as the results
    are left out. Texts of over ``work`` comparisons, if every other byte were a word, are dealt out as ranges of shifts; of all others nothing is shuffled.
    ``size`` names a column with about as many bytes as the text has, where a text is an expression that should not be read only to be measured.
    """
    made = ("n_words", "runs", "collapsed")
    own = [c for c in (keep if keep is not None else docs.columns) if c not in made and c not in ("__text", "__key")]
    bytes_ = (bytes_of(F.col(text)) if size is None else F.col(size)).cast("double")
    long = bytes_ * bytes_ / (4 * MIN_EXP) > work
    pick = lambda rows: docs.where(rows).select(*own, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    short = _whole(pick(~long), own)
    # equal long texts are scanned once, whatever row they stand in
    heavy = materialise(pick(long).withColumn("__key", F.sha2("__text", 256)), "long-texts")
    one = heavy.groupBy("__key").agg(F.any_value("__text").alias("__text"))
    runs = _ranges(one, work).groupBy("__key", "start", "length").agg(F.min("period").alias("period"))
    runs = runs.groupBy("__key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    known = heavy.select(*own, "__text", "__key").join(runs, "__key", "left")
    return short.unionByName(_finish(known, own))


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a text in which a tenth of the documents, by crc32 of doc_id, repeat a stretch to their end; a null id repeats none. ``size`` has the bytes it had before."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    source = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).cast("long").alias("g"), bytes_of(F.col("text")).alias("size"))
    w, n = F.col("w"), F.size("w").cast("long")
    source = source.select("*", F.when(n > 0, F.col("g") % n).alias("a"))
    period = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long")
    source = source.select("*", F.when(n > 0, period).alias("p"))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    # the stretch from a, p words long, as often as it takes: slices, whose cost does not grow with each word's place
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    again = F.concat(F.slice(w, F.lit(1), a), tail)
    return source.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"), "size")
