"""Structured Streaming forms of the tape and book operators. Batch and stream give the same rows for what the watermark has closed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.operators.book import Ladder
from tidewright.session import scratch


def event_time(tape: DataFrame) -> DataFrame:
    return tape.withColumn("ts", F.timestamp_millis("ts_ms"))


def live_bars(tape: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Bars by symbol and tumbling window, each emitted once, when the watermark passes its end. Later rows are dropped."""
    at = F.struct("ts_ms", "id")
    bars = event_time(tape).withWatermark("ts", delay).groupBy(F.window("ts", width), "symbol")
    return bars.agg(F.min_by("tick", at).alias("open"), F.max("tick").alias("high"), F.min("tick").alias("low"), F.max_by("tick", at).alias("close"), F.sum("lots").alias("lots"), F.count("*").alias("trades")).select(
        "symbol", F.unix_millis("window.start").alias("start_ms"), "open", "high", "low", "close", "lots", "trades"
    )


def sliding_counts(tape: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    return event_time(tape).groupBy(F.window("ts", width, slide), "symbol").agg(F.count("*").alias("trades"), F.sum("lots").alias("lots")).select("symbol", F.unix_millis("window.start").alias("start_ms"), "trades", "lots")


def sessions(tape: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return event_time(tape).groupBy(F.session_window("ts", gap), "symbol").agg(F.count("*").alias("trades"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms")).select("symbol", "start_ms", "end_ms", "trades")


def deduplicated(fills: DataFrame, key: str = "id", delay: str = "1 hour") -> DataFrame:
    """Each key once, however often it is delivered within the delay."""
    return event_time(fills).withWatermark("ts", delay).dropDuplicatesWithinWatermark([key]).drop("ts")


BOOK_OUT = "symbol string, u long, ts_ms long, bid long, ask long, valid boolean"
BOOK_STATE = "sides array<int>, ticks array<long>, sizes array<double>, last_u long, valid boolean"


def _book(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    book = Ladder()
    last, valid = -1, False
    if state.exists:
        sides, ticks, sizes, last, valid = state.get
        for level in zip(sides, ticks, sizes, strict=True):
            book.put(*level)
    out = []
    changes = pd.concat(list(batches)).sort_values(["u", "snap"], ascending=[True, False], kind="stable")  # those of one micro-batch
    for u, ts, snap, side, tick, size in changes[["u", "ts_ms", "snap", "side", "tick", "size"]].itertuples(index=False):
        if snap:
            if u != last:
                book = Ladder()
            valid = True
        elif not valid or u not in (last, last + 1):
            valid = False
        last = int(u)
        if not valid:
            out.append((key[0], int(u), int(ts), None, None, False))
            continue
        book.put(int(side), int(tick), float(size))
        out.append((key[0], int(u), int(ts), book.best(1), book.best(-1), True))
    levels = book.levels()
    state.update(([s for s, _, _ in levels], [t for _, t, _ in levels], [x for _, _, x in levels], last, valid))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in BOOK_OUT.split(", ")]).astype({"bid": "Int64", "ask": "Int64"})


def live_book(deltas: DataFrame) -> DataFrame:
    """Best bid and ask after every change, by symbol, kept in the state store between batches.

    A change before the first snapshot, or one whose id does not follow the last, makes the book invalid until a snapshot repairs it.
    """
    return deltas.groupBy("symbol").applyInPandasWithState(_book, BOOK_OUT, BOOK_STATE, "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, table: DataFrame, build, files: int | None = 1, per_batch: int | None = None) -> DataFrame:
    """Write ``table`` as ``files`` (as many as it has partitions where None), stream them through ``build`` to Parquet until all are read, and return what was written.
    Files are one batch unless ``per_batch`` bounds it; then their order is not that of their rows' times, and a watermark may close on some. For tests and queries."""
    source, sink, marks = (scratch(spark, x) for x in ("stream-in", "stream-out", "stream-marks"))
    (table if files is None else table.coalesce(files)).write.parquet(source)
    reader = spark.readStream.schema(table.schema)
    stream = build((reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(source))
    run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def decide_once(batch: DataFrame, done: DataFrame, most_age_ms: int = 3_600_000) -> DataFrame:
    """Decisions of a batch (label, ts_ms, price_ms, healthy) that may be sent: never one whose label was sent, none on an unhealthy feed or a stale price."""
    fresh = batch.where(F.col("healthy") & (F.col("ts_ms") - F.col("price_ms") <= most_age_ms))
    once = fresh.groupBy("label").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "label"]), "ts_ms").alias("s")).select("label", "s.*")
    return once.join(done.select("label"), "label", "left_anti")


def upsert_sink(spark: SparkSession, path: str, keys: list[str], order: str):
    """A foreachBatch function that appends a batch's latest row per key with its epoch; :func:`read_upserts` folds them. Replayed epochs overwrite themselves."""

    def write(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("s")).select(*keys, "s.*")
        latest.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def read_upserts(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "epoch")]), F.struct(order, "epoch")).alias("s")).select(*keys, "s.*")
