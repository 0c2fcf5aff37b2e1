"""Readers and writers of market data files. All go through Spark's file sources, so any store that Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.asof import latest
from tidewright.session import exists


def macro_series(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(series, date, value) of CSV files with a date and a value; what is no number is null. Long form: no outer join of columns is needed."""
    out = None
    for name, path in paths.items():
        df = spark.read.option("header", True).csv(path)
        one = df.select(F.lit(name).alias("series"), F.to_date(F.col(df.columns[0])).alias("date"), F.expr(f"try_cast(`{df.columns[1]}` AS double)").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def wide(series: DataFrame, names: list[str]) -> DataFrame:
    return series.groupBy("date").pivot("series", names).agg(F.first("value", ignorenulls=True))


def cached_panel(cache: DataFrame, fetched: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """The wanted assets from the cache, with those it lacks taken from ``fetched``; and the names still missing (at most len(wanted))."""
    names = cache.sparkSession.createDataFrame([(x,) for x in wanted], "asset string")
    held = cache.select("asset").distinct()
    lacking = names.join(held, "asset", "left_anti")
    out = cache.unionByName(fetched.join(F.broadcast(lacking), "asset", "left_semi"), allowMissingColumns=True).join(F.broadcast(names), "asset", "left_semi")
    missing = [r.asset for r in lacking.join(fetched.select("asset").distinct(), "asset", "left_anti").collect()]
    return out, sorted(missing)


def adjusted_panel(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(asset, date, open, high, low, close, volume) from vendor CSV files, one an asset and named after it, with columns Date, Open, High, Low, Close, Adj Close, Volume.

    Prices are scaled by Adj Close / Close, so the close is the adjusted one; days without it are left out, as are days before ``start`` or from ``end`` on. A file is one task; what is no number is null.
    """
    raw = spark.read.option("header", True).csv(path).withColumn("asset", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    factor = number("Adj Close") / F.nullif(number("Close"), F.lit(0.0))
    scaled = [(number(c) * factor).alias(c.lower()) for c in ("Open", "High", "Low")]
    out = raw.select("asset", F.expr("try_cast(`Date` AS date)").alias("date"), *scaled, number("Adj Close").alias("close"), number("Volume").alias("volume")).where("date IS NOT NULL AND close IS NOT NULL")
    for bound, side in ((start, lambda d: F.col("date") >= d), (end, lambda d: F.col("date") < d)):
        if bound is not None:
            out = out.where(side(F.lit(bound).cast("date")))
    return out


TRADES = "agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long, transact_time long, is_buyer_maker boolean"


def archive_to_parquet(spark: SparkSession, csv: str, parquet: str, schema: str = TRADES) -> dict[str, int]:
    """Typed Parquet (zstd, sorted by id inside its files) of a CSV archive whose header is optional; row counts in and out must agree."""
    raw = spark.read.schema(", ".join(f"{c.split()[0]} string" for c in schema.split(", "))).csv(csv)
    first = schema.split()[0]
    kept = raw.where(F.col(first) != first)
    typed = kept.select(*[F.expr(f"try_cast(`{c.split()[0]}` AS {c.split()[1]})").alias(c.split()[0]) for c in schema.split(", ")])
    typed.sortWithinPartitions(first).write.option("compression", "zstd").mode("overwrite").parquet(parquet)
    counts = {"read": kept.count(), "written": spark.read.parquet(parquet).count()}
    if counts["read"] != counts["written"]:
        raise ValueError(f"{csv}: {counts}")
    return counts


def checksums(df: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, length, sha256) of binary files read by Spark: a manifest to compare with a published one."""
    return df.select(path_col, "length", F.sha2("content", 256).alias("sha256"))


BOOK_MESSAGE = "ts long, cts long, type string, data struct<u:long, seq:long, b:array<array<string>>, a:array<array<string>>>"


def book_messages(lines: DataFrame, scale: float = 10.0) -> DataFrame:
    """One row per level of JSON messages (column ``value``): ts, cts (ts where missing), u, seq, snap, side, tick, size."""
    m = lines.select(F.from_json("value", BOOK_MESSAGE).alias("m")).select("m.*")
    side = lambda levels, s: F.transform(levels, lambda x: F.struct(F.lit(s).alias("side"), F.round(x[0].cast("double") * scale).cast("long").alias("tick"), x[1].cast("double").alias("size")))
    both = F.concat(side(F.coalesce("data.b", F.array().cast("array<array<string>>")), 1), side(F.coalesce("data.a", F.array().cast("array<array<string>>")), -1))
    return m.select("ts", F.coalesce("cts", "ts").alias("cts"), "data.u", "data.seq", (F.col("type") == "snapshot").cast("int").alias("snap"), F.inline(both))


def typed_trades(raw: DataFrame, scale: float = 10.0) -> DataFrame:
    """Seconds to ms, Buy and Sell to 1 and -1, price to tick; an rpi column is optional."""
    rpi = F.col("rpi").cast("int") if "rpi" in raw.columns else F.lit(None).cast("int")
    side = F.when(F.col("side") == "Buy", 1).when(F.col("side") == "Sell", -1)
    return raw.select(F.round(F.col("timestamp").cast("double") * 1000).cast("long").alias("ts"), side.alias("side"), F.round(F.col("price").cast("double") * scale).cast("long").alias("tick"), F.col("size").cast("double").alias("size"), "id", rpi.alias("rpi"))


def resolve(clean: DataFrame, raw: DataFrame, part: str) -> DataFrame:
    """Clean rows where a part has been cleaned, raw rows of the other parts."""
    return clean.unionByName(raw.join(clean.select(part).distinct(), part, "left_anti"))


def vintages(sheet: DataFrame, month: str, day: int = 16) -> DataFrame:
    """(month, available, value): every column but the first is a vintage 'yyMmm' that may be used from that day of its month."""
    columns = [c for c in sheet.columns if c != month]
    long = sheet.unpivot(month, columns, "vintage", "value").where("value IS NOT NULL")
    year = F.substring_index("vintage", "M", 1).cast("int")
    full = F.when(year >= 50, 1900 + year).otherwise(2000 + year)
    return long.select(F.col(month).alias("month"), F.make_date(full, F.substring_index("vintage", "M", -1).cast("int"), F.lit(day)).alias("available"), F.col("value").cast("double").alias("value"))


def load_parts(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a pattern, whatever columns each has."""
    return spark.read.option("mergeSchema", True).parquet(pattern)


def window_read(spark: SparkSession, path: str, start: int, end: int, column: str = "cts") -> DataFrame:
    """Rows with start <= column < end. Files are sorted by the column, so Parquet's statistics skip the other row groups."""
    return spark.read.parquet(path).where((F.col(column) >= start) & (F.col(column) < end))


def write_parts(df: DataFrame, path: str, parts: list[str], sort: str, kind: str = "parquet") -> None:
    """Sorted files by part. Parts are dealt with a salt of the sort column, so one large part is many files."""
    df.repartition(*parts, F.pmod(F.xxhash64(sort), F.lit(16))).sortWithinPartitions(*parts, sort).write.mode("overwrite").partitionBy(*parts).format(kind).save(path)


def top_up(saved: DataFrame, fresh: DataFrame, now_ms: int, step: int = 60_000) -> DataFrame:
    """Saved and fresh bars, fresh ones first where both have a time, without the bar still running."""
    both = saved.withColumn("__k", F.lit(0)).unionByName(fresh.withColumn("__k", F.lit(1)))
    return latest(both, ["ts"], ["__k"]).drop("__k").where(F.col("ts") < now_ms // step * step)


def scrub(text: Column, secrets: list[str]) -> Column:
    """Text without the given secrets and without any signature value."""
    for s in secrets:
        text = F.replace(text, F.lit(s), F.lit("***"))
    return F.regexp_replace(text, r"signature=[^&\s\"]+", "signature=***")


def migrate(spark: SparkSession, steps: list[tuple[int, str]], version_path: str) -> list[int]:
    """Run each numbered statement once; the numbers that ran are kept in a table at ``version_path``."""
    done = {r.version for r in spark.read.parquet(version_path).collect()} if exists(spark, version_path) else set()  # one row a step
    ran = []
    for number, statement in sorted(steps):
        if number not in done:
            spark.sql(statement)
            spark.createDataFrame([(number,)], "version int").write.mode("append").parquet(version_path)
            ran.append(number)
    return ran
