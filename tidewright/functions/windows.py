"""Window expressions shared by the operators. Every frame of n rows is null until it holds n values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_asset(key: str = "asset", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def by_date(key: str = "date") -> WindowSpec:
    return Window.partitionBy(key)


def trailing(w: WindowSpec, n: int, lag: int = 0) -> WindowSpec:
    """The n rows that end ``lag`` rows ago."""
    return w.rowsBetween(-(n - 1) - lag, -lag)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def warm(value: Column, x: Column, frame: WindowSpec, n: int) -> Column:
    """``value`` where the frame holds n non-null x."""
    return F.when(F.count(x).over(frame) >= n, value)


def rolling(f, x: Column, w: WindowSpec, n: int, lag: int = 0, least: int | None = None) -> Column:
    """``f(x)`` over n rows, null below ``least`` values (n by default)."""
    frame = trailing(w, n, lag)
    return warm(f(x).over(frame), x, frame, n if least is None else least)


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0.0))


def r6(x: Column) -> Column:
    """Rounded to six decimals the same way in Spark and DuckDB."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def r6_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def rounded(df: DataFrame) -> DataFrame:
    """All double columns by :func:`r6`."""
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
