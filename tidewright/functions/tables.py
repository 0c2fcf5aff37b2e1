"""Functions for SQL that are written in Python: a table function over partitions of its argument, and an aggregate, both in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


class Streaks:
    """``streaks(TABLE(t) PARTITION BY (k) ORDER BY (d), 'k', 'd', 'x')``: each run of steps of ``x`` with one sign, in order of the rows, as (k, from, to, sign, steps, change).

    The text arguments name the columns; k, from and to have their types. A step to an equal or null value ends a run, and a run holds no such step.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or None in (key.value, order.value, value.value):
            raise ValueError("streaks needs a table and the names of its key, order and value columns")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        for name in (key.value, order.value, value.value):
            if name not in kinds:
                raise ValueError(f"no column {name}")
        kind = kinds[order.value]
        return AnalyzeResult(StructType([StructField(key.value, kinds[key.value]), StructField("from", kind), StructField("to", kind), StructField("sign", LongType()), StructField("steps", LongType()), StructField("change", DoubleType())]))

    def __init__(self) -> None:
        self.last = self.start = self.key = None
        self.sign, self.steps, self.change = 0, 0, 0.0

    def _run(self) -> Iterator[tuple]:
        if self.steps:
            yield self.key, self.start, self.last[0], self.sign, self.steps, self.change
        self.start, self.sign, self.steps, self.change = None, 0, 0, 0.0

    def eval(self, row, key: str, order: str, value: str) -> Iterator[tuple]:
        self.key, at, x = row[key], row[order], row[value]
        step = None if self.last is None or x is None or self.last[1] is None else float(x) - float(self.last[1])
        sign = 0 if not step else 1 if step > 0 else -1
        if sign != self.sign or not sign:
            yield from self._run()
        if sign:
            if not self.steps:
                self.start, self.sign = self.last[0], sign
            self.steps, self.change = self.steps + 1, self.change + step
        self.last = (at, x)

    def terminate(self) -> Iterator[tuple]:
        yield from self._run()


def _weighted_median(x: pa.Array, w: pa.Array) -> float:
    x, w = (np.asarray(a.to_numpy(zero_copy_only=False), float) for a in (x, w))
    ok = np.isfinite(x) & np.isfinite(w) & (w > 0)
    x, w = x[ok], w[ok]
    if not len(x):
        return None
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(w[order])
    return float(x[order][np.searchsorted(upto, upto[-1] / 2)])


def register(spark: SparkSession) -> None:
    """Registers ``streaks`` and ``weighted_median(value, weight)``, the least value up to which half of the weights lie, for SQL. A group of the aggregate is held by one task."""
    spark.udtf.register("streaks", udtf(Streaks))

    @arrow_udf("double")
    def weighted_median(x: pa.Array, w: pa.Array) -> float:
        return _weighted_median(x, w)

    spark.udf.register("weighted_median", weighted_median)
