"""Joins that stay even when a few keys hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows. At most 1 / HOT_SHARE keys can be, whatever the data: the size bound of the broadcast.
HOT_SHARE = 1 / 512


def split_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right`` (one row a key; ``count`` is the number of left rows of that key).

    Keys with at least ``HOT_SHARE`` of the ``total`` left rows number 512 at most, so these rows of ``right`` are broadcast
    and the left rows of hot keys never move. All other keys go through an ordinary shuffle join, in which none is large.
    Null keys match nothing. ``right`` should be cheap to read twice.
    """
    bound = max(2, int(total * HOT_SHARE))
    hot = right.where(F.col(count) >= bound)
    cold = right.where(F.col(count) < bound)
    by_hot = left.join(F.broadcast(hot), keys, "inner")
    by_cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "inner")
    return by_hot.unionByName(by_cold)
