"""Consecutive numbers for all rows of a table, without a window over the whole table.

The rows are range-partitioned by the order columns and sorted inside each partition; a row's number is
its position there plus the sizes of the partitions before it. Only that prefix sum, a table of one row per
partition, is ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ``monotonically_increasing_id`` keeps the partition above this bit and the position below it.
_POSITION_BITS = 33


def dense_numbers(df: DataFrame, order: Sequence[str | Column], path: str, out: str = "row_id", start: int = 0) -> DataFrame:
    """``df`` with column ``out``: start, start + 1, ... by ``order``.

    The sorted rows are written to ``path`` (a new folder in a shared place): range bounds are sampled, so the
    written table is what fixes which row has which position, also after a lost executor. Rows that tie in ``order``
    are numbered in any sequence and all lie in one partition; end ``order`` with a unique column.
    """
    at, part, n = (_free(df, c) for c in ("at", "part", "n"))
    (df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
     .write.parquet(path))
    rows = df.sparkSession.read.parquet(path)
    place = F.shiftright(F.col(at), _POSITION_BITS)
    sizes = rows.groupBy(place.alias(part)).agg(F.count("*").alias(n))
    # one row per written partition
    before = F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(part, F.coalesce(before, F.lit(0)).alias(n))
    position = F.col(at).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (rows.join(F.broadcast(offsets), place == F.col(part))
            .select(*[F.col(f"`{c}`") for c in df.columns], (position + F.col(n) + start).alias(out)))


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"
