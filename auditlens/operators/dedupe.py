"""Order-aware de-duplication: first / last row per key by an explicit sequence.

Implemented as ``min_by`` / ``max_by`` aggregates, not a window: the aggregate
combines map-side, so a key holding a third of all rows still leaves each map
task with ONE row for it, and the shuffle carries no hot partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seq(seq) -> Column:
    if isinstance(seq, (list, tuple)):
        return F.struct(*[F.col(s) if isinstance(s, str) else s for s in seq])
    return F.col(seq) if isinstance(seq, str) else seq


def _pick(df: DataFrame, keys: Sequence[str], seq, agg) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    others = [c for c in df.columns if c not in keys]
    # wrap in a struct so NULL values of the chosen row survive
    row = F.struct(*[F.col(c) for c in others])
    picked = df.groupBy(*keys).agg(agg(row, _seq(seq)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def first_per_key(df: DataFrame, keys, seq) -> DataFrame:
    """Keep the row with the smallest ``seq`` per key (``drop_duplicates(keep='first')``)."""
    return _pick(df, keys, seq, F.min_by)


def last_per_key(df: DataFrame, keys, seq) -> DataFrame:
    """Keep the row with the largest ``seq`` per key (later rows overwrite earlier ones)."""
    return _pick(df, keys, seq, F.max_by)


def duplicate_count(df: DataFrame, keys) -> DataFrame:
    """Rows beyond the first per key: ``count(*) - count(distinct key)``.

    The distinct count is a two-level aggregate (group by key, then count),
    which also combines map-side under a hot key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").cast("long").alias("rows"),
                       F.count(F.lit(1)).alias("distinct_keys")).select(
        "rows", "distinct_keys", (F.col("rows") - F.col("distinct_keys")).alias("duplicates"))
