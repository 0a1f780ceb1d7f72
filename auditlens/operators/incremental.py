"""Content-hash incremental processing: skip inputs whose bytes were already processed.

The known-results table is keyed by the SHA-256 of the content; new inputs
are found with a ``left_anti`` join on the hash, so neither side is ever
collected, and the result is appended to the results table by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_content_hash(df: DataFrame, content_col: str, out: str = "content_hash") -> DataFrame:
    """Hex SHA-256 of a binary or string column (strings hash their UTF-8 bytes)."""
    return df.withColumn(out, F.sha2(F.col(content_col), 256))


def new_only(df: DataFrame, known: DataFrame, hash_col: str = "content_hash",
             force_refresh: bool = False) -> DataFrame:
    """Rows of ``df`` whose hash is not in ``known``; everything when ``force_refresh``."""
    if force_refresh:
        return df
    return df.join(known.select(hash_col), hash_col, "left_anti")


def merge_results(previous: DataFrame, fresh: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """Cached results plus new ones; a refreshed hash replaces its cached row."""
    kept = previous.join(fresh.select(hash_col), hash_col, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
