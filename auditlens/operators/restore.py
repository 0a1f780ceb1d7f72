"""Restore missing record ids from (seller, caller) pairs unique in a source of truth.

Plan shape at scale:
* the lookup is ONE aggregate over the truth table grouped by the pair
  (count + min id, keep count == 1) - no self join; it combines map-side;
* only rows that need repair AND carry both keys take part in the join, so
  the rows with an id, and rows whose blank key would form a hot join key,
  never shuffle for it; they pass by in one scan, the others come in a second;
* the lookup can be as large as the truth table, so it is not force-broadcast;
  AQE turns the join into a broadcast at run time when the measured side is
  small and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.text import blank_to_null, py_strip

_KEY_S, _KEY_C, _LOOK = "_rk_seller", "_rk_caller", "_rk_id"


def _key(c) -> F.Column:
    return F.coalesce(py_strip(F.col(c)), F.lit(""))


def _complete_pairs(calls: DataFrame, id_col: str, seller_col: str, caller_col: str) -> DataFrame:
    keyed = calls.select(_key(seller_col).alias("seller"), _key(caller_col).alias("caller"),
                         _key(id_col).alias("call_id"))
    return keyed.filter((F.col("seller") != "") & (F.col("caller") != "") & (F.col("call_id") != ""))


def pair_counts(calls: DataFrame, id_col="Call ID", seller_col="Seller GLID", caller_col="Caller GLID") -> DataFrame:
    """Rows per (seller, caller) among complete truth rows."""
    return (_complete_pairs(calls, id_col, seller_col, caller_col)
            .groupBy("seller", "caller").agg(F.count(F.lit(1)).alias("n")))


def unique_pair_lookup(calls: DataFrame, id_col="Call ID", seller_col="Seller GLID",
                       caller_col="Caller GLID") -> DataFrame:
    """(seller, caller) -> id for pairs that occur in exactly one complete truth row.

    Two rows of the same pair stay ambiguous even when they carry the same id.
    """
    return (_complete_pairs(calls, id_col, seller_col, caller_col).groupBy("seller", "caller")
            .agg(F.count(F.lit(1)).alias("n"), F.min("call_id").alias("call_id"))
            .filter(F.col("n") == 1).drop("n"))


def restore_ids(audit: DataFrame, calls: DataFrame, id_col="Call ID", seller_col="Seller GLID",
                caller_col="Caller GLID", missing_tokens=K.NULLS_RESTORE) -> DataFrame:
    """Fill missing ids of ``audit`` from the unique-pair lookup built on ``calls``.

    Present ids never change; a missing id keeps its original text when no
    unique pair exists. Adds boolean ``id_missing`` and ``id_restored``.
    """
    if id_col not in audit.columns:
        audit = audit.withColumn(id_col, F.lit(None).cast("string"))
    cols = audit.columns
    missing = blank_to_null(F.col(id_col), missing_tokens, case_sensitive=True).isNull()
    flagged = audit.withColumn("id_missing", missing)
    repairable = F.col("id_missing") & (_key(seller_col) != "") & (_key(caller_col) != "")
    settled = flagged.filter(~repairable).withColumn("id_restored", F.lit(False))
    keyed = flagged.filter(repairable).withColumn(_KEY_S, _key(seller_col)).withColumn(_KEY_C, _key(caller_col))
    lookup = unique_pair_lookup(calls, id_col, seller_col, caller_col).select(
        F.col("seller").alias(_KEY_S), F.col("caller").alias(_KEY_C), F.col("call_id").alias(_LOOK))
    joined = keyed.join(lookup, [_KEY_S, _KEY_C], "left")
    repaired = (joined
                .withColumn("id_restored", F.col(_LOOK).isNotNull())
                .withColumn(id_col, F.coalesce(F.col(_LOOK), F.col(id_col)))
                .drop(_KEY_S, _KEY_C, _LOOK))
    out_cols = cols + ["id_missing", "id_restored"]
    return settled.select(*out_cols).unionByName(repaired.select(*out_cols))


def restore_counters(restored: DataFrame) -> DataFrame:
    """total rows, missing before, restored, still missing - as (metric, value)."""
    agg = restored.agg(F.count(F.lit(1)).alias("total_rows"),
                       F.count_if("id_missing").alias("missing_before"),
                       F.count_if("id_restored").alias("restored"))
    agg = agg.withColumn("still_missing", F.col("missing_before") - F.col("restored"))
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("total_rows", "missing_before", "restored", "still_missing")])))
