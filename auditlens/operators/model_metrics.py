"""The per-model metrics table: numbered result rows, then nine summary lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.operators.numbering import dense_numbers
from auditlens.operators.quantile import exact_percentile

VALUES = ("prompt_tokens", "completion_tokens", "total_tokens", "cost", "latency")
#: (label, column, aggregate), in line order.
SUMMARY_LINES = [
    ("Average Prompt Tokens", "prompt_tokens", "avg"), ("Average Completion Tokens", "completion_tokens", "avg"),
    ("Average Total Tokens", "total_tokens", "avg"), ("Average Estimated Cost", "cost", "avg"),
    ("Average Latency", "latency", "avg"), ("P95 Latency", "latency", "p95"), ("Maximum Latency", "latency", "max"),
    ("Minimum Latency", "latency", "min"), ("Standard Deviation Latency", "latency", "stddev"),
]
_AGGREGATES = {"avg": F.avg, "stddev": F.stddev_samp, "max": lambda c: F.coalesce(F.max(c), F.lit(0.0)), "min": lambda c: F.coalesce(F.min(c), F.lit(0.0))}


def model_metrics(results: DataFrame, path: str, models: Sequence[str] | None = None, key: str = "row_id") -> DataFrame:
    """(model, sheet_row, label, prompt_tokens, completion_tokens, total_tokens, cost, latency).

    A model's results come first, labelled 1, 2, ... in input order and standing in rows 2, 3, ...; one row stays blank, then
    nine lines each give one statistic in the column that it is about. NULL cells do not count. Over no cells, maximum and
    minimum are 0 and the others NULL (so is the deviation of one). ``models``: these have their lines even without
    results. ``path``: a new folder for the sorted results.
    """
    cells = results.select("model", key, *[F.col(c).cast("double").alias(c) for c in VALUES])
    numbered = dense_numbers(cells, ["model", key], path, "_n")
    # one row per model from here on
    heads = numbered.groupBy("model").agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"), *[
        _AGGREGATES[how](c).alias(f"{c}_{how}") for _, c, how in SUMMARY_LINES if how != "p95"])
    heads = heads.join(exact_percentile(cells, ["model"], "latency", 0.95, out="latency_p95"), "model", "left")
    if models is not None:
        heads = results.sparkSession.createDataFrame([(m,) for m in models], "model string").join(heads, "model", "left")
        heads = heads.fillna(0, ["_rows", "latency_max", "latency_min"])
    rows = numbered.join(heads.select("model", "_first"), "model").withColumn("_line", F.col("_n") - F.col("_first") + 1)
    body = rows.select("model", (F.col("_line") + 1).alias("sheet_row"), F.col("_line").cast("string").alias("label"), *VALUES)
    lines = [F.struct((F.col("_rows") + 3 + i).alias("sheet_row"), F.lit(label).alias("label"),
                      *[(F.col(f"{c}_{how}") if c == v else F.lit(None)).cast("double").alias(v) for v in VALUES])
             for i, (label, c, how) in enumerate(SUMMARY_LINES)]
    return body.unionByName(heads.select("model", F.inline(F.array(*lines))))
