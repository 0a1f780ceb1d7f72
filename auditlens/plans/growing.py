"""Queries over tables that grow, groups without a bound, and numbered rows. ``*_sql`` spell the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.operators import fanout as FO
from auditlens.operators.model_metrics import SUMMARY_LINES, VALUES, model_metrics as metrics_table
from auditlens.operators.numbering import dense_numbers
from auditlens.operators.ordered_text import ordered_text
from auditlens.plans import driver_tables as D
from auditlens.plans import oracle as O
from auditlens.plans.incremental_audit import IncrementalAudit
from auditlens.plans.intake import scratch


def _appended(spark: SparkSession, sf_dir: str) -> IncrementalAudit:
    """The derived audits in three batches: manual ones by line number (a call's later lines audit it again), AI ones by id."""
    report = IncrementalAudit(spark, scratch(spark, "incremental"))
    manual, ai = D.manual_audits(spark, sf_dir), D.ai_audits(spark, sf_dir)
    line = F.col("_seq.line")
    for k, lines in enumerate((line <= 2, (line > 2) & (line <= 4), line > 4)):
        report.append(manual.filter(lines), ai.filter(F.col("_seq") % 3 == k))
    report.compact()
    return report


def incremental_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary statistics after three batches, kept up to date with retractions."""
    return _appended(spark, sf_dir).statistics()


def incremental_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual label summary after three batches."""
    return _appended(spark, sf_dir).summary("manual")


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer of every model, numbered in input order, and nine summary lines per model, one of which never answers."""
    results = FO.with_cost(D.response_log(spark, sf_dir), FO.model_dimension(spark, D.DEFAULT_MODELS))
    out = metrics_table(results, scratch(spark, "metrics"), [*D.MODEL_IDS, D.ABSENT_MODEL])
    return out.select("model", "sheet_row", "label", *[F.round(c, 9).alias(c) for c in VALUES])


def input_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive row ids of all line items, by order, line, part and supplier."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return dense_numbers(D.read(spark, sf_dir, "lineitem").select(*keys), keys, scratch(spark, "numbers"))


def transcript_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one text, a line per turn."""
    turns = D.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("line"))
    return ordered_text(turns, ["conv_id"], ["turn"], "line", "\n", scratch(spark, "turns"), "transcript")


def model_metrics_sql() -> str:
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in VALUES)
    base = (f"WITH {O.responses()}, cells AS (SELECT model, row_id, {cols} FROM rc), "
            "n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY row_id) AS line FROM cells), "
            f"m AS (SELECT unnest({O.sql_list([*D.MODEL_IDS, D.ABSENT_MODEL])}) AS model), "
            "a AS (SELECT m.model, count(cells.row_id) AS rows, avg(prompt_tokens) AS prompt_tokens_avg, avg(completion_tokens) AS completion_tokens_avg, "
            "avg(total_tokens) AS total_tokens_avg, avg(cost) AS cost_avg, avg(latency) AS latency_avg, quantile_cont(latency, 0.95) AS latency_p95, "
            "coalesce(max(latency), 0.0) AS latency_max, coalesce(min(latency), 0.0) AS latency_min, stddev_samp(latency) AS latency_stddev "
            "FROM m LEFT JOIN cells USING (model) GROUP BY m.model) ")
    rounded = ", ".join(f"round({c}, 9) AS {c}" for c in VALUES)
    parts = [f"SELECT model, line + 1 AS sheet_row, CAST(line AS VARCHAR) AS label, {rounded} FROM n"]
    for i, (label, c, how) in enumerate(SUMMARY_LINES):
        values = ", ".join(f"round({c}_{how}, 9) AS {v}" if v == c else f"CAST(NULL AS DOUBLE) AS {v}" for v in VALUES)
        parts.append(f"SELECT model, rows + {3 + i} AS sheet_row, {O.q(label)} AS label, {values} FROM a")
    return base + " UNION ALL ".join(parts)


def input_numbers_sql() -> str:
    keys = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    return f"SELECT {keys}, row_number() OVER (ORDER BY {keys}) - 1 AS row_id FROM lineitem"


def transcript_build_sql() -> str:
    return ("SELECT conv_id, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")


QUERIES = {f.__name__: f for f in (incremental_statistics, incremental_summary, model_metrics, input_numbers, transcript_build)}
ORACLE = {"incremental_statistics": O.summary_statistics_sql, "incremental_summary": lambda: O.summary_sql("manual"),
          "model_metrics": model_metrics_sql, "input_numbers": input_numbers_sql, "transcript_build": transcript_build_sql}
