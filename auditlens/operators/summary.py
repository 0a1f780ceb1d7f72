"""Per-field label summaries, overall accuracies and verdict counts.

A summary counts rows per (field, distinct raw text) first - a hash aggregate
that combines map-side, so each task ships one row per distinct label text -
then normalises only those distinct texts and sums per field (12 rows). A scan
of any size therefore shuffles a handful of tiny rows, and no label rule runs
per input row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.labels import badge_from_upper, label_from_badge
from auditlens.functions.text import py_strip
from auditlens.sources.columns import find_verdict_column

SUMMARY_COLUMNS = ["field_pos", "field_name", "cumulative_correct", "correct", "correct_nd",
                   "inferred", "missing", "incorrect", "hallucination", "total_calls",
                   "n_defaulted", "average"]


#: Column of ``read_audits``: which canonical names the row's own file has a column for.
HAS = "_has"


def verdict_filter(df: DataFrame, verdict_col: str | None = None) -> DataFrame:
    """Keep rows whose verdict is yes/no (any case, stripped); no verdict column, in the table or in the
    row's own file -> no filter."""
    verdict_col = verdict_col or find_verdict_column(df.columns)
    if verdict_col is None:
        return df
    keep = F.lower(py_strip(F.col(verdict_col))).isin("yes", "no")
    return df.filter(keep | ~F.col(HAS)["verdict"]) if HAS in df.columns else df.filter(keep)


def field_summary(df: DataFrame, mapping: dict, unknown_label: str | None = K.CORRECT) -> DataFrame:
    """Label counts per field: one row per field in display order.

    Plan: the mapped columns are unpivoted to (field_pos, raw text) and counted
    per distinct text first - a hash aggregate that combines map-side, so hot
    values cost nothing extra - and only the distinct texts are normalised.
    Labels are categorical, so this turns millions of regex-free-but-wide label
    evaluations into a handful per task; it stays exact for any input.
    A field without a mapped column, in the table or in the row's own file, reports zero rows.
    """
    mapped = [(i + 1, mapping[f]) for i, f in enumerate(K.FIELDS)
              if mapping.get(f) is not None and mapping[f] in df.columns]
    spark = df.sparkSession
    zeros = spark.createDataFrame([(i + 1, None, 0) for i in range(len(K.FIELDS))],
                                  "field_pos int, raw string, n long")
    if mapped:
        has = [[F.col(HAS)[K.FIELDS[pos - 1]].alias("has")] if HAS in df.columns else [] for pos, _ in mapped]
        pairs = F.array(*[F.struct(F.lit(pos).alias("field_pos"), F.col(src).cast("string").alias("raw"), *h)
                          for (pos, src), h in zip(mapped, has)])
        texts = df.select(F.inline(pairs))
        counted = ((texts.filter("has") if HAS in df.columns else texts).groupBy("field_pos", "raw")
                   .agg(F.count(F.lit(1)).alias("n")))
    else:
        counted = zeros.limit(0)
    s = py_strip(F.col("raw"))
    stripped = counted.select("field_pos", "n", s.alias("_s"), F.upper(s).alias("_u"))
    blank = F.col("_s").isNull() | F.lower(F.col("_s")).isin(K.NULLS_AUDIT)
    b = badge_from_upper("_u")
    labelled = stripped.select("field_pos", "n", label_from_badge(blank, b, unknown_label).alias("label"),
                               (~blank & b.isNull()).alias("dflt"))
    sums = [F.sum(F.when(F.col("label") == F.lit(label), F.col("n")).otherwise(F.lit(0))).alias(short)
            for short, label in K.SUMMARY_LABEL_COLUMNS]
    sums.append(F.sum(F.when(F.col("dflt"), F.col("n")).otherwise(F.lit(0))).alias("n_defaulted"))
    per_field = (labelled.unionByName(zeros.select("field_pos", "n", F.lit(None).cast("string").alias("label"),
                                                   F.lit(False).alias("dflt")))
                 .groupBy("field_pos").agg(*sums))
    names = F.element_at(F.array(*[F.lit(K.FIELD_DISPLAY[f]) for f in K.FIELDS]), F.col("field_pos"))
    return with_average(per_field.withColumn("field_name", names))


def with_average(counts: DataFrame) -> DataFrame:
    """Label counts per field with their sums and the share of correct ones."""
    cum = F.col("correct") + F.col("correct_nd") + F.col("inferred")
    total = cum + F.col("missing") + F.col("incorrect") + F.col("hallucination")
    return (counts.withColumn("cumulative_correct", cum)
            .withColumn("total_calls", total)
            .withColumn("average", F.when(total > 0, cum / total).otherwise(F.lit(0.0)))
            .select(*SUMMARY_COLUMNS))


def overall_accuracy(summary: DataFrame) -> DataFrame:
    """Micro accuracy over all fields of one summary."""
    return summary.agg(
        F.sum("cumulative_correct").cast("long").alias("total_correct"),
        F.sum("total_calls").cast("long").alias("total_calls_fields"),
    ).withColumn(
        "overall_accuracy",
        F.when(F.col("total_calls_fields") > 0,
               F.col("total_correct") / F.col("total_calls_fields")).otherwise(F.lit(0.0)))


def with_overall_line(overall: DataFrame) -> DataFrame:
    """``overall`` with the human-readable line that closes a summary table (an empty one has zeros)."""
    correct, total = (F.coalesce(F.col(c), F.lit(0)) for c in ("total_correct", "total_calls_fields"))
    return overall.withColumn("overall_line", F.format_string(
        "Total correct = %d Total calls fields = %d , overall accuracy = %d/%d", correct, total, correct, total))


def overall_label(overall: DataFrame) -> DataFrame:
    """The closing line alone."""
    return with_overall_line(overall).select("overall_line")


def verdict_counts(df: DataFrame, verdict_col: str | None = None) -> DataFrame:
    """Total rows, yes and no counts, yes/total; zeros when no verdict column exists."""
    verdict_col = verdict_col or find_verdict_column(df.columns)
    if verdict_col is None:
        yes = F.lit(0).cast("long")
        no = F.lit(0).cast("long")
        out = df.agg(F.count(F.lit(1)).alias("total")).select(
            "total", yes.alias("yes"), no.alias("no"))
    else:
        v = F.lower(py_strip(F.col(verdict_col)))
        out = df.agg(F.count(F.lit(1)).alias("total"),
                     F.count_if(v == "yes").alias("yes"),
                     F.count_if(v == "no").alias("no"))
    return out.withColumn("yes_ratio", F.when(F.col("total") > 0, F.col("yes") / F.col("total"))
                          .otherwise(F.lit(0.0)))


def fieldwise_comparison(ai_summary: DataFrame, manual_summary: DataFrame) -> DataFrame:
    """Side-by-side AI vs manual cumulative accuracy per field (12 rows, joined on position)."""
    a = ai_summary.select("field_pos", "field_name",
                          F.col("cumulative_correct").alias("ai_cc"), F.col("total_calls").alias("ai_total"))
    m = manual_summary.select("field_pos", F.col("cumulative_correct").alias("man_cc"),
                              F.col("total_calls").alias("man_total"))
    j = F.broadcast(a).join(F.broadcast(m), "field_pos")  # 12 rows each: fixed size
    return j.select(
        "field_pos", "field_name",
        F.concat_ws("/", F.col("ai_cc").cast("string"), F.col("ai_total").cast("string")).alias("ai_fraction"),
        F.when(F.col("ai_total") > 0, F.col("ai_cc") / F.col("ai_total")).otherwise(F.lit(0.0)).alias("ai_ratio"),
        F.concat_ws("/", F.col("man_cc").cast("string"), F.col("man_total").cast("string")).alias("manual_fraction"),
        F.when(F.col("man_total") > 0, F.col("man_cc") / F.col("man_total")).otherwise(F.lit(0.0)).alias("manual_ratio"),
    )
