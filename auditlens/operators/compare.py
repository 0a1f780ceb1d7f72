"""Paired manual-vs-AI comparison keyed by call id.

Plan shape: each side is reduced to its last row per call id with a
``max_by`` aggregate (map-side combine, so a hot id costs one row per task),
both results come out hash-partitioned on ``call_id`` and the inner join
re-uses that partitioning (no extra exchange). All per-field logic is plain
column expressions inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.labels import badge_from_upper, label_from_badge
from auditlens.functions.text import blank_to_null_named, call_id_before_dot, py_strip
from auditlens.operators.dedupe import last_per_key

N_FIELDS = len(K.FIELDS)


def audit_rows(df: DataFrame, mapping: dict, seq_col: str, with_auditor: bool = False) -> DataFrame:
    """Canonical audit rows: call_id (normalised), blank-nulled raw field text, sequence."""
    cols = [call_id_before_dot(F.col(mapping["call_id"])).alias("call_id")]
    if with_auditor:
        aud = mapping.get("auditor")
        a = py_strip(F.col(aud)) if aud else F.lit(None).cast("string")
        cols.append(F.coalesce(a, F.lit(K.DEFAULT_AUDITOR)).alias("auditor"))
    for f in K.FIELDS:
        src = mapping.get(f)
        raw = blank_to_null_named(src, K.NULLS_AUDIT) if src else F.lit(None).cast("string")
        cols.append(raw.alias(f))
    cols.append(F.col(seq_col).alias("_seq"))
    return df.select(*cols)


def latest_calls(rows: DataFrame) -> DataFrame:
    """Last row wins per call id (later rows overwrite earlier ones)."""
    return last_per_key(rows, "call_id", "_seq").drop("_seq")


def compare_calls(manual_rows: DataFrame, ai_rows: DataFrame, blank_policy: str = "match",
                  unknown_label: str | None = K.CORRECT, single: bool = False) -> DataFrame:
    """One row per call id present on both sides. ``single``: the rows are one per call and side already.

    Per field ``f``: ``f_manual``, ``f_ai`` (normalised labels), ``f_match`` (0/1)
    and ``f_imputed`` (manual was blank). ``blank_policy='match'`` copies the AI
    label into a blank manual value and counts it as a match;
    ``'exclude'`` leaves it NULL (not compared). With ``unknown_label=None`` a
    label that no rule knows, on either side, is not compared either.
    """
    if blank_policy not in ("match", "exclude"):
        raise ValueError("blank_policy must be 'match' or 'exclude'")
    # label each side right after its dedupe (one row per call): two 12-label
    # projections instead of one 24-label one keep generated methods small
    def labelled_side(rows, prefix, extra):
        latest = rows if single else latest_calls(rows)
        up = latest.select("call_id", *extra, *[F.upper(F.col(f)).alias(f"{f}__u") for f in K.FIELDS])
        names = ["manual_auditor"] if prefix == "m" else []
        return up.select("call_id", *names, *[c for f in K.FIELDS for c in (
            label_from_badge(F.col(f"{f}__u").isNull(), badge_from_upper(f"{f}__u"), unknown_label)
            .alias(f"{f}__{prefix}"),
            *([F.col(f"{f}__u").isNull().alias(f"{f}__blank")] if prefix == "m" else []))])
    m = labelled_side(manual_rows, "m", [F.col("auditor").alias("manual_auditor")])
    a = labelled_side(ai_rows, "a", [])
    labelled = m.join(a, "call_id", "inner")
    # the per-field projection as SQL text: one JVM call instead of ~200
    fam = ", ".join("'" + x.lower() + "'" for x in K.CORRECT_FAMILY)

    def cls(col):
        return f"(CASE WHEN lower({col}) IN ({fam}) THEN 'ok' ELSE lower({col}) END)"
    exprs = ["call_id", "manual_auditor"]
    match_cols = []
    for f in K.FIELDS:
        b, m_, a_ = f"`{f}__blank`", f"`{f}__m`", f"`{f}__a`"
        # a label that no rule knows (unknown_label=None) is NULL: not compared
        same = f"CASE WHEN {m_} IS NOT NULL AND {a_} IS NOT NULL THEN CAST({cls(m_)} = {cls(a_)} AS INT) END"
        if blank_policy == "match":
            exprs += [f"CASE WHEN {b} THEN {a_} ELSE {m_} END AS `{f}_manual`",
                      f"CASE WHEN {b} {'' if unknown_label else f'AND {a_} IS NOT NULL '}THEN 1 ELSE {same} END AS `{f}_match`"]
        else:
            exprs += [f"CASE WHEN {b} THEN CAST(NULL AS STRING) ELSE {m_} END AS `{f}_manual`",
                      f"CASE WHEN {b} THEN CAST(NULL AS INT) ELSE {same} END AS `{f}_match`"]
        exprs += [f"{a_} AS `{f}_ai`", f"CAST({b} AS INT) AS `{f}_imputed`"]
        match_cols.append(f"{f}_match")
    order = ["call_id", "manual_auditor"] + [c for f in K.FIELDS
                                              for c in (f"{f}_manual", f"{f}_ai", f"{f}_match", f"{f}_imputed")]
    res = labelled.selectExpr(*exprs).select(*order)
    total = sum(F.coalesce(F.col(c), F.lit(0)) for c in match_cols)
    compared = sum(F.col(c).isNotNull().cast("int") for c in match_cols)
    fields = compared if blank_policy == "exclude" or unknown_label is None else F.lit(N_FIELDS)
    # one projection (each withColumn would re-analyse the wide plan)
    res = res.select("*", total.alias("matches"), fields.alias("total_fields"))
    acc = F.when(F.col("total_fields") > 0, F.col("matches") / F.col("total_fields") * 100.0).otherwise(F.lit(0.0))
    return res.select("*", acc.alias("accuracy"))


def binary_comparison(cmp: DataFrame) -> DataFrame:
    """Per call: 0/1 per field, matches, total and accuracy rounded to 2 places as reported."""
    return cmp.select("call_id", "manual_auditor", *[F.col(f"{f}_match").alias(f) for f in K.FIELDS],
                      "matches", "total_fields", F.round("accuracy", 2).alias("accuracy"))


def value_comparison(cmp: DataFrame) -> DataFrame:
    cols = ["call_id"]
    for f in K.FIELDS:
        cols += [f"{f}_manual", f"{f}_ai"]
    return cmp.select(*cols)


def band(acc) -> F.Column:
    """Report colour band of an accuracy in percent (a value in (89.9, 90) has none)."""
    return (F.when(acc >= K.BAND_GREEN_MIN, F.lit("green"))
            .when((acc >= K.BAND_YELLOW_MIN) & (acc <= K.BAND_YELLOW_MAX), F.lit("yellow"))
            .when(acc < K.BAND_YELLOW_MIN, F.lit("red")))


def statistics_counts(cmp: DataFrame) -> DataFrame:
    """Per field: label counts of the (imputed) manual values, matched, compared, imputed and all calls.

    One global aggregate over the comparison, unpacked to 12 rows. The counts of separate sets of calls add up.
    """
    # ~110 aggregates and a 12-row unpivot: each sent as one SQL expression
    def q(v):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    aggs = [F.expr("count(1)").alias("n_calls")]
    for f in K.FIELDS:
        for short, label in K.SUMMARY_LABEL_COLUMNS:
            aggs.append(F.expr(f"count_if(`{f}_manual` = {q(label)})").alias(f"{f}__{short}"))
        aggs.append(F.expr(f"CAST(coalesce(sum(`{f}_match`), 0) AS BIGINT)").alias(f"{f}__matched"))
        aggs.append(F.expr(f"count(`{f}_match`)").alias(f"{f}__compared"))
        aggs.append(F.expr(f"CAST(coalesce(sum(`{f}_imputed`), 0) AS BIGINT)").alias(f"{f}__imputed"))
    wide = cmp.agg(*aggs)
    structs = []
    for i, f in enumerate(K.FIELDS):
        parts = [f"'field_pos', {i + 1}", f"'field_name', {q(K.FIELD_DISPLAY[f])}"]
        parts += [f"'{short}', `{f}__{short}`" for short, _ in K.SUMMARY_LABEL_COLUMNS]
        parts += [f"'matched_calls', `{f}__matched`", f"'compared_calls', `{f}__compared`",
                  f"'n_imputed', `{f}__imputed`", "'total_calls', n_calls"]
        structs.append("named_struct(" + ", ".join(parts) + ")")
    return wide.select(F.expr("inline(array(" + ", ".join(structs) + "))"))


def with_rates(counts: DataFrame) -> DataFrame:
    """``statistics_counts`` with cumulative_correct, accuracy and its band."""
    acc = F.when(F.col("compared_calls") > 0, F.col("matched_calls") / F.col("compared_calls") * 100.0) \
        .otherwise(F.lit(0.0))
    return (counts.withColumn("cumulative_correct", F.col("correct") + F.col("correct_nd") + F.col("inferred"))
            .withColumn("accuracy", acc)
            .withColumn("band", band(F.col("accuracy"))))


def summary_statistics(cmp: DataFrame) -> DataFrame:
    """Per field: label counts of the (imputed) manual values, matched calls, accuracy, band."""
    return with_rates(statistics_counts(cmp))


def comparison_totals(cmp: DataFrame) -> DataFrame:
    """Matched calls, total and matched fields, micro accuracy (percent)."""
    out = cmp.agg(F.count(F.lit(1)).alias("matched_calls"),
                  F.coalesce(F.sum("total_fields"), F.lit(0)).cast("long").alias("total_fields"),
                  F.coalesce(F.sum("matches"), F.lit(0)).cast("long").alias("matched_fields"))
    return out.withColumn("accuracy", F.when(F.col("total_fields") > 0,
                                             F.col("matched_fields") / F.col("total_fields") * 100.0)
                          .otherwise(F.lit(0.0)))


def macro_accuracy(stats: DataFrame) -> DataFrame:
    """Unweighted mean of the per-field accuracies."""
    return stats.agg(F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("macro_accuracy"))


def matched_ids_semi(ai_rows_raw: DataFrame, ai_id_col: str, manual_ids: DataFrame) -> DataFrame:
    """All AI rows (not de-duplicated) whose normalised id occurs among the manual ids."""
    keyed = ai_rows_raw.withColumn("_cid", call_id_before_dot(F.col(ai_id_col)))
    return keyed.join(manual_ids.select(F.col("call_id").alias("_cid")).distinct(), "_cid",
                      "left_semi").drop("_cid")
