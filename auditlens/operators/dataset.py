"""Evaluation-dataset build: three sources joined per call id with ordered
fallbacks, a first-failing reject reason per row, and counters.

Plan shape at scale: each source is reduced to ONE row per call id by an
aggregate (first/last row by sequence, plus its row count) - these combine
map-side, so a hot id never concentrates rows; the reduced tables all come
out hash-partitioned on ``call_id`` and are joined with left joins that re-use
that partitioning. Ids without a typed audit row leave by a semi join below those
aggregates. Python sees only call texts that the JVM's JSON parser rejects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions import jsonx as J
from auditlens.functions.text import blank_to_null, blank_to_null_named, clean_id, py_strip
from auditlens.sources.columns import require, resolve_column


#: Per input, the headers that name the same column (files of one folder may use different ones).
_CALLS = [K.CALL_JSON_ALIASES, K.INFERRED_ALIASES]
ALIASES = {
    "calls": [K.ID_ALIASES, *_CALLS],
    "call_jsons": [K.CALL_JSONS_ID_ALIASES, *_CALLS],
    "manual": [K.ID_ALIASES, K.TRANSCRIPT_ALIASES, K.TYPE_ALIASES, K.MANUAL_INFERRED_COLUMNS, *K.EXPECTED_OUTPUT_FIELDS.values()],
}


def _norm(c) -> Column:
    return blank_to_null(c, K.NULLS_DATASET)


def _null() -> Column:
    return F.lit(None).cast("string")


@dataclass
class DatasetSources:
    calls: DataFrame
    manual: DataFrame
    call_jsons: DataFrame
    seq: str = "_seq"


def _with_id(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumn("call_id", clean_id(F.col(id_col))).filter(F.col("call_id").isNotNull())


def _per_id(df: DataFrame, id_col: str, keep: dict, seq: str, last: bool = False, only: DataFrame | None = None) -> DataFrame:
    """One row per cleaned id (of ``only``, if given): the first (or last) row's ``keep`` columns."""
    pick = F.max_by if last else F.min_by
    row = F.struct(*[(F.col(src) if src else _null()).alias(name) for name, src in keep.items()])
    rows = _with_id(df, id_col)
    rows = rows if only is None else rows.join(only, "call_id", "left_semi")
    return (rows.groupBy("call_id").agg(pick(row, F.col(seq)).alias("_r"))
            .select("call_id", *[F.col("_r")[k].alias(k) for k in keep]))


def classify(src: DatasetSources) -> DataFrame:
    """One row per eligible call id with its fields and ``reject_reason`` (NULL = accepted)."""
    calls, manual, cj = src.calls, src.manual, src.call_jsons
    calls_id = require(calls.columns, K.ID_ALIASES, "call id in calls")
    manual_id = require(manual.columns, K.ID_ALIASES, "call id in manual audit")
    cj_id = require(cj.columns, K.CALL_JSONS_ID_ALIASES, "call id in call_jsons")
    transcript = require(manual.columns, K.TRANSCRIPT_ALIASES, "transcript")
    type_col = require(manual.columns, K.TYPE_ALIASES, "type")
    c_json = resolve_column(calls.columns, K.CALL_JSON_ALIASES)
    c_inf = resolve_column(calls.columns, K.INFERRED_ALIASES)
    j_json = resolve_column(cj.columns, K.CALL_JSON_ALIASES)
    j_inf = resolve_column(cj.columns, K.INFERRED_ALIASES)
    # manual row's own inferred details: the first of these columns that exists wins
    m_inf = next((c for c in K.MANUAL_INFERRED_COLUMNS if c in manual.columns), None)
    expected_cols = {key: resolve_column(manual.columns, aliases)
                     for key, aliases in K.EXPECTED_OUTPUT_FIELDS.items()}

    typed = manual.filter(F.lower(py_strip(F.coalesce(F.col(type_col), F.lit("")))) == K.MANUAL_TYPE_VALUE)
    keep = {"m_inf": m_inf}
    keep.update({f"x_{k}": v for k, v in expected_cols.items()})
    m1 = _per_id(typed, manual_id, keep, src.seq)
    # the wide sources are cut down to typed ids before their texts are aggregated
    ids = _with_id(typed, manual_id).select("call_id").distinct()
    c1 = _per_id(calls, calls_id, {"c_json": c_json, "c_inf": c_inf}, src.seq, only=ids)
    j1 = _per_id(cj, cj_id, {"j_json": j_json, "j_inf": j_inf}, src.seq, only=ids)
    # transcript look-up over ALL audit rows of those ids: last non-blank transcript per id
    tr = _per_id(manual.filter(py_strip(F.col(transcript)) != ""), manual_id,
                 {"transcript_raw": transcript}, src.seq, last=True, only=ids)

    j = (m1.join(c1.withColumn("_in_calls", F.lit(True)), "call_id", "left")
         .join(j1.withColumn("_in_cj", F.lit(True)), "call_id", "left")
         .filter(F.col("_in_calls").isNotNull() | F.col("_in_cj").isNotNull())
         .join(tr, "call_id", "left"))

    # every normalised value becomes a column once; later expressions reference it
    keys = list(K.EXPECTED_OUTPUT_FIELDS)
    def nn(name):  # one SQL expression per column (see ``blank_to_null_named``)
        return blank_to_null_named(name, K.NULLS_DATASET)
    j = j.select(
        "call_id",
        nn("transcript_raw").alias("transcript"),
        F.coalesce(nn("j_json"), nn("c_json")).alias("call_json"),
        F.coalesce(nn("c_inf"), nn("j_inf"), nn("m_inf")).alias("_inf0"),
        *[nn(f"x_{k}").alias(f"n_{k}") for k in keys])
    pairs = []
    for key in keys:
        v = F.col(f"n_{key}")
        text = J.score_value(v) if "score" in key else J.json_string(v)
        pairs.append((key, F.when(v.isNotNull(), text)))
    # only rows that still lack inferred details are parsed
    need = F.when(F.col("_inf0").isNull(), F.col("call_json"))
    j = j.withColumn("_call", J.as_variant(need))
    j = j.withColumn("details_note", F.when(F.col("_inf0").isNull(), J.details_problem(F.col("_call"), need)))
    # the fourth reason looks at the values, never at the built text: a filter on it stays small
    no_values = F.coalesce(*[F.col(f"n_{k}") for k in keys]).isNull()
    reason = (F.when(F.col("transcript").isNull(), F.lit(K.REJECT_REASONS[0]))
              .when(F.col("call_json").isNull(), F.lit(K.REJECT_REASONS[1]))
              .when(F.col("_inf0").isNull() & F.col("details_note").isNotNull(), F.lit(K.REJECT_REASONS[2]))
              .when(no_values, F.lit(K.REJECT_REASONS[3])))
    return j.select(
        "call_id", "transcript", "call_json",
        F.coalesce(F.col("_inf0"), J.inferred_details(F.col("_call"), F.col("details_note"))).alias("inferred_details"),
        J.pretty_object(pairs).alias("expected_output"), J.metadata_object(F.col("call_id")).alias("metadata"),
        reason.alias("reject_reason"), "details_note")


def input_text(call_json, inferred, transcript, json_style: str = "pretty") -> Column:
    """Three titled sections: call JSON, inferred details, transcript."""
    fmt = J.pretty_json if json_style == "pretty" else J.compact_json
    parts = [fmt(call_json), fmt(inferred), transcript]
    secs = [F.concat(F.lit(f"{title}\n{K.SECTION_RULE}\n"), F.coalesce(p, F.lit("None")))
            for title, p in zip(K.SECTION_TITLES, parts)]
    return F.concat_ws("\n\n", *secs)


def accepted(classified: DataFrame, json_style: str = "pretty") -> DataFrame:
    ok = classified.filter(F.col("reject_reason").isNull())
    return ok.select("call_id",
                     input_text(F.col("call_json"), F.col("inferred_details"), F.col("transcript"),
                                json_style).alias("input"),
                     "expected_output", "metadata")


def counters(src: DatasetSources, classified: DataFrame) -> DataFrame:
    """Row counts of the sources, eligible ids, one count per reject reason, final
    size and duplicate ids removed per source, as (metric, value)."""
    calls_id = require(src.calls.columns, K.ID_ALIASES, "call id in calls")
    manual_id = require(src.manual.columns, K.ID_ALIASES, "call id in manual audit")
    cj_id = require(src.call_jsons.columns, K.CALL_JSONS_ID_ALIASES, "call id in call_jsons")
    type_col = require(src.manual.columns, K.TYPE_ALIASES, "type")

    def rows_and_dups(df, id_col, prefix, cond=None):
        d = df.withColumn("_id", clean_id(F.col(id_col))).filter(F.col("_id").isNotNull())
        if cond is not None:
            d = d.filter(cond)
        per = d.groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
        return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(f"{prefix}_rows"),
                       F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias(f"{prefix}_dups"))

    manual_type = F.lower(py_strip(F.coalesce(F.col(type_col), F.lit("")))) == K.MANUAL_TYPE_VALUE
    c = rows_and_dups(src.calls, calls_id, "calls")
    m = rows_and_dups(src.manual, manual_id, "manual")
    mt = rows_and_dups(src.manual, manual_id, "manual_typed", manual_type)
    cj = rows_and_dups(src.call_jsons, cj_id, "call_jsons")
    r = classified.agg(
        F.count(F.lit(1)).alias("eligible"),
        *[F.count_if(F.col("reject_reason") == reason).alias(f"missing_{reason}") for reason in K.REJECT_REASONS],
        F.count_if(F.col("reject_reason").isNull()).alias("final"))
    metrics = ["calls_rows", "manual_rows", "manual_typed_rows", "call_jsons_rows", "eligible",
               *[f"missing_{x}" for x in K.REJECT_REASONS], "final",
               "calls_dups", "manual_typed_dups", "call_jsons_dups"]
    # every input is a one-row global aggregate: the joins below are 1 x 1
    one = F.lit(1)
    wide = (c.withColumn("_k", one).join(m.withColumn("_k", one), "_k")
            .join(mt.withColumn("_k", one), "_k").join(cj.withColumn("_k", one), "_k")
            .join(r.withColumn("_k", one), "_k"))
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("metric"), F.col(x).cast("long").alias("value")) for x in metrics])))
