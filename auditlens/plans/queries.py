"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole driver tables. ``oracle_sql()`` holds the DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions import jsonx as JX
from auditlens.functions.labels import badge
from auditlens.functions.text import fraction_text
from auditlens.functions import template as TPL
from auditlens.operators import dataset as DS
from auditlens.operators import dedupe as DD
from auditlens.operators import fanout as FO
from auditlens.operators import health as H
from auditlens.operators import layout as LY
from auditlens.operators import incremental as INC
from auditlens.operators.hash_store import HashStore
from auditlens.operators import restore as R
from auditlens.plans import audit_job as AJ
from auditlens.plans import driver_tables as D
from auditlens.plans import growing as GR
from auditlens.plans import intake as IN
from auditlens.plans import oracle as O


def _audit(spark: SparkSession, sf_dir: str) -> AJ.AuditReport:
    return AJ.AuditReport(D.manual_audits(spark, sf_dir), D.ai_audits(spark, sf_dir))


def audit_summary_ai(spark, sf_dir):
    return _audit(spark, sf_dir).table("ai_summary")


def audit_summary_manual(spark, sf_dir):
    return _audit(spark, sf_dir).table("manual_summary")


def audit_summary_ai_matched(spark, sf_dir):
    return _audit(spark, sf_dir).table("ai_matched_summary")


def audit_overall(spark, sf_dir):
    return _audit(spark, sf_dir).table("overall")


def audit_overview(spark, sf_dir):
    return _audit(spark, sf_dir).table("overview")


def audit_fieldwise(spark, sf_dir):
    return _audit(spark, sf_dir).table("fieldwise")


def audit_binary_comparison(spark, sf_dir):
    return _audit(spark, sf_dir).table("binary_comparison")


def audit_value_comparison(spark, sf_dir):
    return _audit(spark, sf_dir).table("value_comparison")


def audit_summary_statistics(spark, sf_dir):
    return _audit(spark, sf_dir).table("summary_statistics")


def audit_macro_accuracy(spark, sf_dir):
    # a mean of 12 doubles: summation order may differ between engines in the last bit
    return _audit(spark, sf_dir).table("macro_accuracy").select(F.round("macro_accuracy", 6).alias("macro_accuracy"))


def _restored(spark, sf_dir):
    calls, audit = D.restore_inputs(spark, sf_dir)
    return calls, R.restore_ids(audit, calls)


def restore_lookup(spark, sf_dir):
    calls, _ = D.restore_inputs(spark, sf_dir)
    return R.unique_pair_lookup(calls)


def restore_ids(spark, sf_dir):
    _, out = _restored(spark, sf_dir)
    return out.select(F.col("Call ID").alias("call_id"), F.col("Seller GLID").alias("seller_glid"),
                      F.col("Caller GLID").alias("caller_glid"), "line", "part", "id_missing", "id_restored")


def restore_counters(spark, sf_dir):
    _, out = _restored(spark, sf_dir)
    return R.restore_counters(out)


def restore_pair_counts(spark, sf_dir):
    calls, _ = D.restore_inputs(spark, sf_dir)
    return R.pair_counts(calls)


def json_path_extract(spark, sf_dir):
    from auditlens.functions.jsonx import json_path
    ev = D.read(spark, sf_dir, "events")
    return ev.select("event_id", json_path(F.col("props"), "$.k", "bigint").alias("k"),
                     json_path(F.col("props"), "$.missing", "string").alias("missing"))


DEDUPE_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
               "l_returnflag"]


def first_row_wins(spark, sf_dir):
    li = D.read(spark, sf_dir, "lineitem").select(*DEDUPE_COLS)
    return DD.first_per_key(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).select(*DEDUPE_COLS)


def last_row_wins(spark, sf_dir):
    li = D.read(spark, sf_dir, "lineitem").select(*DEDUPE_COLS)
    return DD.last_per_key(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).select(*DEDUPE_COLS)


def dup_counts(spark, sf_dir):
    return DD.duplicate_count(D.read(spark, sf_dir, "lineitem"), "l_orderkey")


def _outcomes(spark, sf_dir):
    probes = D.probe_log(spark, sf_dir)
    keep = probes.filter(~H.keyword_excluded("model"))
    return H.probe_outcomes(keep, ["ts", "event_id"])


def model_candidates(spark, sf_dir):
    return H.candidate_models(D.probe_log(spark, sf_dir))


def healthy_models(spark, sf_dir):
    return _outcomes(spark, sf_dir).filter(F.col("status") == "Healthy").select("model")


def broken_models(spark, sf_dir):
    return _outcomes(spark, sf_dir).filter(F.col("status") == "Broken").select("model", "error_type", "error", "error_short")


def health_summary(spark, sf_dir):
    return H.health_summary(_outcomes(spark, sf_dir))


def badge_documents(spark, sf_dir):
    return D.read(spark, sf_dir, "documents").select("doc_id", badge(F.col("text"), method="contains").alias("badge"))


def hash_new_only(spark, sf_dir):
    docs = INC.with_content_hash(D.read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    known = docs.join(D.read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    store = HashStore(spark, IN.scratch(spark, "hashes"))
    store.append(known.select("content_hash").distinct())
    return store.new_only(docs).select("doc_id", "content_hash")


def percent_text(spark, sf_dir):
    counts = D.read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    # a global aggregate is exactly one row: broadcasting it is size-bounded
    total = counts.agg(F.sum("n").cast("long").alias("total")).withColumn("_one", F.lit(1))
    j = counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")
    shares = j.select(F.concat(F.lit("type "), F.col("event_type")).alias("item"), "n", "total")
    # one fraction per event id, so that many counts (and ties of the printed digits) are covered
    ids = D.read(spark, sf_dir, "events").select(
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("item"),
        (F.col("event_id") % 16000).alias("n"), F.lit(16000).cast("long").alias("total"))
    return shares.unionByName(ids).select("item", "n", "total", fraction_text(F.col("n"), F.col("total")).alias("share_text"))


def _costed(spark, sf_dir):
    prices = FO.model_dimension(spark, D.DEFAULT_MODELS)
    return FO.with_cost(D.response_log(spark, sf_dir), prices)


def response_cost(spark, sf_dir):
    return _costed(spark, sf_dir).select("row_id", "model", "prompt_tokens", "completion_tokens",
                                         F.round("cost", 12).alias("cost"))


def model_stats(spark, sf_dir):
    return _rounded_stats(FO.model_stats(_costed(spark, sf_dir)))


def _rounded_stats(st):
    return st.select("model", "requests", "success", "failed",
                     *[F.round(c, 6).alias(c) for c in ("avg_latency", "min_latency", "max_latency", "stddev_latency",
                                                        "avg_prompt_tokens", "avg_completion_tokens",
                                                        "avg_total_tokens", "avg_cost", "p95_latency")])


def run_totals(spark, sf_dir):
    return FO.run_totals(D.response_log(spark, sf_dir))


def response_pivot(spark, sf_dir):
    return FO.response_pivot(D.response_log(spark, sf_dir), D.MODEL_IDS)


def fanout_prompts(spark, sf_dir):
    """Rows x models with rendered prompts."""
    rows = D.prompt_rows(spark, sf_dir)
    system, user = TPL.render_prompts(D.SYSTEM_TEMPLATE, D.USER_TEMPLATE, F.col("User Details"),
                                      F.col("Product Details"), F.col("Past Conversation"),
                                      F.col("Ongoing Conversation"))
    rendered = rows.select("conv_id", "turn", system.alias("system_prompt"), user.alias("user_prompt"))
    return FO.fan_out(rendered, D.DEFAULT_MODELS).select("conv_id", "turn", "model", "system_prompt", "user_prompt")


def _dataset(spark, sf_dir):
    calls, manual, cj = D.dataset_sources(spark, sf_dir)
    src = DS.DatasetSources(calls, manual, cj)
    return src, DS.classify(src)


def dataset_status(spark, sf_dir):
    _, cls = _dataset(spark, sf_dir)
    return cls.select("call_id", "reject_reason", "expected_output", "metadata")


def dataset_counters(spark, sf_dir):
    src, cls = _dataset(spark, sf_dir)
    return DS.counters(src, cls)


def dataset_build(spark, sf_dir):
    """Accepted rows with the pretty-printed input sections (Python json formatting: no SQL oracle)."""
    _, cls = _dataset(spark, sf_dir)
    return DS.accepted(cls)


def _screens(spark, sf_dir):
    images, detections = D.screenshot_inputs(spark, sf_dir)
    placed = LY.place_badges(detections, images)
    return images, detections, placed


def grid_cells(spark, sf_dir):
    _, _, placed = _screens(spark, sf_dir)
    return LY.last_hits(placed)


def screen_header(spark, sf_dir):
    _, detections, _ = _screens(spark, sf_dir)
    return LY.header_fields(LY.header_text(detections))


def screen_comparison(spark, sf_dir):
    images, detections, placed = _screens(spark, sf_dir)
    return LY.compare_screens(LY.cell_values(placed, images), LY.header_fields(LY.header_text(detections)))


def screen_field_accuracy(spark, sf_dir):
    return LY.screen_field_accuracy(screen_comparison(spark, sf_dir))


def screen_binary(spark, sf_dir):
    return LY.screen_binary(screen_comparison(spark, sf_dir))


def screen_values(spark, sf_dir):
    return LY.screen_values(screen_comparison(spark, sf_dir))


def screen_summary_statistics(spark, sf_dir):
    return LY.screen_summary_statistics(screen_comparison(spark, sf_dir))


def screen_overall(spark, sf_dir):
    return LY.screen_overall(screen_comparison(spark, sf_dir))


def benchmark_comparison(spark, sf_dir):
    """Every event as an input row (most get no answer) with a column per model, one of which never answers."""
    rows = D.read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "event_type")
    return FO.comparison_table(rows, D.response_log(spark, sf_dir), [*D.MODEL_IDS, D.ABSENT_MODEL])


def benchmark_summary(spark, sf_dir):
    st = FO.model_stats(_costed(spark, sf_dir), models=[*D.MODEL_IDS, D.ABSENT_MODEL])
    return _rounded_stats(st)


def inferred_details(spark, sf_dir):
    """Buyer and seller details of every call text, or why there are none."""
    call = F.col("call")
    parsed = D.call_texts(spark, sf_dir).withColumn("v", JX.as_variant(call)).withColumn("note", JX.details_problem(F.col("v"), call))
    return parsed.select("event_id", "note", JX.inferred_details(F.col("v"), F.col("note")).alias("details"))


def doc_label_agreement(spark, sf_dir):
    """Manual quality labels against the badge that the rules find in the whole text."""
    good = [K.CORRECT, K.NOT_DISCUSSED, "Inferred"]
    docs = D.read(spark, sf_dir, "documents").select("doc_id", F.coalesce(badge("text", method="contains"), F.lit("none")).alias("badge"))
    j = D.read(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
    return (j.groupBy("quality", "badge").agg(F.count("*").alias("n"))
            .withColumn("agrees", (F.col("quality") == 1) == F.col("badge").isin(good)))


QUERIES = {
    "audit_summary_ai": audit_summary_ai,
    "audit_summary_manual": audit_summary_manual,
    "audit_summary_ai_matched": audit_summary_ai_matched,
    "audit_overall": audit_overall,
    "audit_overview": audit_overview,
    "audit_fieldwise": audit_fieldwise,
    "audit_binary_comparison": audit_binary_comparison,
    "audit_value_comparison": audit_value_comparison,
    "audit_summary_statistics": audit_summary_statistics,
    "audit_macro_accuracy": audit_macro_accuracy,
    "restore_lookup": restore_lookup,
    "restore_ids": restore_ids,
    "restore_counters": restore_counters,
    "restore_pair_counts": restore_pair_counts,
    "json_path_extract": json_path_extract,
    "first_row_wins": first_row_wins,
    "last_row_wins": last_row_wins,
    "dup_counts": dup_counts,
    "model_candidates": model_candidates,
    "healthy_models": healthy_models,
    "broken_models": broken_models,
    "health_summary": health_summary,
    "badge_documents": badge_documents,
    "hash_new_only": hash_new_only,
    "percent_text": percent_text,
    "response_cost": response_cost,
    "model_stats": model_stats,
    "run_totals": run_totals,
    "response_pivot": response_pivot,
    "fanout_prompts": fanout_prompts,
    "dataset_status": dataset_status,
    "dataset_counters": dataset_counters,
    "dataset_build": dataset_build,
    "grid_cells": grid_cells,
    "screen_header": screen_header,
    "screen_comparison": screen_comparison,
    "screen_field_accuracy": screen_field_accuracy,
    "screen_binary": screen_binary,
    "screen_values": screen_values,
    "screen_summary_statistics": screen_summary_statistics,
    "screen_overall": screen_overall,
    "benchmark_comparison": benchmark_comparison,
    "benchmark_summary": benchmark_summary,
    "inferred_details": inferred_details,
    "doc_label_agreement": doc_label_agreement,
    **IN.QUERIES,
    **GR.QUERIES,
}


def oracle_sql() -> dict[str, str]:
    return {
        "audit_summary_ai": O.summary_sql("ai"),
        "audit_summary_manual": O.summary_sql("manual"),
        "audit_summary_ai_matched": O.summary_sql("ai_matched"),
        "audit_overall": O.overall_sql(),
        "audit_overview": O.overview_sql(),
        "audit_fieldwise": O.fieldwise_sql(),
        "audit_binary_comparison": O.binary_comparison_sql(),
        "audit_value_comparison": O.value_comparison_sql(),
        "audit_summary_statistics": O.summary_statistics_sql(),
        "audit_macro_accuracy": O.macro_accuracy_sql(),
        "restore_lookup": O.restore_lookup_sql(),
        "restore_ids": O.restore_ids_sql(),
        "restore_counters": O.restore_counters_sql(),
        "restore_pair_counts": O.restore_pair_counts_sql(),
        "json_path_extract": O.json_path_extract_sql(),
        "first_row_wins": O.row_per_key_sql(last=False),
        "last_row_wins": O.row_per_key_sql(last=True),
        "dup_counts": O.dup_counts_sql(),
        "model_candidates": O.model_candidates_sql(),
        "healthy_models": O.healthy_models_sql(),
        "broken_models": O.broken_models_sql(),
        "health_summary": O.health_summary_sql(),
        "badge_documents": O.badge_documents_sql(),
        "hash_new_only": O.hash_new_only_sql(),
        "percent_text": O.percent_text_sql(),
        "response_cost": O.response_cost_sql(),
        "model_stats": O.model_stats_sql(),
        "run_totals": O.run_totals_sql(),
        "response_pivot": O.response_pivot_sql(),
        "dataset_status": O.dataset_status_sql(),
        "dataset_counters": O.dataset_counters_sql(),
        "grid_cells": O.grid_cells_sql(),
        "screen_header": O.screen_header_sql(),
        "screen_comparison": O.screen_comparison_sql(),
        "screen_field_accuracy": O.screen_field_accuracy_sql(),
        "screen_binary": O.screen_binary_sql(),
        "screen_values": O.screen_values_sql(),
        "screen_summary_statistics": O.screen_summary_statistics_sql(),
        "screen_overall": O.screen_overall_sql(),
        "benchmark_comparison": O.benchmark_comparison_sql(),
        "benchmark_summary": O.benchmark_summary_sql(),
        "inferred_details": O.inferred_details_sql(),
        "doc_label_agreement": O.doc_label_agreement_sql(),
        "fanout_prompts": O.fanout_prompts_sql(),
        **{name: sql() for name, sql in (IN.ORACLE | GR.ORACLE).items()},
    }
