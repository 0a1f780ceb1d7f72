"""File-in, reports-out jobs: one function (and CLI sub-command) per audit job.

Every job stages the CSV inputs that it reads more than once to Parquet inside its
new version folder (``multiLine`` CSV is not splittable, and the staged table cuts
lineage for the several reports that read it), then writes each report table under
``<out>/v=N/<table>``. The driver sees the distinct header rows and a percentile's brackets, never data rows.

    python -m auditlens.plans.jobs audit --manual m.csv --ai a.csv --out reports/audit
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions import template as TPL
from auditlens.operators import compare as C
from auditlens.operators import dataset as DS
from auditlens.operators import fanout as FO
from auditlens.operators import health as H
from auditlens.operators import layout as LY
from auditlens.operators import restore as R
from auditlens.operators.ledger import call_once
from auditlens.operators.model_metrics import model_metrics
from auditlens.operators.numbering import dense_numbers
from auditlens.plans import audit_job as AJ
from auditlens.sources.audits import default_inputs, read_audits
from auditlens.sources.csv import read_csv
from auditlens.sources.files import load_template
from auditlens.sources.sinks import new_version, stage_bucketed, write_metrics, write_table


#: Report order: fields by position, rows by input order, calls and images by id.
SORT_KEYS = ("field_pos", "row_id", "call_id", "image_id", "model")


def _stage(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def _write_all(tables: dict[str, DataFrame], out: str, fmt: str) -> str:
    """Every table, sorted by the first of ``SORT_KEYS`` that it has."""
    for name, df in tables.items():
        key = next((k for k in SORT_KEYS if k in df.columns), None)
        write_table(df.orderBy(key) if key else df, f"{out}/{name}", fmt)
    return out


def run_audit(spark, manual_path, ai_path, out_base, fmt="parquet", blank_policy="match",
              unknown_label=K.CORRECT) -> str:
    """Report tables of two sets of audit files, whose headers may differ from file to file, with the intake's own
    tables: ``header_map``, ``rejects`` (records that no column can take) and ``intake`` (records, good and rejected per file)."""
    with new_version(spark, out_base) as out:
        sides = {"manual": read_audits(spark, manual_path), "ai": read_audits(spark, ai_path)}
        staged = {side: _stage(spark, files.rows, f"{out}/_staged/{side}") for side, files in sides.items()}
        rep = AJ.AuditReport(staged["manual"], staged["ai"], blank_policy, unknown_label)
        # both sides in buckets of the call id: the comparisons add no exchange
        rep.use_rows(lambda df, side: stage_bucketed(df, f"{out}/_staged/{side}_rows", "call_id"))
        # six report tables read the comparison: materialise it once (also cuts lineage)
        rep.use_comparison(_stage(spark, rep.comparison, f"{out}/_staged/comparison"))
        intake = {name: reduce(DataFrame.unionByName, [getattr(files, of).withColumn("side", F.lit(side)) for side, files in sides.items()])
                  for name, of in (("header_map", "header_map"), ("rejects", "rejects"), ("intake", "counts"))}
        # the other blank policy, from the same rows: how much of the accuracy blanks make
        other = "exclude" if blank_policy == "match" else "match"
        intake[f"accuracy_{other}"] = C.comparison_totals(rep.compared(other, unknown_label))
        return _write_all({n: rep.table(n) for n in AJ.REPORT_TABLES if n != "comparison"} | intake, out, fmt)


def run_restore(spark, calls_path, audit_path, out_base) -> str:
    with new_version(spark, out_base) as out:
        # pandas-style NA strings become NULL at the scan, as in a default ``read_csv``
        calls = _stage(spark, read_csv(spark, calls_path).drop("_seq"), f"{out}/_staged/calls")
        audit = _stage(spark, read_csv(spark, audit_path), f"{out}/_staged/audit")
        restored = _stage(spark, R.restore_ids(audit, calls), f"{out}/_staged/restored")
        write_table(restored.orderBy("_seq").drop("_seq", "id_missing", "id_restored"), f"{out}/restored_audit", "csv")
        write_metrics(R.restore_counters(restored), f"{out}/summary")
        return out


def run_dataset(spark, calls_path, manual_path, call_jsons_path, out_base, json_style="pretty") -> str:
    with new_version(spark, out_base) as out:
        src = DS.DatasetSources(*(_stage(spark, read_csv(spark, path, unify=DS.ALIASES[name]), f"{out}/_staged/{name}") for name, path in (
            ("calls", calls_path), ("manual", manual_path), ("call_jsons", call_jsons_path))))
        classified = _stage(spark, DS.classify(src), f"{out}/_staged/classified")
        write_table(DS.accepted(classified, json_style).orderBy("call_id").drop("call_id"), f"{out}/dataset", "csv")
        write_table(classified.select("call_id", "reject_reason", "details_note").orderBy("call_id"), f"{out}/rejects", "csv")
        write_metrics(DS.counters(src, classified), f"{out}/report")
        return out


def run_health(spark, probe_log_path, out_base, order=("_seq",)) -> str:
    """Probe log CSV (model, http_status, body, exception) -> healthy / broken / summary."""
    with new_version(spark, out_base) as out:
        probes = read_csv(spark, probe_log_path, na_tokens=None).withColumn(
            "http_status", F.col("http_status").try_cast("int"))
        outcomes = _stage(spark, H.probe_outcomes(probes.filter(~H.keyword_excluded("model")), list(order)),
                          f"{out}/_staged/outcomes")
        write_table(outcomes.filter(F.col("status") == "Healthy").select("model").orderBy("model"),
                    f"{out}/healthy_models", "csv")
        write_table(outcomes.filter(F.col("status") == "Broken").select("model", "error_type", "error", "error_short")
                    .orderBy("model"), f"{out}/broken_models", "csv")
        write_metrics(H.health_summary(outcomes), f"{out}/summary")
        return out


def run_benchmark(spark, rows_path, template_path, out_base, models=None, client: Callable | None = None,
                  response_log_path: str | None = None, limit: int = 0, partitions: int = 8, ledger: str | None = None, **defaults) -> str:
    """Prompt benchmark: rows x models -> responses (live ``client`` or a response log) -> reports.

    ``defaults`` (default_seller, default_company, default_buyer) go to ``render_prompts``.

    Row ids: all rows, or the first ``limit`` ones, are numbered 0..n-1 in input order. The ids are written to
    ``_staged/rows``; a response log given instead of a client must carry those ids. ``ledger``: a folder that outlives
    the job; calls that it holds are not made again (see ``operators.ledger``).
    """
    models = models or K.DEFAULT_MODELS
    with new_version(spark, out_base) as out:
        rows = read_csv(spark, rows_path)
        rows = _stage(spark, FO.head_rows(rows, limit), f"{out}/_staged/input")
        rows = _stage(spark, dense_numbers(rows, ["_seq"], f"{out}/_staged/ordered"), f"{out}/_staged/rows")
        if response_log_path:
            results = read_csv(spark, response_log_path, na_tokens=None).select(
                F.col("row_id").cast("long"), "model", "response", F.col("latency").try_cast("double"),
                *[F.col(c).try_cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
                "status")
        else:
            system_t, user_t = load_template(spark, template_path)
            system, user = TPL.render_prompts(system_t, user_t, F.col("User Details"), F.col("Product Details"),
                                              F.col("Past Conversation"), F.col("Ongoing Conversation"), **defaults)
            tasks = FO.fan_out(rows.select("row_id", system.alias("system_prompt"), user.alias("user_prompt")), models)
            results = call_once(tasks, client, ledger, partitions) if ledger else FO.call_models(tasks, client, partitions=partitions)
        results = _stage(spark, FO.with_cost(results, FO.model_dimension(spark, models)), f"{out}/_staged/results")
        input_cols = [c for c in rows.columns if c not in ("_seq",)]
        names = [m[0] for m in models]
        return _write_all({"comparison": FO.comparison_table(rows.select(*input_cols), results, names), "responses": results,
                       "model_metrics": model_metrics(results, f"{out}/_staged/metrics", names),
                           "benchmark_summary": FO.model_stats(results, models=names), "totals": FO.run_totals(results)}, out,
                          "parquet")


def run_screens(spark, images: DataFrame, detections: DataFrame, out_base) -> str:
    with new_version(spark, out_base) as out:
        placed = LY.place_badges(detections, images)
        cmp = _stage(spark, LY.compare_screens(LY.cell_values(placed, images),
                                               LY.header_fields(LY.header_text(detections, f"{out}/_staged/headers"))), f"{out}/_staged/cmp")
        return _write_all(LY.screen_reports(cmp), out, "parquet")


def main(argv=None):
    from auditlens.session import get_session
    p = argparse.ArgumentParser(prog="auditlens")
    sub = p.add_subparsers(dest="job", required=True)
    a = sub.add_parser("audit")
    a.add_argument("--manual", help="audit CSV file or folder; default: input/Manual Audits.csv")
    a.add_argument("--ai", help="audit CSV file or folder; default: input/AI Audits.csv")
    a.add_argument("--out", required=True)
    a.add_argument("--format", default="parquet")
    a.add_argument("--blank-policy", default="match", choices=["match", "exclude"])
    r = sub.add_parser("restore")
    r.add_argument("--calls", required=True)
    r.add_argument("--audit", required=True)
    r.add_argument("--out", required=True)
    d = sub.add_parser("dataset")
    d.add_argument("--calls", required=True)
    d.add_argument("--manual", required=True)
    d.add_argument("--call-jsons", required=True)
    d.add_argument("--out", required=True)
    h = sub.add_parser("health")
    h.add_argument("--probes", required=True)
    h.add_argument("--out", required=True)
    b = sub.add_parser("benchmark")
    b.add_argument("--rows", required=True)
    b.add_argument("--template", required=True)
    b.add_argument("--responses", required=True, help="response log CSV (no live client from the CLI)")
    b.add_argument("--out", required=True)
    b.add_argument("--limit", type=int, default=0, help="first rows only; 0 = all")
    args = p.parse_args(argv)
    spark = get_session(app=f"auditlens-{args.job}")
    if args.job == "audit":
        manual, ai = default_inputs(spark, args.manual, args.ai)
        print(run_audit(spark, manual, ai, args.out, args.format, args.blank_policy))
    elif args.job == "restore":
        print(run_restore(spark, args.calls, args.audit, args.out))
    elif args.job == "dataset":
        print(run_dataset(spark, args.calls, args.manual, args.call_jsons, args.out))
    elif args.job == "health":
        print(run_health(spark, args.probes, args.out))
    else:
        print(run_benchmark(spark, args.rows, args.template, args.out, response_log_path=args.responses,
                            limit=args.limit))


if __name__ == "__main__":
    main()
