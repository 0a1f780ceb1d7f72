"""Plan-shape checks for the scale claims in the README."""
import re

from conftest import SF001

from auditlens.plans import audit_job as AJ
from auditlens.plans import driver_tables as D
from auditlens.plans.audit_job import AuditReport
from auditlens.sources.sinks import stage_bucketed

M_S = "`Call ID` string, Auditor string, Verdict string, `Buyer Name` string, _seq long"
A_S = "call_id string, `Call Verdict` string, buyerName string, _seq long"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_comparison_join_reuses_the_dedupe_partitioning(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        manual = spark.createDataFrame([("1", "a", "yes", "Correct", 1)], M_S)
        ai = spark.createDataFrame([("1", "yes", "Missing", 1)], A_S)
        plan = _plan(AJ.AuditReport(manual, ai).table("binary_comparison"))
        assert "SortMergeJoin" in plan
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2   # one per side, none for the join
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_summary_is_partially_aggregated_before_the_shuffle(spark):
    manual = spark.createDataFrame([("1", "a", "yes", "Correct", 1)], M_S)
    ai = spark.createDataFrame([("1", "yes", "Missing", 1)], A_S)
    plan = _plan(AJ.AuditReport(manual, ai).table("manual_summary"))
    assert "partial_count" in plan and "partial_sum" in plan


def test_comparisons_of_bucketed_rows_need_no_exchange(spark, tmp_path):
    rep = AuditReport(D.manual_audits(spark, SF001), D.ai_audits(spark, SF001))
    plain = {p: sorted(map(str, rep.compared(p, "Correct").collect())) for p in ("match", "exclude")}
    rep.use_rows(lambda df, side: stage_bucketed(df, str(tmp_path / side), "call_id", 4))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for policy, want in plain.items():
            df = rep.compared(policy, "Correct")
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert sorted(map(str, df.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
