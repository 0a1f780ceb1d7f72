from auditlens.operators import dataset as DS
from auditlens.operators import summary as S
from auditlens.plans import audit_job as AJ


def test_no_verdict_column_and_unmapped_fields(spark):
    manual = spark.createDataFrame([("1", "Correct", 1), ("2", None, 2)], "`Call ID` string, `Buyer Name` string, _seq long")
    ai = spark.createDataFrame([("1", "Missing", 1)], "callid string, `buyer name` string, _seq long")
    rep = AJ.AuditReport(manual, ai)
    summ = {r.field_pos: r for r in rep.table("manual_summary").collect()}
    assert summ[1].total_calls == 2 and summ[1].correct_nd == 1 and summ[2].total_calls == 0
    ov = {(r.section, r.metric): r.value for r in rep.table("overview").collect()}
    assert ov[("ai", "yes")] == 0 and ov[("manual", "total")] == 2
    b = rep.table("binary_comparison").collect()
    assert len(b) == 1 and b[0].buyer_name == 0 and b[0].matches == 11


def test_summary_with_nothing_mapped(spark):
    df = spark.createDataFrame([("1",)], "x string")
    rows = S.field_summary(df, {}).collect()
    assert len(rows) == 12 and all(r.total_calls == 0 and r.average == 0.0 for r in rows)


def test_dataset_without_optional_columns(spark):
    calls = spark.createDataFrame([("1", 1)], "`Call ID` string, _seq long")
    cj = spark.createDataFrame([("1", 1)], "call_id string, _seq long")
    manual = spark.createDataFrame([("1", "t", "manual", "Yes", 1)],
                                   "`Call ID` string, Transcript string, Type string, Verdict string, _seq long")
    src = DS.DatasetSources(calls, manual, cj)
    cls = DS.classify(src).collect()
    assert [(r.call_id, r.reject_reason) for r in cls] == [("1", "call_json")]
    got = {r.metric: r.value for r in DS.counters(src, DS.classify(src)).collect()}
    assert got["eligible"] == 1 and got["missing_call_json"] == 1 and got["final"] == 0
