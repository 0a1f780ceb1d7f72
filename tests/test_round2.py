"""CSV intake by name, exact percentages, report completeness, plans of the skew-safe percentile and dataset build."""
import math
import re

import pytest
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.text import fixed2, fraction_text
from auditlens.operators import compare as C
from auditlens.operators import dataset as DS
from auditlens.operators import fanout as FO
from auditlens.operators.quantile import exact_percentile
from auditlens.plans import jobs
from auditlens.sources.csv import read_csv
from auditlens.streaming import incremental as ING


def test_csv_is_read_by_name_from_any_path(spark, tmp_path):
    d = tmp_path / "in put 100% [x]"
    d.mkdir()
    (d / "Manual Audits.csv").write_bytes(b"Call ID,Verdict\n1,Yes\n")
    (d / "b.csv").write_bytes(b"Verdict,Call ID\nNo,2\n")
    (d / "c.csv").write_bytes("Call ID,Verdict,Reminder\n3,Yes,\"a,\nb\"\n4,N\xe9,\n".encode("latin-1"))
    (d / "d.csv").write_bytes("\ufeffcall id,Note\n5,é\n".encode())
    (d / "empty.csv").write_bytes(b"Call ID,Other\n")
    escaped = re.sub(r"([\[\]])", r"\\\1", str(d))
    df = read_csv(spark, escaped)
    assert sorted(c.lower() for c in df.columns) == sorted(["call id", "verdict", "reminder", "note", "other", "_seq"])
    got = sorted((r["Call ID"], r["Verdict"], r["Reminder"], r["Note"]) for r in df.collect())
    assert got == [("1", "Yes", None, None), ("2", "No", None, None), ("3", "Yes", "a,\nb", None), ("4", "Né", None, None), ("5", None, None, "é")]
    one = read_csv(spark, f"{escaped}/Manual Audits.csv").collect()
    assert [(r["Call ID"], r["Verdict"]) for r in one] == [("1", "Yes")]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("n", [7, 4000, 20000])
def test_percent_text_matches_python_for_every_count(spark, n):
    rows = spark.range(n + 1).select("id", fraction_text(F.col("id"), F.lit(n)).alias("t")).collect()
    assert [r.t for r in rows] == [f"{r.id}/{n} | {r.id / n * 100:.2f}%" for r in rows]


def test_fixed2_ties_and_signs(spark):
    values = [0.125, 0.375, 2.675, -0.005, -1.005, 0.005, 123456789.125, 0.0, 1e-300, 1e15 / 7]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed2("v").alias("t")).collect()
    assert [r.t for r in got] == ["0.12", "0.38", "2.67", "-0.01", "-1.00", "0.01", "123456789.12", "0.00", "0.00", f"{1e15 / 7:.2f}"]


def test_percentile_plan_has_no_raw_exchange_and_misses_no_rank(spark):
    rows = spark.createDataFrame([(str(i % 3), float((i * 7919) % 10007)) for i in range(20_000)], "g string, v double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = exact_percentile(rows, ["g"], "v", 0.95, accuracy=1000)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        got = {r.g: r.percentile for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for g in "012":
        v = sorted(float((i * 7919) % 10007) for i in range(20_000) if str(i % 3) == g)
        k = (len(v) - 1) * 0.95
        assert got[g] == pytest.approx(v[math.floor(k)] + (v[math.ceil(k)] - v[math.floor(k)]) * (k - math.floor(k)))


def test_stats_skip_nan_and_list_absent_models(spark):
    rows = [(1, "a", float("nan"), "Success"), (2, "a", 2.0, "Success"), (3, "a", None, "Failed")]
    df = spark.createDataFrame(rows, "row_id long, model string, latency double, status string").selectExpr(
        "*", "CAST(NULL AS BIGINT) prompt_tokens", "CAST(NULL AS BIGINT) completion_tokens", "CAST(NULL AS BIGINT) total_tokens", "CAST(NULL AS DOUBLE) cost")
    got = {r.model: r for r in FO.model_stats(df, models=["a", "b"]).collect()}
    assert (got["a"].requests, got["a"].avg_latency, got["a"].max_latency, got["a"].p95_latency) == (3, 2.0, 2.0, 2.0)
    assert (got["b"].requests, got["b"].failed, got["b"].avg_latency, got["b"].p95_latency) == (0, 0, 0.0, 0.0)


def test_lost_connections_are_tried_again():
    calls, slept = [], []

    def client():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionResetError("gone")
        return {"response": "ok"}

    reply, took = FO.RetryPolicy(attempts=3, backoff=1, sleep=slept.append).run(client)
    assert reply == {"response": "ok"} and slept == [1, 2] and took >= 0
    assert FO.RetryPolicy(sleep=slept.append).run(lambda: 1 / 0)[0] is None and slept == [1, 2]


def test_unknown_labels_are_not_compared(spark):
    fields = ", ".join(f"{f} string" for f in K.FIELDS)
    row = [None] * len(K.FIELDS)
    m = spark.createDataFrame([("1", "x", "zzz", *row[1:], 1)], f"call_id string, auditor string, {fields}, _seq long")
    a = spark.createDataFrame([("1", "Missing", *["Correct"] * (len(K.FIELDS) - 1), 1)], f"call_id string, {fields}, _seq long")
    got = C.compare_calls(m, a, unknown_label=None).first()
    first = K.FIELDS[0]
    assert got[f"{first}_match"] is None and got[f"{first}_imputed"] == 0
    assert got.total_fields == len(K.FIELDS) - 1 == got.matches


def test_same_bytes_in_one_batch_are_stored_once_and_bad_results_fail(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in ("a.png", "b.png"):
        (src / name).write_bytes(b"same")
    out = tmp_path / "out"
    ING.start(spark, str(src), str(out), str(tmp_path / "ck")).awaitTermination(120)
    rows = spark.read.parquet(str(out)).collect()
    assert len(rows) == 1 and rows[0].path.endswith("a.png")
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        ING._known(spark, str(broken)).count()


def test_audit_reports_are_sorted(spark, tmp_path):
    head = "Call ID,Buyer Name,Verdict\n"
    (tmp_path / "m.csv").write_text(head + "3,Correct,Yes\n1,Missing,No\n2,,Yes\n")
    (tmp_path / "a.csv").write_text(head + "2,Correct,Yes\n3,Missing,No\n1,Correct,Yes\n")
    out = jobs.run_audit(spark, str(tmp_path / "m.csv"), str(tmp_path / "a.csv"), str(tmp_path / "r"), fmt="csv")
    ids = spark.read.option("header", True).csv(f"{out}/binary_comparison").coalesce(1).collect()
    assert [r.call_id for r in ids] == ["1", "2", "3"]


def test_dataset_semi_joins_below_the_aggregates(spark):
    one = spark.createDataFrame([("1", "t", "manual", 1)], "`Call ID` string, Transcript string, Type string, _seq long")
    calls = spark.createDataFrame([("1", "{}", "x", 1)], "`Call ID` string, call_json string, inferred_details string, _seq long")
    src = DS.DatasetSources(calls, one, calls.drop("inferred_details"))
    plan = DS.classify(src)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 3
    last = [line for line in plan.splitlines() if "Join LeftSemi" in line]
    aggregates = [i for i, line in enumerate(plan.splitlines()) if "Aggregate" in line]
    assert all(any(a < plan.splitlines().index(line) for a in aggregates) for line in last)


def test_texts_with_nan_are_read(spark):
    from auditlens.functions import jsonx as J
    df = spark.createDataFrame([('{"buyer_details":{"buyer_name":"A","buyer_number":NaN}}',), ("{'x': 1",)], "t string").withColumn("v", J.as_variant("t"))
    got = [(r.note, r.d) for r in df.withColumn("note", J.details_problem(F.col("v"), F.col("t"))).select("note", J.inferred_details(F.col("v"), F.col("note")).alias("d")).collect()]
    assert got[0][0] is None and '"A"' in got[0][1] and "NaN" in got[0][1] and got[1][0] == "unparsable"


def test_ai_default_can_be_switched_off(spark):
    from auditlens.operators import layout as LY
    images = spark.createDataFrame([(1, 900, 1600)], "image_id int, height int, width int")
    placed = spark.createDataFrame([(1, 1, "manual", "buyer_name", "Missing")], "image_id int, seq int, section string, field string, label string")
    on, off = (LY.cell_values(placed, images, d).first() for d in (K.CORRECT, None))
    assert on["a__buyer_name"] == K.CORRECT and off["a__buyer_name"] is None
    headers = spark.createDataFrame([(1, "7", "Ann")], "image_id int, call_id string, auditor string")
    row = LY.compare_screens(LY.cell_values(placed, images, None), headers).first()
    assert row["buyer_name_match"] is None and row.compared_fields == 0


def test_headers_of_any_length(spark, tmp_path):
    from auditlens.operators import layout as LY
    df = spark.createDataFrame([(i, "header", s, f"t{s}") for i in (1, 2) for s in range(2500 * i)], "image_id int, region string, seq int, text string")
    plain, blocks = ({r.image_id: r.header for r in LY.header_text(df, *p).collect()} for p in ((), (str(tmp_path / "h"),)))
    assert plain == blocks
