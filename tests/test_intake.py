"""CSV intake: header spellings per file, rejected records, stable columns."""
import pytest

from auditlens.plans import jobs
from auditlens.plans.audit_job import AuditReport
from auditlens.sources.audits import default_inputs, read_audits
from auditlens.sources.csv import read_csv, scan_csv


def put(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_bytes(text.encode())
    return str(folder)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_three_spellings_fill_one_column(spark, tmp_path):
    path = put(tmp_path, a="Call ID,Verdict,buyername\n1,Yes,Correct\n", b="Verdict,BUYERNAME_,Call_ID\nno,Missing,2\n",
               c="Buyer Name,Buyer Name Reason,CallId\nInferred,why,3.0\n")
    files = read_audits(spark, path)
    assert rows_of(files.rows, "call_id", "verdict", "buyer_name") == [("1", "Yes", "Correct"), ("2", "no", "Missing"), ("3.0", None, "Inferred")]
    rep = AuditReport(files.rows, files.rows)
    assert rows_of(rep.table("binary_comparison"), "call_id") == [("1",), ("2",), ("3",)]  # the file without a verdict is not filtered
    summary = {r.field_name: r.total_calls for r in rep.table("ai_summary").collect()}
    assert summary["Buyer Name"] == 3 and summary["Reminder"] == 0
    mapped = {(r.variant, r.field): r.header for r in files.header_map.collect()}
    assert [mapped[v, "buyer_name"] for v in range(3)] == ["Buyer Name", "buyername", "BUYERNAME_"]


def test_field_of_some_files_counts_only_their_rows(spark, tmp_path):
    path = put(tmp_path, a="Call ID,Reminder\n1,Correct\n2,\n", b="Call ID,Lead Tag\n3,Missing\n")
    rep = AuditReport(*[read_audits(spark, path).rows] * 2)
    got = {r.field_name: (r.total_calls, r.correct_nd) for r in rep.table("manual_summary").collect()}
    assert got["Reminder"] == (2, 1) and got["Lead Tag"] == (1, 0)


def test_file_without_call_id_is_named(spark, tmp_path):
    with pytest.raises(ValueError, match="Name"):
        read_audits(spark, put(tmp_path, a="Call ID,Verdict\n1,Yes\n", b="Name,Verdict\nx,Yes\n"))


def test_surplus_and_blank_header_cells_are_accounted_for(spark, tmp_path):
    path = put(tmp_path, a='Call ID,Verdict,\n1,Yes,kept\n2,No,x,extra\n3,no\n4,yes,,,\n5,"a,b\nc",d,"say ""hi"""\n\n6,q\n')
    scan = scan_csv(spark, path)
    assert scan.headers == [["Call ID", "Verdict", "Unnamed: 2"]]
    assert rows_of(scan.by_name().fillna("-"), "Call ID", "Verdict", "Unnamed: 2") == [
        ("1", "Yes", "kept"), ("3", "no", "-"), ("4", "yes", "-"), ("6", "q", "-")]
    assert rows_of(scan.rejects(), "pos", "reason", "n_cells", "n_header", "raw") == [
        (2, "surplus cells", 4, 3, "2,No,x,extra"), (5, "surplus cells", 4, 3, '5,"a,b\nc",d,"say ""hi"""')]
    assert rows_of(scan.counts(), "records", "good", "rejected") == [(6, 4, 2)]
    strict = scan_csv(spark, path, short_rows="reject")
    assert rows_of(strict.rejects(), "pos", "reason") == [(2, "surplus cells"), (3, "missing cells"), (5, "surplus cells"), (6, "missing cells")]
    assert strict.rejects().count() + strict.good().count() == strict.rows.count() == 6


def test_surplus_in_a_narrow_file_next_to_a_wide_one(spark, tmp_path):
    path = put(tmp_path, a="x,y\n1,2\n3,4,5\n6,7,\n", b="x,y,z,w\n1,2,3,4\n1,2,3,4,5\n")
    scan = scan_csv(spark, path)
    assert sorted(r.raw for r in scan.rejects().collect()) == ["1,2,3,4,5", "3,4,5"]
    assert scan.by_name().columns == ["x", "y", "z", "w", "_seq"] and scan.good().count() == 3


def test_plain_read_refuses_surplus_cells(spark, tmp_path):
    path = put(tmp_path, a="x,y\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="3,4,5"):
        read_csv(spark, path).count()


def test_columns_do_not_depend_on_the_run(spark, tmp_path):
    names = [chr(97 + k) for k in range(12)]
    path = put(tmp_path, **{n: f"id,{n},{n.upper()}x\n1,2,3\n" for n in names})
    assert len({tuple(read_csv(spark, path).columns) for _ in range(3)}) == 1
    assert scan_csv(spark, path).headers == [["id", n, f"{n.upper()}x"] for n in names]


def test_aliases_of_several_files_are_one_column(spark, tmp_path):
    path = put(tmp_path, a="Call ID,Transcript\n1,a\n", b="call_id,transcript\n2,b\n", c="CallID,other\n3,c\n")
    df = read_csv(spark, path, unify=[["Call ID", "call_id", "CallID"], ["Transcript", "transcript"]])
    assert rows_of(df.fillna("-"), "Call ID", "Transcript") == [("1", "a"), ("2", "b"), ("3", "-")]


def test_audit_job_writes_intake_tables(spark, tmp_path):
    (tmp_path / "m").mkdir()
    manual = put(tmp_path / "m", a="Call ID,Verdict,Buyer Name\n1,Yes,Correct\n", b="Call_ID,Verdict,BUYERNAME\n2,Yes,Missing\n9,Yes,x,y\n")
    ai = put(tmp_path, ai="Call ID,Verdict,Buyer Name\n1,yes,Correct\n2,yes,Correct\n")
    out = jobs.run_audit(spark, manual, f"{ai}/ai.csv", str(tmp_path / "out"))
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert rows_of(read("binary_comparison"), "call_id", "buyer_name") == [("1", 1), ("2", 0)]
    assert rows_of(read("rejects"), "side", "raw") == [("manual", "9,Yes,x,y")]
    assert sum(r.records for r in read("intake").collect()) == 5
    line = {r.side: r.overall_line for r in read("overall").collect()}
    assert line["manual"].startswith("Total correct = 1 Total calls fields = 2")


def test_default_input_names(spark, tmp_path):
    put(tmp_path, **{"Manual Audits": "a\n", "AI Audits": "a\n"})
    assert default_inputs(spark, None, None, str(tmp_path)) == (f"{tmp_path}/Manual Audits.csv", f"{tmp_path}/AI Audits.csv")
    assert default_inputs(spark, "x.csv", None, str(tmp_path))[0] == "x.csv"
    with pytest.raises(ValueError):
        default_inputs(spark, None, None, str(tmp_path / "none"))
