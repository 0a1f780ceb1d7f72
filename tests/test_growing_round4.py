"""What a batch of the incremental reports works more than once."""
from auditlens.operators import compare
from auditlens.plans import incremental_audit
from auditlens.plans.audit_job import AuditReport
from auditlens.plans.incremental_audit import IncrementalAudit
from test_growing import audits, table


def test_a_batch_finds_last_rows_once_per_side(spark, tmp_path, monkeypatch):
    manual = [("1", "a", "Yes", "Correct", None, 1), ("1", "b", "Yes", "Missing", None, 2), ("2", "a", "no", "Correct", "-", 3), (None, "a", "Yes", "Correct", None, 4)]
    ai = [("1", "Yes", "Missing", None, 1), ("2", "Yes", "Correct", "Inferred", 2), ("3", "Yes", "Correct", None, 3)]
    later = [("1", "c", "Yes", "Correct", "Missing", 5), ("3", "c", "Yes", "Hallucination", None, 6), ("1", "c", "Yes", None, None, 7)]
    report = IncrementalAudit(spark, str(tmp_path / "r"), buckets=2)
    report.append(audits(spark, "manual", manual), audits(spark, "ai", ai))
    calls = []
    latest, last = compare.latest_calls, incremental_audit._last
    monkeypatch.setattr(compare, "latest_calls", lambda df: calls.append("latest") or latest(df))
    monkeypatch.setattr(incremental_audit, "_last", lambda *a: calls.append("last") or last(*a))
    report.append(audits(spark, "manual", later), audits(spark, "ai", []))
    assert calls == ["latest", "latest"], "stored rows are the last ones already, and a batch is later than all before"
    report.append(audits(spark, "manual", []), audits(spark, "ai", [("1", "Yes", "Missing", "-", 8)]))
    assert calls == ["latest", "latest"] * 2 + ["last"], "of two stored tables, once"
    monkeypatch.undo()
    full = AuditReport(audits(spark, "manual", manual + later), audits(spark, "ai", [*ai, ("1", "Yes", "Missing", "-", 8)]))
    assert table(report.statistics()) == table(full.table("summary_statistics"))
