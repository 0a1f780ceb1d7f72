"""Incremental reports, dense numbers, metrics lines, resumable calls and ordered texts."""
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.operators.fanout import RetryPolicy
from auditlens.operators.ledger import call_once
from auditlens.operators.model_metrics import model_metrics
from auditlens.operators.numbering import dense_numbers
from auditlens.operators.ordered_text import ordered_text
from auditlens.plans.audit_job import AuditReport
from auditlens.plans.incremental_audit import IncrementalAudit
from auditlens.sources import sinks

HEADERS = {"manual": ["Call ID", "Auditor", "Verdict", "Buyer Name", "Reminder"], "ai": ["Call ID", "Verdict", "buyername", "Reminder"]}
LABELS = ["Correct", "Missing", "Hallucination", "Inferred", "-", None, "odd"]


def audits(spark, side, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in HEADERS[side]) + ", _seq long")


def random_rows(rng, side, n, first):
    wide = len(HEADERS[side])
    out = []
    for k in range(n):
        row = [rng.choice([None, "7.0", *map(str, range(12))]), "Ann", rng.choice(["Yes", "no", "Skipped", None]), rng.choice(LABELS), rng.choice(LABELS)]
        out.append((*(row if wide == 5 else [row[0], *row[2:]]), first + k))
    return out


def table(df):
    return sorted(str(r.asDict()) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("policy, unknown", [("match", K.CORRECT), ("exclude", None)])
def test_batches_add_up_to_a_full_run(spark, tmp_path, policy, unknown):
    rng = random.Random(policy)
    report = IncrementalAudit(spark, str(tmp_path / "r"), buckets=4, blank_policy=policy, unknown_label=unknown)
    seen = {"manual": [], "ai": []}
    for k, (n_manual, n_ai) in enumerate([(9, 7), (0, 6), (12, 0), (8, 8)]):
        batch = {side: random_rows(rng, side, n, 1000 * k) for side, n in (("manual", n_manual), ("ai", n_ai))}
        report.append(*[audits(spark, side, batch[side]) for side in ("manual", "ai")])
        for side in seen:
            seen[side] += batch[side]
        if k == 1:
            report.compact()
        full = AuditReport(*[audits(spark, side, seen[side]) for side in ("manual", "ai")], policy, unknown)
        if k in (1, 3):
            assert table(report.statistics()) == table(full.table("summary_statistics"))
            assert table(report.summary("manual")) == table(full.table("manual_summary"))
            assert table(report.summary("ai")) == table(full.table("ai_summary"))


def test_a_killed_batch_counts_nothing(spark, tmp_path, monkeypatch):
    report = IncrementalAudit(spark, str(tmp_path / "r"), buckets=2)
    one = [audits(spark, side, random_rows(random.Random(side), side, 6, 0)) for side in ("manual", "ai")]
    report.append(*one)
    before = table(report.statistics())
    with monkeypatch.context() as m:
        m.setattr(sinks, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            report.append(*one)
    assert table(report.statistics()) == before and len(sinks.versions(spark, str(tmp_path / "r"))) == 1


def test_only_touched_buckets_are_read(spark, tmp_path):
    report = IncrementalAudit(spark, str(tmp_path / "r"), buckets=16)
    rows = [(str(k), "a", "Yes", "Correct", None, k) for k in range(200)]
    ai = [(str(k), "Yes", "Missing", None, k) for k in range(200)]
    first = report.append(audits(spark, "manual", rows), audits(spark, "ai", ai))
    mine = spark.range(1).select(F.pmod(F.xxhash64(F.lit("7")), F.lit(16))).first()[0]
    for name in os.listdir(f"{first}/rows"):
        if name.startswith("bucket=") and name != f"bucket={mine}":
            for f in os.listdir(f"{first}/rows/{name}"):
                if f.endswith(".parquet"):
                    os.truncate(f"{first}/rows/{name}/{f}", 3)
                    os.remove(f"{first}/rows/{name}/.{f}.crc")
    # the schema of the stored rows comes from a footer that may be broken now
    spark_read = report._stored
    report._stored = lambda done: spark.read.schema(f"{', '.join(f'{c} string' for c in ['side', 'call_id', 'auditor', *K.FIELDS])}, batch long, bucket int").parquet(f"{first}/rows")
    report.append(audits(spark, "manual", [("7", "a", "Yes", "Missing", None, 1)]), audits(spark, "ai", []))
    got = {r.field_name: r.matched_calls for r in report.statistics().collect()}
    assert got["Buyer Name"] == 1 and callable(spark_read)


def test_dense_numbers_follow_the_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(50), rng.random(), "x") for _ in range(3000)] + [(None, 0.5, "x")]
    df = spark.createDataFrame(rows, "a int, b double, _at string").repartition(13)
    got = dense_numbers(df, ["a", F.col("b").desc()], str(tmp_path / "n"), "id", start=1).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 3002))
    assert [(r.a, r.b) for r in got] == sorted(((a, b) for a, b, _ in rows), key=lambda r: (r[0] is not None, r[0], -r[1]))
    assert dense_numbers(df.limit(0), ["a"], str(tmp_path / "e")).count() == 0


def test_metrics_rows_and_summary_lines(spark, tmp_path):
    rows = [(0, "m", 10, 1, 11, 0.5, 1.0), (1, "m", None, None, None, None, 3.0), (2, "m", 20, 3, 23, 1.5, None), (0, "k", None, None, None, None, 2.0)]
    df = spark.createDataFrame(rows, "row_id long, model string, prompt_tokens long, completion_tokens long, total_tokens long, cost double, latency double")
    got = {}
    for r in model_metrics(df, str(tmp_path / "m"), ["m", "k", "none"]).orderBy("model", "sheet_row").collect():
        got.setdefault(r.model, []).append((r.sheet_row, r.label, *[round(x, 9) for x in (r.prompt_tokens, r.completion_tokens, r.total_tokens, r.cost, r.latency) if x is not None]))
    assert got["m"][:3] == [(2, "1", 10.0, 1.0, 11.0, 0.5, 1.0), (3, "2", 3.0), (4, "3", 20.0, 3.0, 23.0, 1.5)]
    assert got["m"][3:] == [(6, "Average Prompt Tokens", 15.0), (7, "Average Completion Tokens", 2.0), (8, "Average Total Tokens", 17.0),
                            (9, "Average Estimated Cost", 1.0), (10, "Average Latency", 2.0), (11, "P95 Latency", 2.9), (12, "Maximum Latency", 3.0),
                            (13, "Minimum Latency", 1.0), (14, "Standard Deviation Latency", round(2 ** 0.5, 9))]
    assert got["k"][-1] == (12, "Standard Deviation Latency") and got["k"][1] == (4, "Average Prompt Tokens")
    assert [r for r in got["none"] if len(r) > 2] == [(9, "Maximum Latency", 0.0), (10, "Minimum Latency", 0.0)] and len(got["none"]) == 9


def tasks(spark, n):
    return spark.createDataFrame([(k, "m", "sys", f"p{k}") for k in range(n)], "row_id long, model string, system_prompt string, user_prompt string")


def calls_of(folder):
    return sorted(open(f"{folder}/{f}").read() for f in os.listdir(folder))


def logging_client(folder, die_at=None):
    """Answers after it has left a file per call; the worker dies once, before the call ``die_at``."""
    def client(model, system, user):
        if user == die_at and not os.path.exists(f"{folder}.died"):
            open(f"{folder}.died", "w").close()
            os._exit(1)
        with open(f"{folder}/{time.time_ns()}-{user}", "w") as f:
            f.write(user)
        return {"response": f"re {user}", "prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}

    return client


def test_finished_calls_are_not_repeated(spark, tmp_path):
    log = str(tmp_path / "log")
    os.mkdir(log)
    ledger = str(tmp_path / "ledger")
    run = lambda n, **kw: call_once(tasks(spark, n), logging_client(log), ledger, partitions=2, **kw)
    first = run(10)
    assert sorted((r.row_id, r.response, r.status) for r in first.collect()) == [(k, f"re p{k}", K.SUCCESS_STATUS) for k in range(10)]
    assert run(14, threads=2, slice_size=3).count() == 14 and run(5).count() == 5
    assert calls_of(log) == sorted(f"p{k}" for k in range(14))
    changed = tasks(spark, 2).withColumn("system_prompt", F.lit("other"))
    assert call_once(changed, logging_client(log), ledger, partitions=2).count() == 2 and len(calls_of(log)) == 16


def test_a_killed_task_repeats_no_finished_call(spark, tmp_path):
    log = str(tmp_path / "log")
    os.mkdir(log)
    args = (tasks(spark, 30), logging_client(log, die_at="p17"), str(tmp_path / "ledger"))
    with pytest.raises(Exception):
        call_once(*args, partitions=1, threads=1, slice_size=1)
    done = len(calls_of(log))
    assert 0 < done < 30
    assert call_once(*args, partitions=1, threads=1, slice_size=1).count() == 30
    assert calls_of(log) == sorted(f"p{k}" for k in range(30))


def test_failed_calls_are_finished_and_a_broken_slice_keeps_the_rest(spark, tmp_path):
    def client(model, system, user):
        raise TimeoutError

    policy = RetryPolicy(attempts=2, backoff=0.0, sleep=lambda s: None)
    got = call_once(tasks(spark, 3), client, str(tmp_path / "l"), partitions=1, policy=policy).collect()
    assert {(r.response, r.status, r.prompt_tokens) for r in got} == {(K.ERROR_RESPONSE, K.FAILED_STATUS, None)}
    assert call_once(tasks(spark, 3), logging_client("/nowhere"), str(tmp_path / "l"), partitions=1).count() == 3


@pytest.mark.parametrize("block", [7, 1000])
def test_ordered_texts_of_any_length(spark, tmp_path, block):
    n = 1000 if block == 7 else 100_000
    long = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.concat(F.lit("turn "), F.col("id").cast("string")).alias("x"))
    rest = spark.createDataFrame([(2, 5, "b"), (2, 1, "a"), (2, 3, None), (3, 1, None), (4, 9, ""), (4, 10, "z")], "k int, t long, x string")
    got = {r.k: r.text for r in ordered_text(long.unionByName(rest).repartition(9), ["k"], ["t"], "x", "|", str(tmp_path / "o"), block=block).collect()}
    assert got == {1: "|".join(f"turn {i}" for i in range(n)), 2: "a|b", 4: "|z"}
