"""Rows that the dedup operators make of a very common line and of a group just below the threshold."""
import random

from pyspark.sql import functions as F

from auditlens.llm import line_dedup, minhash_dedup
from test_llm_dedup import frame, groups


def test_a_common_line_makes_one_row_per_text(spark, tmp_path):
    common = "all rights reserved by the owner of this page"
    rows = [(i, "\n".join([f"page {i} starts with its own line {i * 7}"] + [common] * 50 + [f"page {i} ends here {i * 11}"])) for i in range(20)]
    folder = str(tmp_path / "lines")
    runs = {r.doc_id: [(x.s, x.e) for x in r.runs] for r in line_dedup.repeated_runs(frame(spark, rows), folder).collect()}
    assert spark.read.parquet(f"{folder}/stretches").count() <= len(rows)
    ranges = spark.read.parquet(f"{folder}/stretches").select(F.size("ranges").alias("n")).agg(F.sum("n")).head()[0]
    assert ranges <= 4 * len(rows), "a range of an earlier text once per text, not once per repeated line"
    # the first page keeps some of its common lines, the others few; no line of their own goes
    assert 1 < runs[0][0][0] < 10 and runs[0][-1][1] == 50
    for i in range(1, 20):
        assert len(runs[i]) == 1 and 1 <= runs[i][0][0] <= 3 and 48 <= runs[i][0][1] <= 50, runs[i]


def test_pairs_below_the_threshold_stay_in_their_block(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(168)]
    rows = []
    for i in range(60):
        text = list(base)
        for part in range(3):  # about 0.69 alike
            text[part * 56 + 5 + rnd.randrange(45)] = f"x{i}y{part}"
        rows.append((i, " ".join(text)))
    folder = str(tmp_path / "near")
    monkeypatch.setattr(minhash_dedup.store, "scratch", lambda spark, name: folder)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == groups(rows)
    assert spark.read.parquet(f"{folder}/cross-pairs").count() < 700
