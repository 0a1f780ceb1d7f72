"""Line dedup cuts every text once, whatever characters it holds, and finds stretches in blocks of lines."""
import random

from pyspark.sql import functions as F

from auditlens.llm import line_dedup
from test_llm_dedup import filler, frame


def distinct_lines(seed, n):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(4, 9))) + rng.choice(".,!;") for _ in range(n)]


def test_texts_are_cut_once(spark, monkeypatch):
    calls, cut = [], line_dedup._cut
    monkeypatch.setattr(line_dedup, "_cut", lambda text: calls.append(1) or cut(text))
    passage = " ".join(distinct_lines(1, 20))
    rows = [(1, filler(1) + " " + passage), (2, filler(2) + "\n" + passage + " " + filler(3))]
    out = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: filler(2) + " " + filler(3)}
    assert len(calls) == 1, "lines are cut once and staged, for the boundaries, the comparison and the removal"


def test_texts_that_hold_the_marks_of_cut_texts(spark):
    odd = ["\x01", "\x02", "\x02A", "\x02B", "\x01\x02", "\x02\x01B", "A\x01 \x02. \x01\nB"]
    passage = " ".join(f"{x} {y}" for x, y in zip(distinct_lines(2, 21), odd * 3))
    texts = odd + [passage, f"\x01{filler(4)} {passage}\n{filler(5)}\x02"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", line_dedup.lines_of(F.col("text")).alias("x")).collect()
    assert all("".join(r.x) == r.text for r in got)
    out = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame(spark, enumerate(texts))).collect()}
    assert all(out[i] == t for i, t in enumerate(texts[:-1]))
    assert out[len(texts) - 1] == f"\x01{filler(4)}\n{filler(5)}\x02"


def test_stretches_of_a_block_match_brute_force(spark):
    rng = random.Random(3)
    sets = [{k} for k in (0, 15, 31)] + [set(rng.sample(range(32), n)) for n in range(1, 33)]
    rows = [(i, sum(1 << k for k in x), 7) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "mark0 long, bits long, block int").withColumns({"id0": F.lit(1), "shift": F.lit(2)})
    for r in df.select("mark0", line_dedup._parts().alias("x")).collect():
        want = []
        for k in sorted(sets[r.mark0]):
            if want and k - want[-1][1] <= line_dedup.WINDOW:
                want[-1][1] = k
            else:
                want.append([k, k])
        assert [[p.a - 224, p.b - 224] for p in r.x] == want


def test_long_copies_go_over_blocks(spark):
    """Passages over many blocks of lines, also where single lines of the copy differ."""
    lines = distinct_lines(4, 150)
    other = [x if i % 40 != 20 else f"own line {i}." for i, x in enumerate(lines)]
    rows = [(None, filler(6) + " " + " ".join(lines)), (5, filler(7) + " " + " ".join(lines)), (6, filler(8) + " " + " ".join(other)), (6, None)]
    out = {(r.doc_id, r.text) for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    own = " ".join(f"own line {i}." for i in (20, 60, 100, 140))
    assert (None, rows[0][1]) in out and (5, filler(7)) in out and (6, None) in out
    assert [t for i, t in out if i == 6 and t] == [filler(8) + " " + own]
