"""Near-dedup and line dedup against brute force, and their defined edge results."""
import random

import duckdb
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from auditlens.llm import line_dedup, minhash_dedup, store
from auditlens.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], SCHEMA)


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows):
    """Smallest reachable id of every id, by comparing all pairs that share a shingle."""
    sets, root = {}, {}
    for i, t in rows:
        sets[i] = grams(t)
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[n + 1:]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_groups(spark, rows):
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    want = groups(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_match_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF001}/documents.parquet'").fetchall()
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    chain = []
    for step in range(12):  # neighbours are alike, the ends are not
        base = base[:]
        base[step * 9] = f"edit{step}"
        chain.append((10_000 + step, " ".join(base)))
    shared = [f"p{k}" for k in range(60)]
    template = [(11_000 + k, " ".join(shared + [f"t{k // 3}-{j}" for j in range(30)] + ([f"z{k}"] if k % 3 else []))) for k in range(30)]
    check_groups(spark, rows + chain + template)


def test_near_duplicates_edges(spark):
    check_groups(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (7, "é É"), (8, "É É")])
    df = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A b c d e f")])
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    left = minhash_dedup.keep_one(df)
    assert left.columns == df.columns and sorted(r.doc_id or -1 for r in left.collect()) == [-1, -1, 1, 1]
    assert minhash_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components_reach_the_smallest_id(spark):
    pairs = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 300), (150, 300)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.u: r.component for r in components(df, store.scratch(spark, "t")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in (100, 150, 200, 300)}


@pytest.fixture(scope="module")
def passage():
    rng = random.Random(7)
    return " ".join(" ".join(f"w{rng.randrange(10**5)}" for _ in range(6)) + rng.choice(".,") for _ in range(14))


def filler(seed, n=12):
    rng = random.Random(seed)
    return " ".join(f"f{rng.randrange(10**6)}" for _ in range(n)) + "."


def test_repeated_passage_goes_wherever_it_stands(spark, passage):
    rows = [(1, filler(1) + "\n" + passage + "\n" + filler(2)), (2, filler(3) + " " + passage + " " + filler(4)),
            (3, passage), (4, filler(5) + "\n" + filler(6)), (5, None), (6, ""), (7, filler(7, 1) * 3)]
    df = frame(spark, rows)
    out = {r.doc_id: r for r in line_dedup.remove_repeats(df).collect()}
    assert out[1].text == rows[0][1] and out[1]._removed == 0
    assert passage not in out[2].text and out[2].text.startswith(filler(3)) and out[2].text.endswith(filler(4))
    assert out[2].n_chars == len(out[2].text) and len(out[2].text) < len(filler(3)) + len(filler(4)) + 60
    assert [out[k].text for k in (4, 5, 6, 7)] == [dict(rows)[k] for k in (4, 5, 6, 7)]
    kept = line_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6, 7]


def test_short_repeats_and_repeated_rows_stay(spark, passage):
    short = "alpha beta. gamma delta, epsilon zeta."
    rows = [(1, filler(1) + " " + short + " " + filler(2)), (2, filler(3) + " " + short + " " + filler(4)), (3, passage), (3, passage)]
    out = line_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted(rows)
    assert line_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_equal_lines_are_told_apart_by_their_bytes(spark, passage):
    """Lines that differ by one character are not removed."""
    other = passage.replace("w1", "w9")
    rows = [(1, passage), (2, other)]
    out = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert out[1] == passage
    for piece in other.replace(",", ".").split("."):
        if piece.strip() and piece.strip() not in passage.replace(",", "."):
            assert piece.strip() in out[2]


def test_line_dedup_leaves_few_long_repeats(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    out = line_dedup.remove_repeats(df)

    def shared(rows):
        seen = {}
        for r in rows:
            w = (r.text or "").split()
            for k in range(len(w) - 59):
                seen.setdefault(tuple(w[k:k + 60]), set()).add(r.doc_id)
        return sum(len(v) > 1 for v in seen.values())

    before, after = shared(df.collect()), shared(out.collect())
    assert before > 0 and after <= 0.03 * before


def test_short_passages_in_running_text_go(spark):
    """Passages of 3 to 8 lines, marks of every kind, between other lines of the same paragraph."""
    rng = random.Random(11)
    rows, planted = [], {}
    for k, n in enumerate([3, 4, 5, 6, 7, 8] * 3):
        text = " ".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(-(-54 // n))) + rng.choice(".,!:") for _ in range(n))
        rows += [(2 * k, filler(100 + 4 * k) + " " + text + " " + filler(101 + 4 * k)),
                 (2 * k + 1, filler(102 + 4 * k) + " " + text + " " + filler(103 + 4 * k))]
        planted[2 * k + 1] = filler(102 + 4 * k) + " " + filler(103 + 4 * k)
    out = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert {i: out[i] for i in planted} == planted
    assert all(out[i] == t for i, t in rows if i not in planted)


def test_passages_of_one_long_line_go(spark):
    """Whole pieces of a line without marks go, whatever stands around them."""
    rng = random.Random(12)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    rows = [(k, " ".join(f"f{rng.randrange(10**6)}" for _ in range(20)) + " " + text + " " + " ".join(f"f{rng.randrange(10**6)}" for _ in range(20)))
            for k in range(3)]
    out = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert out[0] == rows[0][1] and all(len(out[k].split()) <= 40 + 32 for k in (1, 2))


def test_lines_end_at_every_mark(spark):
    got = spark.sql("SELECT 'a! b: c, d? e; f. g' AS text").select(line_dedup.lines_of(F.col("text")).alias("x")).head().x
    assert got == ["a!", " b:", " c,", " d?", " e;", " f.", " g"]


def test_flat_stretches_at_the_ends_go(spark, passage):
    """More equal lines than any fixed reach at both ends of a repeated passage."""
    flat = "\n".join(["| 0 | 0 |"] * 40)
    rows = [(1, filler(1) + "\n" + flat + "\n" + passage + "\n" + flat + "\n" + filler(2)),
            (2, filler(3) + "\n" + flat + "\n" + passage + "\n" + flat + "\n" + filler(4))]
    out = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert out[2] == filler(3) + "\n" + filler(4)
    assert passage in out[1] and "| 0 | 0 |\n| 0 | 0 |" in out[1]


def test_long_passages_are_gone_from_the_whole_table(spark):
    """Maximal passages of 50 words and more that an earlier document holds, each counted once."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: (r.text or "").split() for r in line_dedup.remove_repeats(df).collect()}

    def windows(w):
        return [tuple(w[k:k + 50]) for k in range(len(w) - 49)]

    seen, passages, left = set(), 0, 0
    for i, text in sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()):
        own, rest = windows(text.split()), set(windows(out[i]))
        hit = [x in seen for x in own] + [False]
        for k, h in enumerate(hit[:-1]):
            if h and (k == 0 or not hit[k - 1]):
                passages += 1
                left += any(x in rest for x in own[k:hit.index(False, k)])
        seen.update(own)
    assert passages > 100 and left <= 0.03 * passages


def lines_by_hand(text):
    """The rule of ``lines_of`` for texts whose lines are short."""
    out, at = [], 0
    for k in range(1, len(text)):
        if text[k] == "\n" or text[k] == " " and text[k - 1] in ".!?;:,":
            out.append(text[at:k])
            at = k
    return out + [text[at:]]


def runs_by_hand(rows, min_words):
    """Texts without the lines of maximal matches with an earlier place, of ``WINDOW`` + 1 lines and more."""
    least = line_dedup.WINDOW + 1
    lines = {i: lines_by_hand(t) for i, t in rows}
    bare = {i: [x if k == 0 else x[1:] for k, x in enumerate(a)] for i, a in lines.items()}
    gone = {i: set() for i in lines}
    for i in sorted(bare):
        for j in sorted(bare):
            if j >= i:
                continue
            for shift in range(-len(bare[j]), len(bare[i])):
                run = []
                for k in range(len(bare[i]) + 1):
                    if k < len(bare[i]) and 0 <= k - shift < len(bare[j]) and bare[i][k] == bare[j][k - shift]:
                        run.append(k)
                        continue
                    if len(run) >= least:
                        gone[i].update(run)
                    run = []
    out = {}
    for i, a in lines.items():
        left, k = [], 0
        while k < len(a):
            e = k
            while e < len(a) and e in gone[i]:
                e += 1
            if e > k and sum(len(x.split()) for x in a[k:e]) >= min_words:
                k = e
                continue
            left += a[k:max(e, k + 1)]
            k = max(e, k + 1)
        out[i] = "".join(left)
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_long_matches_match_brute_force(spark, whole):
    """Texts mixed from shared stretches of distinct lines: what has ``WINDOW`` + 1 lines in common goes, as by hand. Of parts
    of stretches, cut anew each time, a few lines at the ends may stay: a boundary is followed in its first surroundings only."""
    rng = random.Random(21)
    word = iter(range(10 ** 6))
    fresh = lambda: " ".join(f"w{next(word)}" for _ in range(rng.randrange(3, 9))) + rng.choice(".,!;")
    pool = [[fresh() for _ in range(rng.randrange(4, 12))] for _ in range(12)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            stretch = rng.choice(pool)
            a = 0 if whole else rng.randrange(len(stretch) - 3)
            b = len(stretch) if whole else rng.randrange(a + 4, len(stretch) + 1)
            parts += [fresh() for _ in range(rng.randrange(1, 4))] + stretch[a:b]
        rows.append((i, " ".join(parts + [fresh()])))
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(frame(spark, rows), 12).collect()}
    want = runs_by_hand(rows, 12)
    # matches inside one text, and shorter ones that a chosen boundary happens to meet, may take more; never less
    assert sum(len(want[i]) < len(t) for i, t in rows) > 20
    size = lambda texts: [len(t.split()) for _, t in sorted(texts.items())]
    if whole:
        assert all(g <= w for g, w in zip(size(got), size(want)))
    else:
        gone, due = sum(size(dict(rows))) - sum(size(got)), sum(size(dict(rows))) - sum(size(want))
        assert gone >= 0.95 * due
    earlier = set()
    for i, t in rows:  # whatever went has a copy at an earlier place, or earlier in its own text
        a = lines_by_hand(t)
        own = [x.strip() for x in a]
        kept = {x.strip() for x in lines_by_hand(got[i])}
        assert all(x in earlier or x in kept for x in own)
        earlier.update(own)


CLASHES = ["_id", "_some", "_removed", "_mark", "row", "runs", "mark", "some", "hash", "s", "removed", "done", "r_id", "lines", "text0", "_gone"]


def test_columns_of_any_name_pass_through(spark, passage):
    df = frame(spark, [(1, passage), (2, filler(3) + " " + passage), (3, None)])
    wide = df.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES if c not in df.columns])
    out = line_dedup.keep_first(wide)
    assert out.columns == wide.columns
    for r in out.collect():
        assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHES if c not in df.columns) and r["hash"] == "x"


def test_lines_and_their_hashes_do_not_depend_on_what_stands_before(spark):
    rng = random.Random(5)
    words = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(40))
    texts = [words, "x. " + words, "x\n" + words, "x\x01.\n" + words + ", y\n z\n\nq", "\n" + words, " ", "", "a", words.replace(" ", "\t")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select(
        "i", "text", line_dedup.lines_of(F.col("text")).alias("a"), line_dedup._line_hashes(F.col("text")).alias("h"))
    got = {r.i: r for r in df.collect()}
    for r in got.values():
        assert "".join(r.a) == r.text and len(r.a) == len(r.h)
    bare = {i: [x if k == 0 else x[1:] for k, x in enumerate(r.a)] for i, r in got.items()}
    assert len(bare[0]) > 3 and bare[1][1:] == bare[2][1:] == bare[0] and bare[4][1:] == bare[0]
    assert got[1].h[1:] == got[2].h[1:] == got[0].h == got[4].h[1:]
    seen = {}
    for i, r in got.items():  # equal lines have equal hashes, and different ones different hashes
        for x, h in zip(bare[i], r.h):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
