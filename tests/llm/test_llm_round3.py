"""Importance resampling, tree search and periodic runs against brute force, and their defined edge results."""
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001

from auditlens.llm import ann_tree, importance, periodic_runs

SCHEMA = "doc_id long, text string, n long, weight string, rank int, _at string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", 2, "x") for i, t in rows], SCHEMA)


def plain_words(text):
    return [w for w in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in
                               "".join(c.lower() if c.isascii() else c for c in text or "")).split(" ") if w]


def resampled(docs, target, per_cent, min_words, buckets, runs):
    def features(text):
        w = plain_words(text)
        return [" ".join(w[k:k + r]) for r in range(1, runs + 1) for k in range(len(w) - r + 1)]

    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for x in features(t):
                out[zlib.crc32(x.encode()) % buckets] += 1
        return out

    s, t = counts([x for _, x in docs]), counts(target)
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (sum(s) + buckets)) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        x = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, len(plain_words(text)) >= min_words])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[:per_cent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(str, (r[:5] for r in rows)))


def test_crc_matrices_match_zlib():
    rng = random.Random(1)
    items = [b"", b"a", bytes(range(256)), b"x" * 5000] + [rng.randbytes(rng.randrange(40)) for _ in range(300)]
    data = np.frombuffer(b"".join(items), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in items])))
    assert importance.crc_by_length(data, offsets).tolist() == [zlib.crc32(x) for x in items]


@pytest.mark.parametrize("runs", [1, 3])
def test_features_match_plain_words(runs):
    texts = ["One, two  THREE", "", None, "é1 ÜX _a_", "a", "b c", "中文 x\x7fy\u0080z"]
    got = {}
    for per_text, codes, crc in importance.features(pa.array(texts)[1:], runs):
        ends = np.cumsum(per_text)
        for k, (n, e) in enumerate(zip(per_text, ends)):
            got.setdefault(k, []).extend(crc[codes[e - n:e]].tolist())
    for k, t in enumerate(texts[1:]):
        w = plain_words(t)
        assert got[k] == [zlib.crc32(" ".join(w[i:i + r]).encode()) for r in range(1, runs + 1) for i in range(len(w) - r + 1)]


@pytest.mark.parametrize("buckets, runs", [(10_000, 1), (64, 2)])
def test_resampling_matches_brute_force(spark, buckets, runs):
    docs = duckdb.sql(f"select doc_id, text from '{SF001}/documents.parquet'").fetchall()
    target = [t for t, in duckdb.sql(f"select text from '{SF001}/benchmark.parquet'").fetchall()]
    docs += [(None, "a b c d e f"), (7, None), (7, ""), (7, "long " * 30000), (9, "Ä ß " * 15)]
    got = importance.resample(frame(spark, docs), frame(spark, list(enumerate(target))), 25, 5, buckets, runs)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in got.collect()) == resampled(docs, target, 25, 5, buckets, runs)


def test_resampling_of_empty_tables(spark):
    none = frame(spark, [])
    assert importance.resample(none, none).count() == 0
    got = importance.resample(frame(spark, [(k, "same words here") for k in (3, 1, 1, 2)]), none, 50, 1).collect()
    assert sorted(r["rank"] or 0 for r in got) == [0, 0, 1, 2] and {r.n_features for r in got} == {3}


# --- nearest neighbours -----------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, leaf string, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], VECTORS)


def brute_nearest(rows, every, k):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], np.float32).astype(float)
    out = {}
    for i, q in zip(ids, v):
        if i % every == 0:
            score = np.zeros(len(v))
            for d in range(v.shape[1]):
                score += q[d] * v[:, d]
            out[i] = sorted(((-s, j) for s, j in zip(score.tolist(), ids) if j != i))[:k]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_the_whole_table(spark):
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    got, want = answers(ann_tree.op12_ann_search(spark, "/root/testdata/sf0.1")), brute_nearest(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    met = sum(len(set(got[i]) & set(want[i])) for i in want)  # same ids with bit-equal scores
    assert met >= 0.93 * 20 * len(want)


def test_full_visits_are_exact_with_ties_and_a_hot_vector(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1 + k % 5) for _ in range(8)]) for k in range(600)]
    rows += [(600 + k, rows[11][1]) for k in range(500)]  # one vector many times
    got = answers(ann_tree.nearest(vectors(spark, rows), every=50, k=15, recall=1.1))
    assert got == brute_nearest(rows, 50, 15)


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(0, None), (20, []), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [nan, 1.0]), (100, [inf, 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0])]
    good = [(140, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (3, [-1.0, 0.0]), (3, [-2.0, 0.0])]
    got = answers(ann_tree.nearest(vectors(spark, bad + good), k=20))
    assert got == {140: [(-1.0, 2), (-0.5, 1), (2.0, 3)]}  # of the rows with id 3, the smallest vector
    assert ann_tree.nearest(vectors(spark, bad[:6])).count() == 0
    assert ann_tree.nearest(vectors(spark, [])).count() == 0
    assert ann_tree.nearest(vectors(spark, [(0, [1.0])])).count() == 0
    assert ann_tree.nearest(vectors(spark, [(1, [1.0]), (2, [1.0])])).count() == 0  # no query


def test_few_visits_still_fill_the_list(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(400)]
    folder = ann_tree.store.scratch(spark, "t")
    index = ann_tree.build(vectors(spark, rows), folder, leaves=3.0)
    queries = index.rows.filter("vec_id % 20 = 0")
    assert len(index.size) > 10 and sum(index.size) == 400
    assert all(len(x) == 20 for x in answers(ann_tree.search(index, queries, 1, folder, 20)).values())


# --- periodic runs ----------------------------------------------------------------

def brute_runs(w, min_length=24, exponent=3):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, exponent * q):
                if not any(w[i:i + length - p] == w[i + p:i + length] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def expected(text):
    w = [x.decode() for x in (text or "").encode().split()]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def planted(i, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(i).encode())
    if h % 10 or not w:
        return text
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))


def digests(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1, tuple(r)[1:]) for r in df.collect()), key=str)


def test_runs_of_random_words_match_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            n, k = rng.randrange(90), rng.choice([1, 2, 3, 50])
            w = [rng.randrange(k) for _ in range(n)]
            if n > 4 and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + rng.randrange((n - a) // 3 + 1)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
                if rng.random() < 0.3:
                    w[rng.randrange(n)] = 0
            texts.append(w)
        least, e = rng.choice([(24, 3), (6, 2), (9, 3), (4, 4), (1, 2)])
        got = periodic_runs.runs_of(np.array([len(x) for x in texts]), np.array([y for x in texts for y in x], np.int64), least, e)
        by = list(zip(*(x.tolist() for x in got)))
        assert [[r[1:] for r in by if r[0] == i] for i in range(len(texts))] == [brute_runs(w, least, e) for w in texts]


def test_periodic_runs_query_matches_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF001}/documents.parquet'").fetchall()
    got = digests(periodic_runs.op13_periodic_runs(spark, SF001))
    short = [(i, t) for i, t in docs if len((t or "").split()) < 1500]
    want = {i: expected(planted(i, t)) for i, t in short}
    assert len(got) == len(docs) and len(short) > 0.9 * len(docs)
    assert {i: x for i, x in got if i in want} == want
    assert sum(x[0] > 0 for x in want.values()) > 10


def test_periodic_runs_edges(spark):
    rows = [(1, None), (1, ""), (2, " \t\n"), (3, "a " * 23), (4, "a " * 24), (5, "x " + "a b " * 12 + "y"), (6, "É é " * 40), (None, "q w e r t z u i " * 3),
            (7, "a b c " * 30 + "d " * 40), (7, "a b c " * 30 + "d " * 40), (8, "\x0b".join("mnop" * 50)), (9, "w " * 60_000)]
    df = frame(spark, rows)
    got = digests(periodic_runs.run_digests(df))
    want = sorted(((-1 if i is None else i, expected(t)) for i, t in rows if i != 9), key=str)
    assert [x for x in got if x[0] != 9] == want
    assert [x[1][:5] for x in got if x[0] == 9] == [(1, 0, 60_000, 1, 60_000_000)]
    listed = periodic_runs.periodic_runs(df).filter("doc_id = 7").distinct().collect()
    assert sorted(tuple(r)[1:] for r in listed) == brute_runs(rows[8][1].split())
    assert periodic_runs.run_digests(frame(spark, [])).count() == 0
    assert periodic_runs.with_planted_periods(frame(spark, rows)).count() == len(rows)
