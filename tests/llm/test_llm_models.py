"""Language id, quality classifier and LM scoring: held-out quality, exact base columns, edges."""
import collections
import math
import zlib

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from auditlens.llm import ftrl, language_id, lm_scoring, quality_classifier, words

SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, label string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def rest(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 1000 and all(r.held_out == (rest(r.doc_id, 3) == 1) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_edges(spark):
    rows = [(k, "the cat and the dog " * 3, "en") for k in range(20)] + [(k, "der hund und die katze " * 3, "de") for k in range(20, 40)]
    rows += [(40, None, "en"), (41, "", None), (42, "123 !?", "de"), (None, "der hund und", None), (3, "the cat and", "en"), (43, "und die " * 300_000, None)]
    out = language_id.identify(frame(spark, rows)).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert len(out) == len(rows) and len(by[3]) == 2
    assert [by[k][0].lang_pred for k in (40, 41, 42)] == ["und"] * 3 and by[40][0].score == 0.0
    assert by[None][0].lang_pred == "de" and by[None][0].held_out is False and by[43][0].lang_pred == "de"
    none = language_id.identify(frame(spark, [(1, "abc", None), (2, None, "en")])).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(frame(spark, [])).count() == 0


def test_long_texts_count_alike_in_slices(monkeypatch):
    text = "Hello, wörld! 12 ab  c\n" * 50
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "SLICE", 7)
    parts = language_id.gram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.quality_scores(docs, labels)
    assert out.count() == 1000
    held = out.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)


def test_quality_edges(spark):
    docs = frame(spark, [(1, None, None), (2, "", None), (2, "good words here", None), (None, "x", None), (9, "a " * 400_000, None)])
    labels = spark.createDataFrame([(1, 0, "z"), (2, None, "z"), (None, 1, "z"), (3, 7, "z")], "doc_id long, quality int, text string")
    out = quality_classifier.quality_scores(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    none = quality_classifier.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns


def test_ftrl_learns_and_sparsifies():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(600):
        y = int(rng.integers(2))
        idx = np.unique(np.append(rng.integers(2, 500, 10), y))
        rows.append((idx, np.ones(len(idx)), y))
    w, t = ftrl.fit(rows, 2, 500, ftrl.Penalty(l1=1.0), 3)
    assert (w == 0).mean() > 0.5 and w[1, 1] > w[0, 1] and w[0, 0] > w[1, 0] and 0.05 <= t <= 20


def lm_by_hand(rows):
    toks = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    c = collections.Counter(w for i, ws in toks if rest(i, 5) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((str(i), rest(i, 5) == 1, len(ws), sum(c[w] > 0 for w in ws), n,
                   round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in toks)


def lm_rows(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())


def test_lm_base_and_gain(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = lm_scoring.lm_scores(docs).cache()
    assert lm_rows(out) == lm_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    held = out.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


@pytest.mark.parametrize("tokens", [5, 2_000_000])
def test_lm_edges(spark, tokens, monkeypatch):
    rows = [(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (None, "B\tc"), (4, "É é \x0bx"), (7, "a " * 40), (8, "zz")]
    real = lm_scoring._batches
    def small(slices):  # several batches within one document
        lm_scoring.BATCH_TOKENS = tokens
        return real(slices)
    monkeypatch.setattr(lm_scoring, "_batches", small)
    out = lm_scoring.lm_scores(frame(spark, [(i, t, "en") for i, t in rows]))
    assert lm_rows(out) == lm_by_hand(rows)
    assert lm_scoring.lm_scores(frame(spark, [])).count() == 0
    alone = lm_scoring.lm_scores(frame(spark, [(2, "a b", "en")])).first() if rest(2, 5) == 1 else None
    assert alone is None or (alone.train_tokens == 0 and alone.score == 0.0 and alone.base_score == 0.0)


def test_em_weights_are_distributions_and_fit():
    cells = np.array([[3, -1, -160, 900], [3, 1, -160, 100], [0, 1, -160, 50], [0, 1, 1, 50]])
    lam = lm_scoring.learn_weights(cells, 1000)
    assert np.allclose(lam.sum(axis=1), 1) and lam[3, 2] > 0.8 and lam[0, 2] == 0 and (lam[:, 0] > 0).all()


def test_words_split_on_ascii_space_only():
    import pyarrow as pa
    texts = [" A\x0bb c  d\n", None, "", "\t", "É"]
    counts, codes, vocab = words.split_words(pa.array(texts), lower=True)
    flat = [w for t in texts for w in (t or "").encode().lower().split()]
    assert counts.tolist() == [3, 0, 0, 0, 1] and [vocab[int(c)].as_py().encode() for c in codes] == flat


def test_more_languages_than_classes_fail(spark):
    df = spark.createDataFrame([(k, f"text of {lang}", lang) for k, lang in enumerate(["aa", "bb", "cc"] * 6)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_id.train(df, max_classes=2)
    assert language_id.train(df, max_classes=3)[0] == ["aa", "bb", "cc"]
