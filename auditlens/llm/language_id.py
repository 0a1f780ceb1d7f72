"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased, every run of non-letters becomes one space, and the 1- to ``order``-grams are hashed
into ``features`` slots, weighted (1 + log tf) * idf and L2-normalised. Document frequencies are counted
over all training documents. The model is trained by follow-the-regularised-leader with elastic-net
penalties on a bounded sample (at most ``fit_rows`` documents, the languages alike, chosen by id hash, and
``fit_entries`` feature entries), and its softmax is calibrated by a temperature fitted on rows held back.
Everything else covers all rows and whole texts (long ones pass through in slices).

Defined results: a text that is NULL or has no letter gives ``und`` with score 0; so does every text when
nothing can be learnt (no row with text and lang). Rows with a NULL lang are scored but not learnt from.
Every language is learnt; more than ``max_classes`` of them are an error, none is left out. A tie between classes goes to the
first by name. Repeated rows are each scored; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import ftrl, store, words
from auditlens.llm.quality_classifier import sparse_rows

FEATURES = 1 << 16
ORDER = 3
SLICE = 1_000_000


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: is it a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None, features: int = FEATURES, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of a text's character n-grams; empty when it has no letter."""
    total, tail = None, np.empty(0, np.uint32)
    text = text or ""
    for s in range(0, len(text), SLICE):
        code = np.frombuffer(text[s:s + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        code = np.where(letter, code, 32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True  # a slice may open with the space that closes the slice before
        code = code[keep]
        if total is None:
            code = np.concatenate([np.array([32], np.uint32), code])
        joined = np.concatenate([tail, code])
        if len(tail) and tail[-1] == 32 and joined[len(tail)] == 32:
            joined = np.delete(joined, len(tail))
        fresh = len(tail)
        if total is None:
            total = np.zeros(features, np.int64)
        h = joined.astype(np.uint64)
        gram = h.copy()
        for n in range(1, order + 1):
            if n > 1:
                gram = gram[:-1] * np.uint64(0x100000001B3) + h[n - 1:] + np.uint64(n)
            new = gram[max(fresh - n + 1, 0):]
            if len(new):
                total += np.bincount((words.mix(new) % np.uint64(features)).astype(np.int64), minlength=features)
        tail = joined[max(len(joined) - order + 1, 0):]
    if total is None or not any(map(str.isalpha, text)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    idx = np.flatnonzero(total)
    return idx, total[idx]


def _tfidf(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx, n = gram_counts(text, len(idf))
    val = (1.0 + np.log(n)) * idf[idx]
    size = math.sqrt(float(val @ val))
    return idx, val / size if size else val


def _document_frequencies(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(features, np.int64), 0
    for b in batches:
        for i in range(b.num_rows):
            idx, _ = gram_counts(b.column("text")[i].as_py(), features)
            df[idx] += 1
            n += len(idx) > 0
    idx = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(idx, -1)), pa.array(np.append(df[idx], n))], ["slot", "n"])


def train(docs: DataFrame, folds: int = 3, held_out: int = 1, fit_rows: int = 6000,
          fit_entries: int = 16_000_000, features: int = FEATURES, max_classes: int = 64, epochs: int = 3,
          penalty: ftrl.Penalty = ftrl.Penalty(alpha=1.0, l1=0.01, l2=0.01)):
    """(languages, weights, idf, temperature), or None when there is nothing to learn from."""
    rows = (docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"))
            .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (store.fold("id", folds) != held_out)))
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_classes + 1).collect()
    if not langs:
        return None
    if len(langs) > max_classes:
        raise ValueError(f"more than {max_classes} languages to learn: raise max_classes (memory grows with it)")
    names = sorted(r["lang"] for r in langs)
    seen = {r["lang"]: r["n"] for r in langs}
    found = (rows.select("text").mapInArrow(lambda bs: _document_frequencies(bs, features), "slot long, n long")
             .groupBy("slot").agg(F.sum("n").alias("n")).collect())  # one row per slot at most
    df, total = np.zeros(features), 0
    for r in found:
        if r["slot"] < 0:
            total = r["n"]
        else:
            df[r["slot"]] = r["n"]
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    quota = fit_rows / len(names)
    share = F.lit(0.0)
    code = F.lit(0)
    for i, name in enumerate(names):
        share = F.when(F.col("lang") == name, quota / seen[name]).otherwise(share)
        code = F.when(F.col("lang") == name, i).otherwise(code)
    sample = (rows.filter(F.col("lang").isin(names)).withColumn("h", F.xxhash64("id", F.lit(1)))
              .filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("h", code.alias("label"), "text"))

    def featurise(batches):
        for b in batches:
            out = [_tfidf(t, idf) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("h"), b.column("label"), pa.array([i.astype(np.int32).tobytes() for i, _ in out], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v in out], pa.binary())], ["h", "label", "idx", "val"])

    def learn(batches):
        sparse = [r for r in sparse_rows(batches, fit_entries) if len(r[0])]
        if sparse:
            w, t = ftrl.fit(sparse, len(names), features, penalty, epochs)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([t])], ["w", "t"])

    got = (sample.mapInArrow(featurise, "h long, label int, idx binary, val binary").orderBy("h").limit(2 * fit_rows)
           .repartition(1).mapInArrow(learn, "w binary, t double").collect())
    if not got:
        return None
    return names, np.frombuffer(got[0]["w"], np.float32).reshape(len(names), features), idf, got[0]["t"]


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1, **fit) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    model = train(docs, folds, held_out, **fit)
    rows = docs.select("doc_id", (store.fold("doc_id", folds) == held_out).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # classes x features: fixed by parameters

    def run(batches):
        names, weights, idf, heat = shared.value
        for b in batches:
            lang, score = [], []
            for i in range(b.num_rows):
                idx, val = _tfidf(b.column("text")[i].as_py(), idf)
                if not len(idx):
                    lang.append("und")
                    score.append(0.0)
                    continue
                p = ftrl.softmax((weights[:, idx] @ val)[None, :] / heat)[0]
                k = int(p.argmax())
                lang.append(names[k])
                score.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(store.documents(spark, sf_dir))
