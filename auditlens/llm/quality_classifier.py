"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

Features of a text (hashed into ``features`` slots): words, word pairs, word shapes (``AA!!`` ->
``A!``, runs collapsed) and shape pairs, each worth ``scale / number of words`` per occurrence, plus a
bias slot. A document's score is one sparse dot product, softmax with a calibrated temperature.

Fit: a bounded sample of at most ``fit_rows`` labelled documents (both classes alike, chosen by id hash,
at most ``fit_entries`` feature entries) is featurised on the executors and learnt in one task. The
natural class ratio, counted over all labels, is put back as an offset. Everything else, and scoring,
covers all rows.

Defined results: NULL or empty text has only the bias; a NULL label is no label; a doc_id labelled twice
takes its smallest label; without any usable label every score is 0.5; repeated document rows are each
scored; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import ftrl, store, words

FEATURES = 1 << 18
SCALE = 16.0


def _shape(word: str) -> str:
    """Upper, lower and digit runs as A, a, 0; repeats of one sign as that sign; at most 8 signs long."""
    out = []
    for ch in word:
        s = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if not out or out[-1] != s:
            out.append(s)
            if len(out) == 8:
                break
    return "".join(out)


def feature_slots(texts: pa.Array, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(words per text, a (n words x 4) array of slots): word, pair, shape, shape pair. A pair that would
    reach back before its text's first word takes the text start instead."""
    counts, codes, vocab = words.split_words(texts, lower=False)
    if not len(codes):
        return counts, np.empty((0, 4), np.int64)
    word = words.hash_vocabulary(vocab)[codes]
    shape = words.hash_vocabulary(pa.array([_shape(w) for w in vocab.to_pylist()], pa.string()))[codes]
    first = np.zeros(len(codes), bool)
    starts = np.cumsum(counts) - counts
    first[starts[counts > 0]] = True
    cols = []
    for kind, h in ((1, word), (2, shape)):
        before = np.roll(h, 1)
        before[first] = 0
        cols += [words.mix(h + np.uint64(kind)), words.chain(before, h + np.uint64(kind))]
    return counts, (np.stack(cols, axis=1) % np.uint64(features - 1)).astype(np.int64) + 1


def _featurise(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[pa.RecordBatch]:
    for b in words.pieces(batches, "text"):
        counts, slots = feature_slots(b.column("text"), features)
        ends = np.cumsum(counts)
        rows = []
        for n, e in zip(counts, ends):
            idx, times = np.unique(slots[e - n:e].ravel(), return_counts=True)
            idx = np.append(idx, 0).astype(np.int32)
            val = np.append(times * (SCALE / max(n, 1)), 1.0).astype(np.float32)
            rows.append((idx.tobytes(), val.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [b.column("h"), b.column("label"), pa.array([r[0] for r in rows], pa.binary()),
             pa.array([r[1] for r in rows], pa.binary())], ["h", "label", "idx", "val"])


def sparse_rows(batches: Iterator[pa.RecordBatch], fit_entries: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The sample in hash order, up to ``fit_entries`` feature entries."""
    table = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["h"], r["idx"]))
    out, used = [], 0
    for r in table:
        idx = np.frombuffer(r["idx"], np.int32)
        used += len(idx)
        if used > fit_entries:
            break
        out.append((idx, np.frombuffer(r["val"], np.float32).astype(float), r["label"]))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1,
          fit_rows: int = 6000, fit_entries: int = 16_000_000, features: int = FEATURES, epochs: int = 3,
          penalty: ftrl.Penalty = ftrl.Penalty()) -> tuple[np.ndarray, float, np.ndarray] | None:
    """(weights 2 x features, temperature, class offsets), or None without labels."""
    usable = (labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
              .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (store.fold("id", folds) != held_out))
              .groupBy("id").agg(F.min("label").alias("label")))
    seen = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not seen:
        return None
    share = F.when(F.col("label") == 0, fit_rows / 2 / seen.get(0, 1)).otherwise(fit_rows / 2 / seen.get(1, 1))
    chosen = (usable.withColumn("h", F.xxhash64("id", F.lit(8)))
              .filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).orderBy("h", "id").limit(fit_rows))
    # at most fit_rows narrow rows: a proven size bound
    sample = (docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
              .join(F.broadcast(chosen), "id"))
    sparse = sample.mapInArrow(lambda bs: _featurise(bs, features), "h long, label int, idx binary, val binary")

    def learn(batches):
        rows = sparse_rows(batches, fit_entries)
        if not rows:
            return
        w, t = ftrl.fit(rows, 2, features, penalty, epochs)
        taken = np.bincount([r[2] for r in rows], minlength=2)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([t]),
                                          pa.array([taken.tolist()])], ["w", "t", "taken"])

    got = sparse.repartition(1).mapInArrow(learn, "w binary, t double, taken array<long>").collect()
    if not got:
        return None
    natural = np.array([seen.get(0, 0) + 1.0, seen.get(1, 0) + 1.0])
    offsets = np.log(natural / (np.array(got[0]["taken"]) + 1.0))
    return np.frombuffer(got[0]["w"], np.float32).reshape(2, features), got[0]["t"], offsets


def score(docs: DataFrame, model: tuple[np.ndarray, float, np.ndarray] | None, text: str = "text",
          into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``: the probability of label 1."""
    if model is None:
        return docs.withColumn(into, F.lit(0.5))
    weights, t, offsets = model
    features = weights.shape[1]
    tilt = docs.sparkSession.sparkContext.broadcast((weights[1] - weights[0], t, float(offsets[1] - offsets[0])))
    columns = docs.columns
    out = docs.withColumn(into, F.lit(0.0))

    def run(batches):
        w, heat, offset = tilt.value
        for b in words.pieces(batches, text):
            counts, slots = feature_slots(b.column(text), features)
            total = np.concatenate([[0.0], np.cumsum(w[slots].sum(axis=1, dtype=np.float64))])
            ends = np.cumsum(counts)
            logit = (total[ends] - total[ends - counts]) * SCALE / np.maximum(counts, 1) + w[0]
            p = 1.0 / (1.0 + np.exp(-np.clip(logit / heat + offset, -60, 60)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(p)],
                                             schema=pa.schema([*list(b.schema)[:len(columns)], pa.field(into, pa.float64())]))

    return out.mapInArrow(run, out.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = train(docs, labels, folds=folds, held_out=held_out, **fit)
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", (store.fold("doc_id", folds) == held_out).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with the columns of ``docs``."""
    model = train(docs, labels, **fit)
    name = store.free(docs, "quality_score")
    return score(docs, model, into=name).filter(F.col(name) >= 0.5).drop(name)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(store.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
