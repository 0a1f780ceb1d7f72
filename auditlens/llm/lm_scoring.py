"""Bigram language-model scores by deleted interpolation.

p(w | v) = L2[b] c(vw)/c(v) + L1[b] c(w)/N + L0[b]/(V+1), where b is the bucket of the context's frequency
c(v) (0, 1, 2-3, 4-7, ...). The weights L of each bucket are learnt by expectation-maximisation on held-out
counts: one training document in ``DELETED_EVERY`` is deleted from the counts while the weights are fitted on it;
then all training documents are counted again for scoring. A text's tokens are its words and one end; the end
also serves as the context of the first word.

Counting: tasks turn slices of texts into batches (distinct words, a code per token), written once. A batch
sends each distinct word and word pair once, with its count, to the part that owns the pair's hash; the part adds
the batches up and sends the totals back. So a frequent word or pair is one entry per batch, parts are even, and
both parts and batches have a bounded size whatever the corpus size. Words are told apart by 64-bit hashes, pairs
by 48 bits below the part's own.

For the fit, the tokens of the deleted documents are summarised as (bucket, log p2, log p1) cells, 16 to the
octave, so that only a table of fixed size reaches the driver.

Defined results: NULL or empty text is one token, the end. Rows that repeat a doc_id are each scored (and counted).
A NULL doc_id counts as the empty text for the folds. Without training documents N = V = 0, every count is 0, the
base score is 0 per token and the model's probability of each token is L0/(V+1) = 1. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import store, words
from auditlens.llm.store import staged

DELETED_EVERY = 20
BUCKETS = 16
#: Tokens of a batch row at most, and tokens per part of the counting.
BATCH_TOKENS = 2_000_000
PART_TOKENS = 500_000
_END = words.mix(np.array([1], np.uint64))[0]
_SHRINK = 16  # cells per octave


def _zip(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unzip(b: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


_BATCH = ("batch long, deleted boolean, ids array<long>, held array<boolean>, rows array<long>, lens array<int>, "
          "n int, n_train int, words int, before int, codes binary, vocab binary")


def _batches(slices: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() << 32
    serial = 0
    for b in words.pieces(slices, "text", 7_000_000):
        for deleted in (False, True):
            part = b.filter(pa.compute.equal(b.column("deleted"), deleted))
            if not part.num_rows:
                continue
            counts, codes, vocab = words.split_words(part.column("text"), lower=True)
            hashes = np.append(words.hash_vocabulary(vocab), _END) if len(vocab) else np.array([_END])
            end = len(hashes) - 1
            lens = counts + 1
            stream = np.full(int(lens.sum()), end, np.int64)
            last = np.cumsum(lens) - 1
            word = np.ones(len(stream), bool)
            word[last] = False
            stream[word] = codes
            row0 = task + (serial << 20)
            for s in range(0, len(stream), BATCH_TOKENS):
                e = min(s + BATCH_TOKENS, len(stream))
                first, final = np.searchsorted(last, [s, e - 1])
                ends = np.minimum(last[first:final + 1] + 1, e)
                lens_here = np.diff(np.append(s, ends))
                doc = slice(int(first), int(final) + 1)
                used, local = np.unique(np.append(stream[s:e], [end, stream[s - 1] if s else end]), return_inverse=True)
                order = np.argsort(hashes[used])  # local codes follow the order of the hashes
                place = np.empty(len(used), np.int64)
                place[order] = np.arange(len(used))
                local = place[local].astype(np.uint32)
                held = part.column("held").to_numpy(zero_copy_only=False)[doc]
                yield pa.RecordBatch.from_pylist([{
                    "batch": row0 + (s // BATCH_TOKENS), "deleted": deleted, "ids": part.column("doc_id").to_pylist()[doc],
                    "held": held.tolist(), "rows": list(range(row0 + int(first), row0 + int(final) + 1)),
                    "lens": lens_here.tolist(), "n": e - s, "n_train": int(lens_here[~held].sum()), "words": len(used),
                    "before": int(local[-1]), "codes": _zip(local[:-2]), "vocab": hashes[used][order].tobytes()}],
                    schema=_SCHEMA)
            serial += 1 + (max(part.num_rows, len(stream) // BATCH_TOKENS) >> 20)


_SCHEMA = pa.schema([("batch", pa.int64()), ("deleted", pa.bool_()), ("ids", pa.list_(pa.int64())),
                     ("held", pa.list_(pa.bool_())), ("rows", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())),
                     ("n", pa.int32()), ("n_train", pa.int32()), ("words", pa.int32()), ("before", pa.int32()),
                     ("codes", pa.binary()), ("vocab", pa.binary())])


class _Batch:
    """One batch row, unpacked: tokens, contexts, and the pairs in the order in which they are sent."""

    def __init__(self, r: dict):
        self.row = r
        self.hashes = np.frombuffer(r["vocab"], np.uint64)
        self.token = _unzip(r["codes"], r["n"], np.uint32).astype(np.int64)
        end = int(np.searchsorted(self.hashes, _END))
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[0] = r["before"]
        self.lens = np.array(r["lens"], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.context = before  # a document's first word follows the end of the document before it
        self.context[self.starts[1:]] = end
        self.train = np.repeat(~np.array(r["held"], bool), self.lens)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each distinct pair in ascending order, place of every token's pair in it)."""
        v = len(self.hashes)
        key, inverse = np.unique(self.context * v + self.token, return_inverse=True)
        h = words.chain(self.hashes[key // v], self.hashes[key % v])
        order = np.argsort(h)
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        return h[order], place[inverse]


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The owner of a hash by its top 32 bits: ascending in the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


_SENT = "part int, kind int, batch long, deleted boolean, n int, grams binary, train binary"


def _send(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            x = _Batch(r)
            h2, place = x.pairs()
            out = []
            for kind, h, at in ((1, x.hashes, x.token), (2, h2, place)):
                count = np.bincount(at[x.train], minlength=len(h)).astype(np.uint32)
                owner = _part_of(h, parts)
                cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=parts))
                raw = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
                for s, e in zip(cuts[:-1], cuts[1:]):
                    gram = raw[s:e] if kind == 1 else raw[s:e, :6]
                    out.append((int(owner[s]), kind, r["batch"], r["deleted"], int(e - s), gram.tobytes(), count[s:e].tobytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary()),
                 pa.array(cols[6], pa.binary())], ["part", "kind", "batch", "deleted", "n", "grams", "train"])


_TOTALS = "batch long, kind int, part int, n int, full binary, rest binary, seen long, seen_rest long"


def _add_up(t: pa.Table) -> pa.Table:
    """Totals of one part's grams, sent back to each batch in the batch's order: ``full`` over all training
    documents, ``rest`` without the deleted ones. One row with batch -1 tells how many grams were seen."""
    kind, part = t.column("kind")[0].as_py(), t.column("part")[0].as_py()
    width = 8 if kind == 1 else 6
    n = t.column("n").to_numpy()
    raw = np.zeros((int(n.sum()), 8), np.uint8)
    raw[:, :width] = np.frombuffer(b"".join(t.column("grams").to_pylist()), np.uint8).reshape(-1, width)
    train = np.frombuffer(b"".join(t.column("train").to_pylist()), np.uint32).astype(np.float64)
    key, at = np.unique(raw.view(np.uint64).ravel(), return_inverse=True)
    out = np.repeat(t.column("deleted").to_numpy(zero_copy_only=False), n)
    full = np.bincount(at, weights=train, minlength=len(key)).astype(np.int64)
    rest = np.bincount(at, weights=np.where(out, 0.0, train), minlength=len(key)).astype(np.int64)
    rows = []
    ends = np.cumsum(n)
    for b, deleted, m, e in zip(t.column("batch").to_pylist(), t.column("deleted").to_pylist(), n.tolist(), ends.tolist()):
        here = at[e - m:e]
        rows.append({"batch": b, "kind": kind, "part": part, "n": m, "full": _zip(full[here]),
                     "rest": _zip(rest[here]) if deleted else None, "seen": 0, "seen_rest": 0})
    rows.append({"batch": -1, "kind": kind, "part": part, "n": 0, "full": None, "rest": None,
                 "seen": int((full > 0).sum()), "seen_rest": int((rest > 0).sum())})
    return pa.Table.from_pylist(rows, schema=pa.schema([
        ("batch", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("full", pa.binary()),
        ("rest", pa.binary()), ("seen", pa.int64()), ("seen_rest", pa.int64())]))


def _counts(x: _Batch, totals: list[dict], column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c(w), c(v), c(vw) of every token."""
    got = {}
    for kind in (1, 2):
        mine = sorted((r for r in totals if r["kind"] == kind), key=lambda r: r["part"])
        got[kind] = np.concatenate([_unzip(r[column], r["n"], np.int64) for r in mine])
    _, place = x.pairs()
    return got[1][x.token], got[1][x.context], got[2][place]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def _cells(left: pa.Table, right: pa.Table, n: int) -> pa.Table:
    totals, out = right.to_pylist(), []
    for r in left.to_pylist():
        x = _Batch(r)
        cw, cv, cvw = (c[x.train] for c in _counts(x, totals, "rest"))
        with np.errstate(divide="ignore", invalid="ignore"):
            q2 = np.where(cvw > 0, np.rint(np.log2(cvw / np.maximum(cv, 1)) * _SHRINK), 1)
            q1 = np.where(cw > 0, np.rint(np.log2(cw / max(n, 1)) * _SHRINK), 1)
        cell, times = np.unique(np.stack([_bucket(cv), q2.astype(np.int64), q1.astype(np.int64)], axis=1), axis=0,
                                return_counts=True)
        out.append(np.column_stack([cell, times]))
    all_cells = np.concatenate(out) if out else np.empty((0, 4), np.int64)
    return pa.table({k: pa.array(all_cells[:, i], pa.int64()) for i, k in enumerate(("bucket", "q2", "q1", "times"))})


def learn_weights(cells: np.ndarray, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """EM: BUCKETS x 3 weights (of 1/(V+1), p1, p2) from rows (bucket, q2, q1, times). q = 1 stands for
    probability 0. A bucket without held-out tokens mixes evenly; contexts never seen (bucket 0) leave p2 out."""
    lam = np.full((BUCKETS, 3), 1 / 3)
    lam[0] = (0.5, 0.5, 0.0)
    for b in range(BUCKETS):
        mine = cells[cells[:, 0] == b]
        if not len(mine):
            continue
        p = np.stack([np.full(len(mine), 1.0 / (vocabulary + 1)),
                      np.where(mine[:, 2] > 0, 0.0, 2.0 ** (np.minimum(mine[:, 2], 0) / _SHRINK)),
                      np.where(mine[:, 1] > 0, 0.0, 2.0 ** (np.minimum(mine[:, 1], 0) / _SHRINK))], axis=1)
        times = mine[:, 3].astype(float)
        live = np.array([1.0, 1.0, float(b > 0)])
        for _ in range(rounds):
            joint = lam[b] * p
            share = joint / joint.sum(axis=1, keepdims=True)
            lam[b] = (times @ share + live) / (times.sum() + live.sum())
    return lam


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(left: pa.Table, right: pa.Table, n: int, v: int, lam: np.ndarray) -> pa.Table:
    totals, out = right.to_pylist(), []
    for r in left.to_pylist():
        x = _Batch(r)
        cw, cv, cvw = _counts(x, totals, "full")
        w = lam[_bucket(cv)]
        p = w[:, 2] * cvw / np.maximum(cv, 1) + w[:, 1] * cw / max(n, 1) + w[:, 0] / (v + 1)
        if not n:
            p[:] = 1.0 / (v + 1)
        base = np.log10((cw + 0.5) / (n + 0.5 * (v + 1)))
        cols = [np.add.reduceat(a, x.starts) for a in ((cw > 0).astype(np.int64), base, np.log10(p))]
        out.append(pa.table({"row": pa.array(r["rows"], pa.int64()), "doc_id": pa.array(r["ids"], pa.int64()),
                             "held_out": pa.array(r["held"], pa.bool_()), "n_tokens": pa.array(x.lens, pa.int64()),
                             "n_known": pa.array(cols[0]), "base_score": pa.array(cols[1]), "score": pa.array(cols[2])}))
    if out:
        return pa.concat_tables(out)
    return pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                      ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()


def lm_scores(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    spark = docs.sparkSession
    folder = store.scratch(spark, "lm")
    held = store.fold("doc_id", folds) == held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       held.alias("held"),
                       (~held & (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(DELETED_EVERY)) == 0)).alias("deleted"))
    batches = staged(rows.mapInArrow(_batches, _BATCH), folder, "batches")
    size = batches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("train"),
                       F.coalesce(F.sum(F.when(~F.col("deleted"), F.col("n_train"))), F.lit(0)).alias("rest")).first()
    parts = max(64, size["all"] // PART_TOKENS)
    totals = staged(batches.mapInArrow(lambda bs: _send(bs, parts), _SENT)
                    .groupBy("part", "kind").applyInArrow(_add_up, _TOTALS), folder, "totals")
    seen = totals.filter("batch = -1 AND kind = 1").agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("v"),
                                                       F.coalesce(F.sum("seen_rest"), F.lit(0)).alias("rest")).first()
    n, v, rest = size["train"], seen["v"], size["rest"]
    back = totals.filter("batch <> -1").select("batch", "kind", "part", "n", "full", "rest")
    cells = (batches.filter("deleted").groupBy("batch").cogroup(back.filter("rest IS NOT NULL").groupBy("batch"))
             .applyInArrow(lambda a, b: _cells(a, b, rest), "bucket long, q2 long, q1 long, times long")
             .groupBy("bucket", "q2", "q1").agg(F.sum("times").alias("times")).collect())
    lam = learn_weights(np.array([tuple(r) for r in cells], np.int64).reshape(-1, 4), seen["rest"])
    scored = (batches.groupBy("batch").cogroup(back.drop("rest").groupBy("batch"))
              .applyInArrow(lambda a, b: _score(a, b, n, v, lam), _SCORED))
    return (scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
                                      F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                                      F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(store.documents(spark, sf_dir))
