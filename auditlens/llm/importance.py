"""Target-distribution importance resampling on hashed word features.

1. Features are the runs of 1 to ``runs`` consecutive words, repeats counted. A task finds the distinct features of a
   slice of texts and hashes them by length-bucketed CRC matrices: the bytes of all features of one length stand in a
   two-dimensional uint8 array, one table step per column updates every CRC at once, and the results are scattered
   back. Features of over ``LONG`` bytes are hashed one by one, by the same function.
2. Bucket counts of the raw and the target texts are summed per task, then over all tasks: at most ``buckets`` rows
   a task. The gain of a bucket is 1000 times the logarithm of the target's share over the raw one's (add-one), floored.
3. Every document's weight is the sum of its features' gains; the table of gains has ``buckets`` rows, whatever the input.
4. Gumbel noise from the id's hash is added, and the highest scores are drawn: the scores are range-partitioned, sorted and
   numbered by prefix sums of the partition sizes.

Defined results: NULL and word-less texts have no features and weight 0, and are never drawn when ``min_words`` is 1 or
more. A NULL doc_id counts as the empty text in the noise and comes first in ties. Rows that repeat a doc_id are documents
of their own, drawn one by one. An empty target has T = 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import store, words
from auditlens.llm.store import staged
from auditlens.operators.numbering import dense_numbers

BUCKETS = 10_000
RUNS = 1
MIN_WORDS = 20
DRAW_PER_CENT = 10
SEED = 2024
#: Features of more bytes are hashed one at a time.
LONG = 2048
#: Bytes of one CRC matrix.
_MATRIX = 1 << 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words, after lower-casing: digits, a-z, and all of other scripts.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


_TABLE = _crc_table()


def crc_by_length(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """crc32 of each data[offsets[i]:offsets[i + 1]], by one matrix per length."""
    size = np.diff(offsets)
    out = np.zeros(len(size), np.uint32)
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for n, lo, hi in zip(lengths.tolist(), first, [*first[1:], len(order)]):
        if n > LONG:
            for i in order[lo:hi]:
                out[i] = zlib.crc32(data[offsets[i]:offsets[i + 1]])
            continue
        step = max(1, _MATRIX // max(n, 1))
        for s in range(lo, hi, step):
            rows = order[s:min(s + step, hi)]
            columns = data[offsets[rows] + np.arange(n)[:, None]]  # a row of this array is a byte column
            crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
            for column in columns:
                crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
            out[rows] = ~crc
    return out


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_binary array without NULLs."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text; bytes and offsets of all words, in order."""
    data, offsets = _parts(texts.cast(pa.large_binary()).fill_null(b""))
    raw = _LOWER[data[offsets[0]:offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    counts = np.diff(np.searchsorted(begins, offsets))
    return counts, raw[inside], np.concatenate(([0], np.cumsum(ends - begins)))


def features(texts: pa.Array, runs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run length: features per text, a code per feature, the crc32 of each code's bytes."""
    counts, data, offsets = _words(texts)
    size = np.diff(offsets)
    starts = offsets[:-1] + np.arange(len(size))  # where every word is followed by one space
    spaced = np.full(len(data) + len(size), 32, np.uint8)
    if runs > 1 and len(size):
        spaced[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
    text_of = np.repeat(np.arange(len(counts)), counts)
    for r in range(1, runs + 1):
        if r == 1:
            values, per_text = _binary(data, offsets), counts
        else:
            at = np.flatnonzero(text_of[r - 1:] == text_of[:len(text_of) - r + 1]) if len(size) >= r else np.empty(0, np.int64)
            length = starts[at + r - 1] + size[at + r - 1] - starts[at]
            ends = np.concatenate(([0], np.cumsum(length)))
            values = _binary(spaced[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], length)], ends)
            per_text = np.maximum(counts - r + 1, 0)
        if not len(values):
            yield per_text, np.empty(0, np.int64), np.empty(0, np.uint32)
            continue
        coded = values.dictionary_encode()
        yield per_text, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), crc_by_length(*_parts(coded.dictionary))


def bucket_counts(docs: DataFrame, buckets: int, runs: int) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has some."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in words.pieces(batches, "text"):
            for _, codes, crc in features(b.column("text"), runs):
                np.add.at(total, crc % buckets, np.bincount(codes, minlength=len(crc)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """(bucket, gain) for every bucket from 0 to ``buckets`` - 1."""
    spark = raw.sparkSession
    s = bucket_counts(raw, buckets, runs).withColumnRenamed("n", "s")
    t = bucket_counts(target, buckets, runs).withColumnRenamed("n", "t")
    # all three tables have at most ``buckets`` rows
    both = (spark.range(buckets).withColumnRenamed("id", "bucket").join(F.broadcast(s), "bucket", "left")
            .join(F.broadcast(t), "bucket", "left").fillna(0))
    ends = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    ratio = ((F.col("t") + 1.0) * (F.col("all_s") + float(buckets))) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return both.join(F.broadcast(ends)).select("bucket", F.floor(1000.0 * F.ln(ratio)).alias("gain"))


def weigh(docs: DataFrame, gain_of: np.ndarray, runs: int = RUNS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; gain_of holds one gain per bucket."""
    buckets = len(gain_of)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.pieces(batches, "text"):
            n_words = None
            total, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for per_text, codes, crc in features(b.column("text"), runs):
                n_words = per_text if n_words is None else n_words
                total += per_text
                sums = np.concatenate(([0], np.cumsum(gain_of[crc % buckets][codes])))
                ends = np.cumsum(per_text)
                weight += sums[ends] - sums[ends - per_text]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (n_words.astype(np.int64), total, weight))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(weights, "doc_id long, n_words long, n_features long, weight long"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the hash of the id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, per_cent: int = DRAW_PER_CENT, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (NULL where not drawn) of every row of ``docs``."""
    folder = store.scratch(docs.sparkSession, "importance")
    table = gains(docs, target, buckets, runs).toPandas()
    gain_of = np.zeros(buckets, np.int64)
    gain_of[table["bucket"].to_numpy()] = table["gain"].to_numpy()
    # written first: the sampling of range bounds would read the texts once more
    rows = staged(weigh(docs, gain_of, runs).select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"),
        (F.col("n_words") >= min_words).alias("able")), folder, "weights")
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("weight").asc(), F.col("n_features").asc()]
    numbered = dense_numbers(rows, order, f"{folder}/scores", "rank", start=1)
    able = rows.filter("able").count()
    drawn = F.col("able") & (F.col("rank") <= per_cent * able // 100)
    return numbered.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(store.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same in SQL: crc32 from its polynomial, byte by byte, over the distinct words.
ORACLE = r"""
WITH table_of AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
vocabulary AS (SELECT w, hex(encode(w)) AS hx FROM (SELECT w FROM dw UNION SELECT w FROM b)),
hashed AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT),
        lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, table_of),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN hashed USING (w) GROUP BY bucket),
ends AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS st, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS tt),
gain AS (SELECT bucket, floor(1000.0::DOUBLE * ln(((coalesce(t.n, 0) + 1.0::DOUBLE) * (st + 10000.0::DOUBLE))
        / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (tt + 10000.0::DOUBLE))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), ends),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
        FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
