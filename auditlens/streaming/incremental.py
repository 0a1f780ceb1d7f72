"""Incremental screenshot / document ingest with Structured Streaming.

New files under a folder are picked up by a ``binaryFile`` stream. Each micro-batch hashes the bytes, drops hashes that
are stored already (``HashStore``: only the prefixes that occur are read), works the rest and appends the results. The stream's
checkpoint records which files were seen, and the stored hashes make a re-delivered or copied file, or a replayed
batch, a no-op. ``force_refresh`` works every file again.

A file that cannot be worked does not stop the others: its row carries an ``error`` and goes, with its bytes and the
number of attempts, to the dead letters beside the results. Every later batch takes up again those with fewer than
``max_attempts`` attempts and no result yet. Dead letters name their batch, so a replayed batch counts no attempt twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens.operators.hash_store import PREFIX_COLUMN, HashStore, exists
from auditlens.operators.incremental import with_content_hash
from auditlens.sources.files import IMAGE_GLOB

BINARY_FILE_SCHEMA = T.StructType([T.StructField("path", T.StringType()),
                                  T.StructField("modificationTime", T.TimestampType()),
                                  T.StructField("length", T.LongType()),
                                  T.StructField("content", T.BinaryType())])
MAX_ATTEMPTS = 3


def dead_letter_path(results_path: str) -> str:
    return f"{results_path.rstrip('/')}_errors"


def per_file(extract: Callable[[str, bytes], dict], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A ``process`` that calls ``extract(path, content)`` for one file after the other: its dict fills the columns of
    ``schema`` (DDL), and an exception becomes the row's ``error``."""
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                try:
                    got, error = extract(r.path, bytes(r.content)), None
                    row = [got.get(n) for n in names]
                except Exception as e:  # noqa: BLE001 - any failure of one file stays with it
                    row, error = [None] * len(names), f"{type(e).__name__}: {e}"
                out.append((r.path, r.content_hash, r.length, *row, error))
            yield pd.DataFrame(out, columns=["path", "content_hash", "length", *names, "error"])

    return lambda df: df.select("path", "content_hash", "length", "content").mapInPandas(
        work, f"path string, content_hash string, length long, {schema}, error string")


def _one_per_hash(df: DataFrame) -> DataFrame:
    """Of files with the same bytes in one batch, the first path; attempts so far."""
    return df.groupBy("content_hash").agg(F.min("path").alias("path"), F.first("length").alias("length"), F.first("content").alias("content"),
                                          F.max("attempts").alias("attempts"))


def dead_letters(spark: SparkSession, results_path: str) -> DataFrame | None:
    """The last failed attempt of every hash without a result; None if nothing ever failed."""
    path = dead_letter_path(results_path)
    if not exists(spark, path):
        return None
    df = spark.read.parquet(path)
    last = df.groupBy("content_hash").agg(F.max_by(F.struct(*df.columns), "attempts").alias("r")).select("r.*")
    return HashStore(spark, results_path).new_only(last)


def start(spark: SparkSession, source_dir: str, results_path: str, checkpoint: str,
          process: Callable[[DataFrame], DataFrame] | None = None, glob: str = IMAGE_GLOB,
          force_refresh: bool = False, available_now: bool = True, max_attempts: int = MAX_ATTEMPTS):
    """Start the ingest query; returns the ``StreamingQuery``.

    ``process`` maps a batch of (path, content_hash, length, content) rows to the result rows to store. It must keep
    ``content_hash``; a row with a non-NULL ``error`` column goes to the dead letters instead (``per_file`` makes such a
    ``process`` from a function of one file). Default stores the listing itself. ``checkpoint`` should live in
    the cluster's shared checkpoint folder.
    """
    stream = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("pathGlobFilter", glob).load(source_dir))
    store = HashStore(spark, results_path)

    def batch(df: DataFrame, epoch_id: int) -> None:
        work_batch(df, store, f"{checkpoint}#{epoch_id}", epoch_id, process, force_refresh, max_attempts)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def work_batch(df: DataFrame, store: HashStore, batch_name: str, epoch_id: int, process: Callable[[DataFrame], DataFrame] | None = None,
               force_refresh: bool = False, max_attempts: int = MAX_ATTEMPTS) -> None:
    """One micro-batch: new and retried files to results and dead letters. Doing it again changes nothing."""
    spark = store.spark
    hashed = with_content_hash(df.select("path", "length", "content"), "content").withColumn("attempts", F.lit(0))
    fresh = hashed if force_refresh else store.new_only(hashed)
    failed = dead_letters(spark, store.path)
    if failed is not None:
        # of this very batch: it failed half-way and is replayed, its dead letters are written already
        here = failed.filter(F.col("batch") == batch_name).select("content_hash")
        again = failed.filter((F.col("attempts") < max_attempts) & (F.col("batch") != batch_name)).select("path", "length", "content", "content_hash", "attempts")
        if not force_refresh:  # a copy of a failed file is no new file
            fresh = fresh.join(failed.select("content_hash"), "content_hash", "left_anti")
        fresh = fresh.unionByName(again).join(here, "content_hash", "left_anti")
    todo = _one_per_hash(fresh)
    out = process(todo.drop("attempts")) if process else todo.select("path", "content_hash", "length")
    if "error" not in out.columns:
        out = out.withColumn("error", F.lit(None).cast("string"))
    # results and errors come from one evaluation, kept in the shared folder: a client that is asked twice may answer differently
    staged = f"{store.path.rstrip('/')}_staged/{hashlib.sha256(batch_name.partition('#')[0].encode()).hexdigest()}"
    out.write.mode("overwrite").parquet(staged)
    out = spark.read.parquet(staged)
    bad = out.filter("error IS NOT NULL").select("content_hash", "error")
    letters = todo.join(bad, "content_hash").select("content_hash", "path", "length", "content", "error", (F.col("attempts") + 1).alias("attempts"),
                                                    F.lit(batch_name).alias("batch"), F.current_timestamp().alias("failed_at"))
    if not bad.isEmpty():
        letters.write.mode("append").parquet(dead_letter_path(store.path))
    # epoch ids restart with a new checkpoint: order results by ingest time first
    store.append(out.filter("error IS NULL").drop("error").withColumn("ingested_at", F.current_timestamp())
                 .withColumn("ingest_batch", F.lit(epoch_id).cast("long")))


def results(spark: SparkSession, results_path: str) -> DataFrame:
    """Latest stored result per content hash (a re-processed hash supersedes older rows)."""
    df = spark.read.parquet(results_path).drop(PREFIX_COLUMN)
    order = F.struct("ingested_at", "ingest_batch")
    return df.groupBy("content_hash").agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def listing(spark: SparkSession, results_path: str) -> DataFrame:
    """(path, content_hash, length, error, attempts): every file's outcome; error and attempts are NULL for results."""
    out = spark.createDataFrame([], "path string, content_hash string, length long, error string, attempts int")
    if exists(spark, results_path):
        done = results(spark, results_path).select("path", "content_hash", "length")
        out = out.unionByName(done, allowMissingColumns=True)
    failed = dead_letters(spark, results_path)
    return out if failed is None else out.unionByName(failed.select(*out.columns))
