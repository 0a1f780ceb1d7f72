"""Model calls that are never repeated: a ledger of finished calls, keyed by row, model and prompt.

Before anything is called, tasks whose key is in the ledger are dropped by an anti join. Inside a partition a bounded pool of
threads works one slice of tasks after the other, and every slice's finished calls are written to the ledger before the next
slice begins, also when a call of the slice breaks the task. A task that is tried again reads the keys that its earlier attempts
wrote into its buckets and skips them. So of the calls that finished, at most the slice in flight of a worker that was killed outright
(no exception) is called again; ``slice_size=1`` leaves none.

The ledger's folder has to be one that both Spark and ``pyarrow.fs`` reach (a shared mount, or an object store). Its files
appear by rename, so a reader never sees half of one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.operators.fanout import RESULT_SCHEMA, RetryPolicy
from auditlens.operators.hash_store import exists

KEY = ["row_id", "model", "prompt_hash"]
_TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")
_SCHEMA = pa.schema([("row_id", pa.int64()), ("model", pa.string()), ("prompt_hash", pa.string()), ("response", pa.string()),
                     ("latency", pa.float64()), *((t, pa.int64()) for t in _TOKENS), ("status", pa.string()),
                     ("finished_at", pa.timestamp("us", tz="UTC"))])


def keyed(tasks: DataFrame) -> DataFrame:
    """Tasks with the hash of their prompt: a changed prompt is another call."""
    part = lambda c: F.coalesce(F.sha2(c, 256), F.lit("-"))  # noqa: E731 - so that no two pairs of texts run together
    return tasks.withColumn("prompt_hash", F.sha2(F.concat(part("system_prompt"), part("user_prompt")), 256))


def _finished(store: fs.FileSystem, folder: str) -> set[tuple]:
    if store.get_file_info(folder).type != fs.FileType.Directory:
        return set()
    t = ds.dataset(folder, filesystem=store, format="parquet", schema=_SCHEMA).to_table(columns=KEY)
    return set(zip(*(t.column(c).to_pylist() for c in KEY)))


def _append(store: fs.FileSystem, folder: str, calls: list[dict]) -> None:
    if calls:
        store.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        pq.write_table(pa.Table.from_pylist(calls, schema=_SCHEMA), f"{folder}/.{name}", filesystem=store)
        store.move(f"{folder}/.{name}", f"{folder}/{name}.parquet")


def call_once(tasks: DataFrame, client: Callable[[str, str, str], dict], ledger: str, partitions: int = 8, threads: int = K.MAX_WORKERS,
              slice_size: int = 32, policy: RetryPolicy | None = None) -> DataFrame:
    """The result of every task (columns of ``fanout.RESULT_SCHEMA``), calling only what ``ledger`` does not hold.

    ``client`` as in ``fanout.call_models``; a call that failed for good is finished too. The calls run when this is called:
    at most ``partitions`` * ``threads`` at a time.
    """
    spark = tasks.sparkSession
    policy = policy or RetryPolicy()
    todo = keyed(tasks).select(*KEY, "system_prompt", "user_prompt").dropDuplicates(KEY)
    if exists(spark, ledger):
        todo = todo.join(spark.read.parquet(ledger).select(*KEY), KEY, "left_anti")
    todo = todo.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(partitions)).cast("int")).repartition(partitions, "bucket")

    def one(t) -> dict:
        reply, took = policy.run(lambda: client(t.model, t.system_prompt, t.user_prompt))
        out = {"row_id": t.row_id, "model": t.model, "prompt_hash": t.prompt_hash, "latency": took, "finished_at": datetime.now(timezone.utc)}
        if reply is None:
            return out | {"response": K.ERROR_RESPONSE, "status": K.FAILED_STATUS}
        return out | {k: reply.get(k) for k in ("response", *_TOKENS)} | {"status": K.SUCCESS_STATUS}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(ledger)
        done: dict[int, set[tuple]] = {}
        called = 0
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                for bucket, rows in b.groupby("bucket"):
                    folder = f"{base}/bucket={bucket}"
                    if bucket not in done:  # what an earlier attempt of this task finished
                        done[bucket] = _finished(store, folder)
                    left = [t for t in rows.itertuples(index=False) if (t.row_id, t.model, t.prompt_hash) not in done[bucket]]
                    for s in range(0, len(left), slice_size):
                        running = [pool.submit(one, t) for t in left[s:s + slice_size]]
                        finished = []
                        try:
                            for f in as_completed(running):
                                finished.append(f.result())
                        finally:
                            _append(store, folder, finished)
                        called += len(finished)
        yield pd.DataFrame({"called": [called]})

    todo.mapInPandas(work, "called long").agg(F.sum("called")).first()
    # two attempts of one task may have called the same prompt at the same time: the first answer counts
    row = F.struct(*[f.name for f in RESULT_SCHEMA])
    answers = spark.read.parquet(ledger).groupBy(*KEY).agg(F.min_by(row, F.struct("finished_at", "response")).alias("r"))
    return answers.join(keyed(tasks).select(*KEY).distinct(), KEY, "left_semi").select("r.*")
