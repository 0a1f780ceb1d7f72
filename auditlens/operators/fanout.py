"""Prompt benchmark: rows x models fan-out, model calls, cost and latency statistics.

* fan-out is an ``explode`` over the fixed, small model list (no join, no
  cross product of two tables): every input row yields one task per model;
* model calls run in ``mapInPandas`` with a caller-supplied client, so the
  concurrency is the partition count and retries live inside the task;
* statistics are per-model aggregates that combine map-side; the exact p95
  uses ``quantile.exact_percentile`` (bounded under a hot model).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens import constants as K
from auditlens.operators.quantile import exact_percentile

MODEL_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("input_price_per_million", T.DoubleType()),
    T.StructField("output_price_per_million", T.DoubleType()),
])

RESULT_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("latency", T.DoubleType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("status", T.StringType()),
])


def model_dimension(spark: SparkSession, models: Sequence[tuple]) -> DataFrame:
    """Small fixed model table (id, display name, input / output price per million tokens)."""
    return spark.createDataFrame(list(models), MODEL_SCHEMA)


def head_rows(df: DataFrame, n: int, seq: str = "_seq") -> DataFrame:
    """The first ``n`` input rows by input order (a top-n, no full sort); ``n <= 0`` keeps all."""
    return df.orderBy(seq).limit(n) if n > 0 else df


def fan_out(rows: DataFrame, models: Sequence[tuple]) -> DataFrame:
    """Every row once per model; model attributes come along as columns."""
    arr = F.array(*[F.struct(F.lit(m[0]).alias("model"), F.lit(m[1]).alias("display_name"),
                             F.lit(float(m[2])).alias("input_price_per_million"),
                             F.lit(float(m[3])).alias("output_price_per_million")) for m in models])
    return rows.withColumn("_m", F.explode(arr)).select("*", "_m.*").drop("_m")


def with_cost(results: DataFrame, prices: DataFrame) -> DataFrame:
    """cost = prompt/1e6 * input price + completion/1e6 * output price; NULL without tokens.

    ``prices`` is the model dimension; Spark broadcasts it if it is as small as it
    should be. An unknown model is priced 0.0.
    """
    p = prices.select("model", "input_price_per_million", "output_price_per_million")
    j = results.join(p, "model", "left")
    inp = F.coalesce(F.col("input_price_per_million"), F.lit(0.0))
    outp = F.coalesce(F.col("output_price_per_million"), F.lit(0.0))
    cost = F.when(F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull(),
                  F.col("prompt_tokens") / 1e6 * inp + F.col("completion_tokens") / 1e6 * outp)
    return j.withColumn("cost", cost).drop("input_price_per_million", "output_price_per_million")


def model_stats(results: DataFrame, p: float = 0.95, models: Sequence[str] | None = None) -> DataFrame:
    """Per model: requests, success / failed, latency mean, p95, min, max, sample stddev (all calls, failed
    included; NaN and NULL latencies do not count) and token / cost means over successes. Empty means are 0.0; a
    single-value stddev is 0.0. With ``models``, every one of them has a row, with zeros where it has no result."""
    ok = F.col("status") == K.SUCCESS_STATUS
    timed = results.withColumn("latency", F.when(~F.isnan(F.col("latency").cast("double")), F.col("latency").cast("double")))

    def mean_ok(c):
        return F.avg(F.when(ok, F.col(c)))

    numbers = {
        "avg_latency": F.avg("latency"), "min_latency": F.min("latency"), "max_latency": F.max("latency"),
        "stddev_latency": F.stddev_samp("latency"), "avg_prompt_tokens": mean_ok("prompt_tokens"),
        "avg_completion_tokens": mean_ok("completion_tokens"), "avg_total_tokens": mean_ok("total_tokens"),
        "avg_cost": mean_ok("cost")}
    counts = {"requests": F.count(F.lit(1)), "success": F.count_if(ok), "failed": F.count_if(~ok)}
    agg = timed.groupBy("model").agg(*[c.alias(n) for n, c in (counts | numbers).items()])
    out = agg.join(exact_percentile(timed, ["model"], "latency", p, out="p95_latency"), "model", "left")
    if models is not None:
        listed = results.sparkSession.createDataFrame([(m,) for m in models], "model string")
        out = listed.join(out, "model", "left")
    zero = {n: F.coalesce(F.col(n), F.lit(0).cast("long")) for n in counts}
    zero |= {n: F.coalesce(F.col(n), F.lit(0.0)) for n in [*numbers, "p95_latency"]}
    return out.select("model", *[c.alias(n) for n, c in zero.items()])


def run_totals(results: DataFrame) -> DataFrame:
    """Successful and failed requests over all models."""
    ok = F.col("status") == K.SUCCESS_STATUS
    return results.agg(F.count_if(ok).alias("successful_requests"),
                       F.count_if(~ok).alias("failed_requests"))


def response_pivot(results: DataFrame, models: Sequence[str], keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """One response column per model (fixed list); a missing response reads 'ERROR'."""
    piv = results.groupBy(*keys).pivot("model", list(models)).agg(F.max("response"))
    return piv.select(*keys, *[F.coalesce(F.col(f"`{m}`"), F.lit(K.ERROR_RESPONSE)).alias(m) for m in models])


def comparison_table(rows: DataFrame, results: DataFrame, models: Sequence[str], key: str = "row_id") -> DataFrame:
    """Every input row with one response column per model; an unanswered row reads 'ERROR' for each."""
    wide = rows.join(response_pivot(results, models, (key,)), key, "left")
    return wide.select(*rows.columns, *[F.coalesce(F.col(f"`{m}`"), F.lit(K.ERROR_RESPONSE)).alias(m) for m in models])


@dataclass(frozen=True)
class RetryPolicy:
    """When a failed call is tried again: time-outs, lost connections, and the listed HTTP status codes."""

    attempts: int = K.RETRY_ATTEMPTS
    backoff: float = K.RETRY_BACKOFF_SECONDS
    codes: frozenset = frozenset(K.RETRY_STATUS_CODES)
    sleep: Callable[[float], None] = time.sleep

    def again(self, error: Exception) -> bool:
        return isinstance(error, (TimeoutError, ConnectionError)) or getattr(error, "status_code", None) in self.codes

    def waits(self) -> Iterator[float]:
        return (self.backoff * 2 ** k for k in range(self.attempts))

    def run(self, call: Callable[[], dict]) -> tuple[dict | None, float]:
        """(reply, seconds of the last try); the reply is None when the call failed for good."""
        waits = self.waits()
        while True:
            began = time.perf_counter()
            try:
                return call(), time.perf_counter() - began
            except Exception as error:  # noqa: BLE001 - the client decides what it raises
                took = time.perf_counter() - began
                wait = next(waits, None) if self.again(error) else None
            if wait is None:
                return None, took
            self.sleep(wait)


_TOKENS = ("prompt_tokens", "completion_tokens", "total_tokens")


def call_models(tasks: DataFrame, client: Callable[[str, str, str], dict], partitions: int | None = None,
                attempts: int = K.RETRY_ATTEMPTS, backoff: float = K.RETRY_BACKOFF_SECONDS,
                sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Call ``client(model, system_prompt, user_prompt)`` once per task row, in the executors.

    ``client`` returns ``{"response", "prompt_tokens", "completion_tokens", "total_tokens"}`` or raises; see
    ``RetryPolicy`` for what is tried again. A call that finally fails yields response 'ERROR', NULL tokens and the
    latency of its last try. ``partitions`` bounds the concurrency.
    """
    policy = RetryPolicy(attempts, backoff, sleep=sleep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [policy.run(lambda t=t: client(t.model, t.system_prompt, t.user_prompt)) for t in b.itertuples()]
            replies = pd.DataFrame([r or {} for r, _ in done], index=b.index, columns=["response", *_TOKENS])
            failed = pd.Series([r is None for r, _ in done], index=b.index)
            yield pd.DataFrame({
                "row_id": b["row_id"], "model": b["model"], "response": replies["response"].mask(failed, K.ERROR_RESPONSE),
                "latency": [took for _, took in done], **{t: replies[t].astype("Int64") for t in _TOKENS},
                "status": failed.map({True: K.FAILED_STATUS, False: K.SUCCESS_STATUS})})

    if partitions:
        tasks = tasks.repartition(partitions)
    return tasks.select("row_id", "model", "system_prompt", "user_prompt").mapInPandas(run, RESULT_SCHEMA)
