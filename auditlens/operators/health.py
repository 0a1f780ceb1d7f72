"""Model health check over a probe log: keyword exclusion, error classification,
healthy / broken split and the error-type breakdown.

The probing itself (HTTP) is not part of the library: the input is a probe
log ``(model, http_status, body, exception, <order>)``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.text import _c, truncate
from auditlens.operators.dedupe import last_per_key


def keyword_excluded(c, keywords=K.SKIP_MODEL_KEYWORDS) -> Column:
    """True when the lower-cased id contains any skip keyword."""
    return F.lower(_c(c)).rlike("|".join(re.escape(k) for k in keywords))


def candidate_models(models: DataFrame, col: str = "model", keywords=K.SKIP_MODEL_KEYWORDS) -> DataFrame:
    """Distinct model ids without a skip keyword (sort at report time)."""
    return models.select(F.col(col).alias("model")).filter(~keyword_excluded("model", keywords)).distinct()


def classify_error(c) -> Column:
    """Ordered substring rules on the lower-cased message; 'Unknown' when none applies."""
    low = F.lower(_c(c))
    out = None
    for label, tokens in K.ERROR_CLASS_RULES:
        hit = None
        for t in tokens:
            h = low.contains(t)
            hit = h if hit is None else (hit | h)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(K.ERROR_CLASS_DEFAULT))


def error_text(status, body, exception) -> Column:
    """Error text of a failed probe: ``error.message`` of a JSON body, else the raw
    body; the exception text when no HTTP answer came back."""
    msg = F.try_variant_get(F.try_parse_json(_c(body)), "$.error.message", "string")
    return F.when(_c(status).isNull(), _c(exception)).otherwise(F.coalesce(msg, _c(body)))


def probe_outcomes(probes: DataFrame, order, model_col="model", status_col="http_status",
                   body_col="body", exception_col="exception") -> DataFrame:
    """Latest probe per model -> (model, status, error_type, error, error_short): the whole error text and the
    report's short form of it."""
    latest = last_per_key(probes.select(F.col(model_col).alias("model"), F.col(status_col).alias("http_status"),
                                        F.col(body_col).alias("body"), F.col(exception_col).alias("exception"),
                                        F.struct(*[F.col(o) for o in order]).alias("_ord")),
                          "model", "_ord")
    err = error_text(F.col("http_status"), F.col("body"), F.col("exception"))
    healthy = F.col("http_status") == 200
    return latest.select(
        "model",
        F.when(healthy, F.lit("Healthy")).otherwise(F.lit("Broken")).alias("status"),
        F.when(healthy, F.lit("")).otherwise(classify_error(err)).alias("error_type"),
        F.when(healthy, F.lit("")).otherwise(err).alias("error"),
        F.when(healthy, F.lit("")).otherwise(truncate(err)).alias("error_short"),
    )


def health_summary(outcomes: DataFrame) -> DataFrame:
    """Healthy / broken counts and the count per error type among broken models."""
    counts = outcomes.agg(F.count_if(F.col("status") == "Healthy").alias("healthy"),
                          F.count_if(F.col("status") == "Broken").alias("broken"))
    head = counts.select(F.inline(F.array(
        F.struct(F.lit("healthy").alias("metric"), F.col("healthy").alias("value")),
        F.struct(F.lit("broken").alias("metric"), F.col("broken").alias("value")))))
    breakdown = (outcomes.filter(F.col("status") == "Broken").groupBy("error_type").count()
                 .select(F.concat(F.lit("error:"), F.col("error_type")).alias("metric"),
                         F.col("count").alias("value")))
    return head.unionByName(breakdown)
