"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). Raking multiplies the cells by target / margin, one dimension
after the other, until every margin is within ``tolerance`` of its target; each sweep is written. A document of a
cell then has the calibrated value v = rate * all tokens * cell weight / cell tokens: it is sampled with probability
min(1, v), by a hash of its id, and counts with weight max(1, v), so that the expected weighted tokens meet the
targets at ``rate`` of the corpus.

A target is either a power (the observed share to that power, normalised: 1 keeps the mix, 0 makes it even) or a
mapping of values to shares (values not named get none).

Defined results: a NULL source, lang or text counts as empty text. Documents of a cell without tokens are sampled at
``rate``. Targets that structural zeros make unreachable stop the raking after ``sweeps``. Rows that repeat a doc_id
share one draw, as do NULL ids. An empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import store
from auditlens.llm.store import staged

Target = float | dict[str, float]
DIMENSIONS = ("source", "lang", "topic")
TARGETS: dict[str, Target] = {"source": 0.5, "lang": 0.7, "topic": 0.5}
RATE = 0.5


def topic_of(text: Column) -> Column:
    """A topic by form: tables, texts with figures, long and short prose."""
    return (F.when(text.contains(" | "), "table").when(text.rlike("[0-9]"), "figures")
            .when(F.char_length(text) >= 2000, "long prose").otherwise("short prose"))


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with _source, _lang, _topic (never NULL) and _tokens (words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    word = F.coalesce(topic if topic is not None else topic_of(text), F.lit(""))
    return docs.withColumns({"_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
                             "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_topic": word,
                             "_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")})


def _wanted(target: Target, value: str, share: str) -> Column:
    if isinstance(target, dict):
        table = F.create_map(*(F.lit(x) for pair in target.items() for x in pair)) if target else F.lit(None)
        return F.coalesce(F.try_element_at(table, F.col(value)) if target else F.lit(0.0), F.lit(0.0))
    return F.pow(F.col(share), F.lit(float(target)))


def rake(cells: DataFrame, targets: dict[str, Target], folder: str, tolerance: float = 1e-3, sweeps: int = 25) -> DataFrame:
    """(*dimensions, tokens, w): ``cells`` (*dimensions, tokens) with weights that sum to one and fit the targets."""
    dims = list(targets)
    live = cells.filter("tokens > 0")
    all_tokens = live.agg(F.sum("tokens")).first()[0]
    if not all_tokens:
        return live.withColumn("w", F.lit(0.0))
    cells = staged(live.withColumn("w", F.col("tokens") / F.lit(float(all_tokens))), folder, "cells-0")
    want = {}
    for d in dims:
        share = cells.groupBy(d).agg(F.sum("w").alias("share")).withColumn("t", _wanted(targets[d], d, "share"))
        total = share.agg(F.sum("t")).first()[0] or 1.0
        want[d] = staged(share.select(d, (F.col("t") / F.lit(total)).alias("t")), folder, f"want-{d}")
    for k in range(1, sweeps + 1):
        off = F.lit(0.0)
        for d in dims:
            margin = cells.groupBy(d).agg(F.sum("w").alias("m"))
            factor = margin.join(want[d], d).select(d, F.when(F.col("m") > 0, F.col("t") / F.col("m")).otherwise(0.0).alias("f"))
            cells = cells.join(factor, d)
            # how far this dimension's margin was off, before it is put right; a wholly excluded cell is settled
            off = F.greatest(off, F.when(F.col("w") > 0, F.abs(F.col("f") - 1)).otherwise(0.0))
            cells = cells.withColumn("w", F.col("w") * F.col("f")).withColumn("off", off).drop("f")
            off = F.col("off")
        cells = staged(cells, folder, f"cells-{k}")
        worst = cells.agg(F.max("off")).first()[0]
        cells = cells.drop("off")
        if worst < tolerance:
            break
    total = cells.agg(F.sum("w")).first()[0] or 1.0
    return cells.withColumn("w", F.col("w") / F.lit(total))


def mixed(docs: DataFrame, targets: dict[str, Target] = TARGETS, rate: float = RATE, seed: int = 9,
          topic: Column | None = None) -> DataFrame:
    """``docs`` with _source, _lang, _topic, _tokens, _value (calibrated v) and _kept."""
    folder = store.scratch(docs.sparkSession, "mixing")
    dims = [f"_{d}" for d in targets]
    known = described(docs, topic)
    cells = staged(known.groupBy(*dims).agg(F.sum("_tokens").alias("tokens")), folder, "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    fitted = rake(cells, {f"_{d}": t for d, t in targets.items()}, folder)
    value = staged(fitted.select(*dims, (F.col("w") * F.lit(rate * total) / F.col("tokens")).alias("_value")), folder, "values")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    out = known.join(store.small(value, 128), dims, "left").withColumn("_value", F.coalesce("_value", F.lit(rate)))
    return out.withColumn("_kept", draw < F.col("_value")).select(*docs.columns, "_source", "_lang", "_topic", "_tokens", "_value", "_kept")


def sample_mix(docs: DataFrame, targets: dict[str, Target] = TARGETS, rate: float = RATE, seed: int = 9) -> DataFrame:
    """The sampled rows of ``docs`` with its columns and mix_weight."""
    # the user's columns stay inside one struct, so no name of theirs meets one of ours
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang", "source")
    out = mixed(packed, targets, rate, seed).filter("_kept")
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "mix_weight"), F.greatest(F.lit(1.0), F.col("_value")).alias("mix_weight"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(store.documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
                      F.col("_tokens").alias("n_tokens"), F.least(F.lit(1.0), F.col("_value")).alias("probability"),
                      F.greatest(F.lit(1.0), F.col("_value")).alias("weight"), F.col("_kept").alias("kept"))
