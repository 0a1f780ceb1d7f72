"""Preference formatting: chosen and rejected conversations to one prompt and two masked completions.

The turns of a pair are compared one by one (role and text); the turns before the first difference are the longest
common prefix and are rendered once, as the prompt. What follows is rendered as the chosen and the rejected
completion, with the character ranges of assistant texts, on which a loss is taken. Everything happens on single
turns; strings are put together per pair and block of ``BLOCK`` turn numbers, so no group is unbounded. Ordinary
pairs have one block, number 0; longer ones continue in the next.

Defined results: a NULL role renders as ``unknown``, a NULL text as empty. Turns that repeat a (pair, turn) number
count once: the smallest (role, text). A NULL turn number counts as -1, before all others. A NULL pair_id is a pair
of its own. A side that ends early differs from there on. Equal conversations have a prompt and no completions
(paired is false). Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import store
from auditlens.llm.store import staged

BLOCK = 1024
START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(rows: DataFrame, key: str) -> DataFrame:
    """(pair_id, turn, said struct<role, text>): one row per turn number."""
    said = F.struct(F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (rows.select(F.col(key).alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), said.alias("said"))
            .groupBy("pair_id", "turn").agg(F.min("said").alias("said")))


def _head(said: Column) -> Column:
    return F.concat(F.lit(START), said["role"], F.lit(BREAK))


def _render(turns: Column, side: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t[side]), t[side]["text"], F.lit(END))), "")


def _mask(turns: Column, side: str) -> Column:
    """start:end of each assistant text within the rendered turns, comma-joined."""

    def before(i: Column) -> Column:
        return F.aggregate(F.slice(turns, 1, i), F.lit(0), lambda a, t: a + F.length(_head(t[side])) + F.length(t[side]["text"]) + len(END))

    def span(t: Column, i: Column) -> Column:
        s = before(i) + F.length(_head(t[side]))
        return F.when(t[side]["role"] == "assistant", F.concat_ws(":", s.cast("string"), (s + F.length(t[side]["text"])).cast("string")))

    return F.array_join(F.transform(turns, span), ",")


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """(pair_id, block, paired, n_prompt, n_chosen, n_rejected, prompt, chosen, rejected, chosen_mask, rejected_mask)
    from two turn tables (``key``, turn, role, text)."""
    folder = store.scratch(chosen.sparkSession, "preference")
    both = (_turns(chosen, key).select("pair_id", "turn", F.col("said").alias("c"), F.lit(None).cast("struct<role:string,text:string>").alias("r"))
            .unionByName(_turns(rejected, key).select("pair_id", "turn", F.lit(None).cast("struct<role:string,text:string>").alias("c"), F.col("said").alias("r")))
            .groupBy("pair_id", "turn").agg(F.min("c").alias("c"), F.min("r").alias("r")))
    both = staged(both, folder, "turns")
    cut = staged(both.filter(~F.col("c").eqNullSafe(F.col("r"))).groupBy("pair_id").agg(F.min("turn").alias("cut")), folder, "cuts")
    b, k = both.alias("b"), cut.withColumnRenamed("pair_id", "_pair").alias("k")
    turns = b.join(k, F.col("b.pair_id").eqNullSafe(F.col("k._pair")), "left")
    turns = turns.withColumn("shared", F.col("cut").isNull() | (F.col("turn") < F.col("cut")))
    t = F.struct("turn", "c", "r")
    got = (turns.withColumn("block", F.floor(F.greatest("turn", F.lit(0)) / BLOCK)).groupBy("pair_id", "block").agg(
        F.max(F.col("cut").isNotNull()).alias("paired"),
        F.sort_array(F.collect_list(F.when(F.col("shared"), t))).alias("p"),
        F.sort_array(F.collect_list(F.when(~F.col("shared") & F.col("c").isNotNull(), t))).alias("cs"),
        F.sort_array(F.collect_list(F.when(~F.col("shared") & F.col("r").isNotNull(), t))).alias("rs")))
    return got.select("pair_id", "block", "paired", *(F.size(x).cast("long").alias(n) for x, n in (("p", "n_prompt"), ("cs", "n_chosen"), ("rs", "n_rejected"))),
                      _render(F.col("p"), "c").alias("prompt"), _render(F.col("cs"), "c").alias("chosen"), _render(F.col("rs"), "r").alias("rejected"),
                      _mask(F.col("cs"), "c").alias("chosen_mask"), _mask(F.col("rs"), "r").alias("rejected_mask"))


def echo_pairs(conversations: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) turn tables from plain conversations: chosen ends with the last assistant turn; rejected
    answers there with an echo of the turn before it. Conversations without an assistant turn are equal on both sides."""
    turns = staged(_turns(conversations, "conv_id").select(F.col("pair_id"), "turn", "said.role", "said.text"), folder, "all")
    last = staged(turns.filter("role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("last")), folder, "last")
    k = last.withColumnRenamed("pair_id", "_pair")
    upto = turns.join(k, F.col("pair_id").eqNullSafe(F.col("_pair")), "left").filter("last IS NULL OR turn <= last").drop("_pair")
    upto = staged(upto, folder, "upto")
    echo = staged(upto.filter("turn < last").groupBy("pair_id").agg(F.max_by("text", "turn").alias("echo")), folder, "echo")
    e = echo.withColumnRenamed("pair_id", "_pair")
    answer = (upto.filter("turn = last").join(e, F.col("pair_id").eqNullSafe(F.col("_pair")), "left")
              .select("pair_id", "turn", "role", F.coalesce("echo", F.lit("")).alias("text")))
    rest = upto.filter("last IS NULL OR turn < last").select("pair_id", "turn", "role", "text")
    return upto.select("pair_id", "turn", "role", "text"), rest.unionByName(answer)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_pairs(*echo_pairs(conversations, store.scratch(spark, "pairs")))


ORACLE = r"""
WITH t AS (SELECT conv_id AS pair_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT pair_id, max(turn) AS last FROM t WHERE role = 'assistant' GROUP BY pair_id),
u AS (SELECT t.*, l.last FROM t LEFT JOIN l USING (pair_id) WHERE l.last IS NULL OR turn <= l.last),
e AS (SELECT *, lag(text) OVER (PARTITION BY pair_id ORDER BY turn) AS before FROM u),
s AS (SELECT pair_id, turn, '<|im_start|>' || role || chr(10) AS head, text, coalesce(before, '') AS echo,
             turn = last AND text <> coalesce(before, '') AS differs, turn // 1024 AS block FROM e),
g AS (SELECT pair_id, greatest(block, 0) AS block, bool_or(coalesce(differs, false)) AS paired,
             count(*) FILTER (NOT coalesce(differs, false)) AS n_prompt, count(*) FILTER (differs) AS n_chosen,
             coalesce(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (NOT coalesce(differs, false)), '') AS prompt,
             coalesce(max(head || text || '<|im_end|>' || chr(10)) FILTER (differs), '') AS chosen,
             coalesce(max(head || echo || '<|im_end|>' || chr(10)) FILTER (differs), '') AS rejected,
             coalesce(max(length(head) || ':' || (length(head) + length(text))) FILTER (differs), '') AS chosen_mask,
             coalesce(max(length(head) || ':' || (length(head) + length(echo))) FILTER (differs), '') AS rejected_mask
      FROM s GROUP BY 1, 2)
SELECT pair_id, block, paired, n_prompt, n_chosen, n_chosen AS n_rejected, prompt, chosen, rejected, chosen_mask, rejected_mask FROM g
"""
