"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

``RULES`` names ratios of counted columns with their bounds; ``verdict`` turns the table into one boolean
expression over integers (no division, so no rounding). All counts come from the whole text.

Defined results: NULL text counts as empty: no words, so it fails the base rule. Lines are split at \\n and count
when they have a word. Repeated rows are each judged; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import store

_SPACE = r"[\x20\x09-\x0D]+"
#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = ("the of and to in a is that it was for on are as with his they at be this have from or by "
              "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
              "de la le et les des en un une du que est pour qui dans par sur pas au plus "
              "el los las y del se por con no su para es al lo como más o pero sus").split()


@dataclass(frozen=True)
class Rule:
    """``low`` / 1000 <= top / bottom <= ``high`` / 1000, applied from ``from_words`` words on."""

    name: str
    top: str
    bottom: str
    low: int | None = None
    high: int | None = None
    from_words: int = 0


RULES = (
    Rule("mean word length", "word_chars", "n_words", low=2_000, high=12_000),
    Rule("symbols per word", "n_symbols", "n_words", high=300),
    Rule("stop words per word", "n_stop_words", "n_words", low=10, from_words=50),
    Rule("repeated lines per line", "n_dup_lines", "n_lines", high=400),
    Rule("listed lines per line", "n_list_lines", "n_lines", high=900, from_words=50),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the same array."""

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def in_repeats(windows: Column) -> Column:
        def marked(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
            return let(F.array_sort(F.transform(again, lambda x: x["i"])), covered)

        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, marked))

    def windows_of(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashed, lambda h: let(windows_of(h), in_repeats))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counted columns of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.array_remove(F.split("text", _SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    return parts.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^\s*(?:[-*•]|[0-9]+[.)])\s"))).cast("long").alias("n_list_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one boolean expression."""

    def one(r: Rule) -> Column:
        top, bottom = F.col(r.top) * 1000, F.col(r.bottom)
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (top >= bottom * r.low)
        if r.high is not None:
            ok = ok & (top <= bottom * r.high)
        return (F.col("n_words") < r.from_words) | ok

    return reduce(lambda a, b: a & b, map(one, rules))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base_failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                 base_failed.alias("base_failed"), (~base_failed & verdict(rules)).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(store.documents(spark, sf_dir))


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, unnest(range(1, CAST(len(w) - 3 AS BIGINT))) AS i, w FROM d WHERE len(w) >= 5),
wt AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS t FROM win),
rep AS (SELECT doc_id, i FROM wt QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '^\s*(?:[-*•]|[0-9]+[.)])\s'))) AS n_list_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words
  FROM d LEFT JOIN rw USING (doc_id)),
v AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars * 1000 BETWEEN n_words * 2000 AND n_words * 12000
       AND n_symbols * 1000 <= n_words * 300 AND (n_words < 50 OR n_stop_words * 1000 >= n_words * 10)
       AND n_dup_lines * 1000 <= n_lines * 400 AND (n_words < 50 OR n_list_lines * 1000 <= n_lines * 900) AS kept
FROM v
"""
