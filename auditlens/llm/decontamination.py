"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` writes the postings (row, position, term) of every training token that is a term of the benchmark:
each task writes segments sorted by term, so looking a term up prunes row groups. A phrase (a window of
``WINDOW`` consecutive item words, or a whole shorter item) is searched from its two rarest terms: their postings,
shifted by their offsets, are intersected first; the remaining terms are intersected only where both agree.
``exact_phrases`` returns the start of each occurrence; ``proximity`` returns rows in which all terms of an item's
window occur within a span of positions.

Defined results: words are the runs of ASCII letters and digits and of all characters beyond ASCII, A-Z folded.
NULL texts have no words. Items without words or without item_id are skipped; rows that repeat an item_id are one
item. Every document row is reported on its own; repeated rows are reported each. Ties in rarity go to the smaller
offset. An empty benchmark finds nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import store
from auditlens.llm.store import staged

WINDOW = 13
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words (before A-Z is folded).
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _fold(word: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def benchmark_terms(benchmark: DataFrame) -> DataFrame:
    """(item, pos, word): the words of every item in order."""
    text = F.col("text").cast("string")
    # rows of one item_id count as one item: each row keeps its own phrase, the id is shared
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), text.alias("text")).filter("item IS NOT NULL").distinct()
    words = F.filter(F.split("text", _GAP), lambda w: w != "")
    return (rows.select("item", F.xxhash64("item", "text").alias("phrase"), F.posexplode(words).alias("pos", "word"))
            .withColumn("word", _fold(F.col("word"))))


def build_index(docs: DataFrame, terms: DataFrame, folder: str) -> DataFrame:
    """Written postings (row, pos, term) of ``docs`` for the words of ``terms`` (word, term). The row at the first
    position of each document also carries doc_id and n_words, whether or not its word is a term."""
    words = F.split(F.col("text").cast("string"), _GAP)
    tokens = (docs.select("doc_id", words.alias("words"))
              .select(F.monotonically_increasing_id().alias("row"), "doc_id",
                      F.coalesce(F.size(F.array_remove("words", "")), F.lit(0)).cast("long").alias("n_words"), "words")
              .select("row", "doc_id", F.greatest("n_words", F.lit(0)).alias("n_words"), F.posexplode_outer("words").alias("pos", "raw")))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    found = (tokens.withColumn("word", _fold(F.col("raw"))).join(store.small(terms, 64), "word", "left")
             .filter(F.col("term").isNotNull() | first)
             .select("row", "pos", "term", F.when(first, F.col("doc_id")).alias("doc_id"),
                     F.when(first, F.col("n_words")).alias("n_words"), first.alias("first")))
    return staged(found.sortWithinPartitions("term", "row", "pos"), folder, "index")


def plan_phrases(items: DataFrame, index: DataFrame, window: int, folder: str) -> DataFrame:
    """(item, phrase, start, words array<struct<df, off, term>> rarest first) of every window whose terms all occur."""
    df = index.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    known = items.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    length = items.groupBy("phrase").agg(F.max("pos").alias("top")).select(
        "phrase", F.least(F.lit(window), F.col("top") + 1).alias("size"), "top")
    # a word at pos belongs to the windows that start at pos-size+1 .. pos
    spread = (known.join(length, "phrase")
              .withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("size") + 1),
                                                        F.least("pos", F.col("top") - F.col("size") + 1)))))
    return staged(spread.groupBy("item", "phrase", "start")
                  .agg(F.array_sort(F.collect_list(F.struct("df", (F.col("pos") - F.col("start")).alias("off"), "term"))).alias("words"))
                  .filter("words[0].df > 0"), folder, "phrases")


def exact_phrases(index: DataFrame, phrases: DataFrame, folder: str) -> DataFrame:
    """(row, item, at, size): every place where a window's words stand in a row. Written."""
    postings = index.filter("term IS NOT NULL").select("row", "pos", "term")
    rare = phrases.withColumn("a", F.col("words")[0]).withColumn("b", F.col("words")[F.least(F.size("words"), F.lit(2)) - 1])
    wid = ["phrase", "start"]
    ends = rare.select(*wid, F.col("a.term").alias("term"), F.col("a.off").alias("off"),
                       F.col("b.term").alias("term2"), F.col("b.off").alias("off2"))
    seen = store.small(ends.select("term").union(ends.select(F.col("term2"))).distinct(), 8)
    lists = staged(postings.join(seen, "term", "left_semi"), folder, "rare")
    one = lists.join(store.small(ends, 64), "term").select(
        *wid, "row", (F.col("pos") - F.col("off")).alias("at"), F.col("term2").alias("term"), (F.col("pos") - F.col("off") + F.col("off2")).alias("pos"))
    both = staged(one.join(lists, ["row", "pos", "term"]).select(*wid, "row", "at"), folder, "pairs")
    rest = (both.join(store.small(phrases, 512), wid)
            .select("item", *wid, "row", "at", F.size("words").alias("size"), F.explode("words").alias("w"))
            .select("item", *wid, "row", "at", "size", (F.col("at") + F.col("w.off")).alias("pos"), F.col("w.term").alias("term")))
    there = postings.join(store.small(both.select("row").distinct(), 8), "row", "left_semi")
    return staged(rest.join(there, ["row", "pos", "term"]).groupBy("row", "item", *wid, "at", "size")
                  .agg(F.count("*").alias("n")).filter("n = size").select("row", "item", "at", "size").distinct(), folder, "hits")


def proximity(index: DataFrame, phrases: DataFrame, span: int, folder: str) -> DataFrame:
    """(row, item, phrase, start): rows in which every distinct term of a window has a posting within ``span``
    positions of a posting of the window's rarest term."""
    postings = index.filter("term IS NOT NULL").select("row", "pos", "term")
    need = phrases.select("item", "phrase", "start", F.col("words")[0]["term"].alias("term"),
                          F.array_distinct(F.transform("words", lambda w: w["term"])).alias("terms"))
    near = postings.join(store.small(need, 256), "term").select(
        "item", "phrase", "start", "row", F.col("pos").alias("at"), F.size("terms").alias("wanted"), F.explode("terms").alias("term"))
    near = staged(near, folder, "near")
    # positions are put in cells of one span: a partner lies in the same cell or a neighbour
    cell = F.floor(F.col("at") / span)
    near = near.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    hit = near.join(postings.withColumn("cell", F.floor(F.col("pos") / span)), ["row", "term", "cell"])
    return (hit.filter(F.abs(F.col("pos") - F.col("at")) <= span)
            .select("row", "item", "phrase", "start", "at", "wanted", "term").distinct()
            .groupBy("row", "item", "phrase", "start", "at", "wanted").agg(F.count("*").alias("n")).filter("n = wanted")
            .select("row", "item", "phrase", "start").distinct())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    folder = store.scratch(docs.sparkSession, "decontaminate")
    words = staged(benchmark_terms(benchmark), folder, "items")
    terms = words.select("word").distinct().withColumn("term", F.xxhash64("word"))
    index = build_index(docs.select("doc_id", "text"), terms, folder)
    phrases = plan_phrases(words.withColumn("term", F.xxhash64("word")), index, window, folder)
    hits = exact_phrases(index, phrases, folder)
    n_hit = (hits.select("row", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("pos")).distinct()
             .groupBy("row").agg(F.count("*").alias("n_hit")))
    items = (hits.select("row", "item").distinct().groupBy("row")
             .agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("ids")))
    found = staged(n_hit.join(items, "row"), folder, "found")
    return (index.filter("first").select("row", "doc_id", "n_words").join(found, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                    F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose id has no contaminated row, with the columns of ``docs``."""
    name = store.free(docs, "gone")
    gone = contamination(docs, benchmark, window).filter("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(store.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0 AND item IS NOT NULL),
bi AS (SELECT item, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM bl),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i
       FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM di),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.phrase = bw.phrase),
hp AS (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hp GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
