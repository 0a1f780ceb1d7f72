"""Line dedup by content-defined chunks of lines.

A text is cut into lines: at each newline, and after one of . ! ? ; : and comma before a space (so that
a passage pasted into a paragraph also starts and ends at lines). Lines of more than ``LONG`` words are cut further, before
each word whose hash is not larger than those of the two words on either side (so a stretch of one word is cut at every word).

Texts are cut once; the cut texts are staged for all that follows.

1. A rolling hash over two line hashes runs down the text. A boundary is chosen wherever it is the smallest of some
   ``WINDOW`` neighbours (the last of equal ones), so the same lines choose the same boundaries in any surroundings, and every passage
   of ``WINDOW`` + 1 whole lines has one. The two lines at a boundary are its chunk.
2. Chunks whose hash occurs again, in any text, are grouped with the first occurrence by (doc_id, text hash, line). Those of one
   text that lie as far from their first occurrences, with no more than ``WINDOW`` lines between boundaries, are one stretch.
3. A stretch and its first occurrence, with the ``WINDOW`` - 1 lines on either side that may belong to the passage, are fetched and
   compared byte by byte, line by line. Runs of equal lines are repeats; so a passage is followed to its last whole line
   (where its outermost boundary first occurs in shorter surroundings, up to ``WINDOW`` - 1 lines beyond them stay), and lines
   whose hashes collide are told apart. A repeat that begins inside its own first occurrence begins after it.
4. Repeats that touch are one run. Runs of at least ``min_words`` words are removed; shorter ones stay.

Every removed line has an equal line at an earlier place, so one copy of everything stays.

Defined results: NULL text stays NULL. A document that has words and loses all of them is dropped. Rows with equal
doc_id and text are one document: each keeps or loses the same lines. NULL doc_ids sort first. Nothing else changes,
except n_chars (where the table has it) of changed texts. An empty table gives no rows; other columns, whatever their names, pass
through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import store
from auditlens.llm.quality_rules import let
from auditlens.llm.store import staged

MIN_WORDS = 40
#: Lines of more words are cut further.
LONG = 16
#: Neighbouring rolling hashes of which the smallest is a boundary (``_chunks`` spells out the comparisons).
WINDOW = 3
#: The space after a mark, which ends a line as newlines do.
_LINE_END = r" (?<=[.!?;:,] )"
#: Stands between the lines of a cut text; in texts that hold it, it is written as _ESC + B, and _ESC as _ESC + A.
_CUT, _ESC = "\x01", "\x02"
#: Hashes are hardly ever equal, so a dictionary of them is built in vain.
_PLAIN_HASHES = {"parquet.enable.dictionary#hash": "false"}


def _cut(text: Column) -> Column:
    """The text with a space in front and ``_CUT`` between its lines. Each line starts with its one white space."""
    def cut(part: Column) -> Column:
        return F.array_join(F.transform(F.split(part, _LINE_END), lambda x: F.when(_is_long(x), _cut_long(x)).otherwise(x)), _CUT + " ")

    # one character is split at without a pattern
    return F.concat(F.lit(" "), F.array_join(F.transform(F.split(_escaped(text), "\n"), cut), _CUT + "\n"))


def _cut_long(line: Column) -> Column:
    """A long line with ``_CUT`` before the space of each word whose hash is not larger than those around it. It is never
    next to either end: what stands there differs from place to place."""
    def ends(h: Column, i: Column) -> Column:
        """The next word starts a piece. Beyond the ends there are NULLs, and a comparison with them is not true."""
        x = F.get(h, i + 1)
        return (x <= F.get(h, i)) & (x <= F.get(h, i - 1)) & (x <= F.get(h, i + 2)) & (x <= F.get(h, i + 3))

    def joined(ws: Column, h: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w, i: F.when(ends(h, i), F.concat(w, F.lit(_CUT))).otherwise(w)), " ")

    return let(F.split(line, " "), lambda ws: let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: joined(ws, h)))


def _is_long(line: Column) -> Column:
    """At least ``LONG`` words, counted by the spaces, no further than asked."""
    return (F.octet_length(line) >= 2 * LONG) & (F.size(F.split(line, " ", LONG)) >= LONG)


def _escaped(text: Column) -> Column:
    own = F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + "A")), F.lit(_CUT), F.lit(_ESC + "B"))
    return F.when(text.contains(_CUT) | text.contains(_ESC), own).otherwise(text)


def _plain(text: Column) -> Column:
    own = F.replace(F.replace(text, F.lit(_ESC + "B"), F.lit(_CUT)), F.lit(_ESC + "A"), F.lit(_ESC))
    return F.when(text.contains(_ESC), own).otherwise(text)


def _lines(cut: Column) -> Column:
    return F.split(cut, _CUT)


def _alike(lines: Column) -> Column:
    """The lines with a space in front instead of a newline, so that equal lines are equal wherever they stand."""
    return F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("\n")), F.concat(F.lit(" "), F.substr(x, F.lit(2)))).otherwise(x))


def _hashes(cut: Column) -> Column:
    return F.transform(_alike(_lines(cut)), lambda x: F.xxhash64(x))


def lines_of(text: Column) -> Column:
    """The lines: joined, they give the text again. All but the first start with the white space before them."""
    return F.transform(_lines(_cut(text)), lambda x, i: _plain(F.when(i == 0, F.substr(x, F.lit(2))).otherwise(x)))


def _line_hashes(text: Column) -> Column:
    """A hash per line of ``lines_of``, the same whatever white space stands before the line."""
    return _hashes(_cut(text))


def _chunks(cut: Column) -> Column:
    """array<struct<s, hash>>: the chosen boundaries of a cut text, each with the rolling hash of its line and the next."""
    def boundaries(r: Column) -> Column:
        def chosen(x: Column, i: Column) -> Column:
            """Smallest, and last of equal ones, in one of the three windows that hold it. Beyond the ends there are NULLs,
            and a comparison with them is not true."""
            return ((x <= F.get(r, i - 1)) & ((x <= F.get(r, i - 2)) | (x < F.get(r, i + 1)))) | ((x < F.get(r, i + 1)) & (x < F.get(r, i + 2)))

        few = F.size(r) < WINDOW  # a text of fewer lines is all boundaries
        pairs = F.transform(r, lambda x, i: F.when(few | chosen(x, i), F.struct(i.alias("s"), x.alias("hash"))))
        return F.filter(pairs, lambda p: p.isNotNull())

    def rolling(h: Column) -> Column:
        return F.when(F.size(h) > 1, F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1),
                                                lambda x, y: F.xxhash64(x, y)))

    return let(let(_hashes(cut), rolling), boundaries)


def _cut_out(lines: Column, lo: Column, hi: Column) -> Column:
    """Lines lo to hi; NULL where there are none."""
    return F.transform(F.sequence(lo, hi), lambda j: F.when(j >= 0, F.get(lines, j)))


def _joined(ss: Column, gap: int) -> Column:
    """array<struct<s, e>>: maximal stretches of sorted numbers whose neighbours differ by at most ``gap``."""
    starts = F.filter(ss, lambda x, i: (i == 0) | (x - F.get(ss, i - 1) > gap))
    ends = F.filter(ss, lambda x, i: (i == F.size(ss) - 1) | (F.get(ss, i + 1) - x > gap))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("s"), b.alias("e")))


def _stretches(at: Column) -> Column:
    """array<struct<id0, mark0, lo0, hi0, shifts>>, from a text's sorted array<struct<id0, mark0, shift, a, b>>: the ranges lo0 to hi0 of
    first occurrences, each with the shifts of its repeats in the text."""
    def same(x: Column, y: Column, *names: str) -> Column:
        return x["id0"].eqNullSafe(y["id0"]) & reduce(lambda a, n: a & (x[n] == y[n]), names, F.lit(True))

    def follows(x: Column, y: Column) -> Column:
        return same(x, y, "mark0", "shift") & (y["a"] - x["b"] <= WINDOW)

    def ranges(at: Column) -> Column:
        starts = F.filter(at, lambda x, i: (i == 0) | ~follows(F.get(at, i - 1), x))
        ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | ~follows(x, F.get(at, i + 1)))
        return F.sort_array(F.zip_with(starts, ends, lambda x, y: F.struct(
            x["id0"].alias("id0"), x["mark0"].alias("mark0"), (x["a"] - x["shift"] - WINDOW + 1).alias("lo0"),
            (y["b"] - y["shift"] + WINDOW).alias("hi0"), x["shift"].alias("shift"))))

    def grouped(rs: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(rs) - 1),
                         lambda i: (i == 0) | ~same(F.get(rs, i - 1), F.get(rs, i), "mark0", "lo0", "hi0"))
        return let(heads, lambda hs: F.transform(hs, lambda i, k: F.struct(
            *[F.get(rs, i)[n].alias(n) for n in ("id0", "mark0", "lo0", "hi0")],
            F.slice(rs, i + 1, F.coalesce(F.get(hs, k + 1), F.size(rs)) - i)["shift"].alias("shifts"))))

    return let(let(at, ranges), grouped)


def _equal_runs(lines: Column) -> Column:
    """array<struct<s, e>>: the lines that are equal, byte by byte, to those of ``pieces``, as runs in order."""
    def equal(piece: Column, shift: Column) -> Column:
        places = F.sequence(piece["lo0"] + shift, piece["lo0"] + shift + F.size(piece["theirs"]) - 1)
        return F.filter(places, lambda j, i: F.get(piece["theirs"], i) == F.get(lines, j))

    def beyond(js: Column, shift: Column) -> Column:
        """Of a text's repeats of itself, what lies after the first occurrence."""
        return F.flatten(F.transform(_joined(js, 1), lambda r: F.sequence(F.greatest(r["s"], r["e"] - shift + 1), r["e"])))

    def covered(piece: Column) -> Column:
        return F.flatten(F.transform(piece["shifts"], lambda z: let(
            equal(piece, z), lambda js: F.when(piece["own"], beyond(js, z)).otherwise(js))))

    every = F.sort_array(F.array_distinct(F.flatten(F.transform("pieces", covered))))
    return let(every, lambda js: _joined(js, 1))


def _staged_cuts(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, mark, cut, row): the cut texts that are not NULL, with their hashes and the other columns of ``docs``."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct("*").dropFields("text").alias("row"))
    return staged(rows.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("mark"), _cut(F.col("text")).alias("cut"), "row"), folder, "cuts", compression="zstd")


def _stretches_of(cuts: DataFrame, folder: str) -> DataFrame:
    """(doc_id, mark, ranges): one row per text, a range of an earlier text once in it, however often the text repeats it."""
    # inline_outer: before inline, Spark filters by the size of the array, which computes it twice
    chunks = staged(cuts.select("doc_id", "mark", F.inline_outer(_chunks(F.col("cut")))).filter("hash IS NOT NULL"), folder, "chunks", **_PLAIN_HASHES)
    # hashes that occur again, with the smallest id that has them (NULL ids come first)
    again = (chunks.groupBy("hash").agg(F.count("*").alias("c"), F.min("doc_id").alias("id0"), F.count_if(F.col("doc_id").isNull()).alias("nameless"))
             .filter("c > 1").select("hash", F.when(F.col("nameless") == 0, F.col("id0")).alias("id0")))
    # each hash stands once in these tables, so no key makes a hashed partition large
    found = staged(chunks.join(staged(again, folder, "again").hint("shuffle_hash"), "hash"), folder, "found", **_PLAIN_HASHES)
    first = (found.filter(F.col("doc_id").eqNullSafe(F.col("id0"))).groupBy("hash").agg(F.min(F.struct("mark", "s")).alias("first"))
             .select("hash", F.col("first.mark").alias("mark0"), F.col("first.s").alias("s0")))
    repeats = (found.join(staged(first, folder, "first").hint("shuffle_hash"), "hash")
               .filter(~(F.col("doc_id").eqNullSafe(F.col("id0")) & (F.col("mark") == F.col("mark0")) & (F.col("s") == F.col("s0")))))
    # 32 lines to a number, so that a few rows for each of a text's ranges meet in its array
    blocks = (repeats.groupBy("doc_id", "mark", "id0", "mark0", (F.col("s") - F.col("s0")).alias("shift"), F.shiftright("s", 5).alias("block"))
              .agg(F.bit_or(F.expr("shiftleft(1L, s & 31)")).alias("bits")))
    at = F.sort_array(F.flatten(F.collect_list(_parts())))
    return staged(blocks.repartition("doc_id", "mark").groupBy("doc_id", "mark").agg(at.alias("at"))
                  .select("doc_id", "mark", _stretches(F.col("at")).alias("ranges")), folder, "stretches")


def _parts() -> Column:
    """array<struct<id0, mark0, shift, a, b>>: the lines of a block as stretches whose neighbours are at most ``WINDOW`` apart."""
    def near(shift: Callable) -> Column:
        return reduce(lambda x, y: x.bitwiseOR(y), [shift("bits", k) for k in range(1, WINDOW + 1)])

    def part(a: Column, b: Column) -> Column:
        return F.struct("id0", "mark0", "shift", (F.col("block") * 32 + a).alias("a"), (F.col("block") * 32 + b).alias("b"))

    def only(x: Column) -> Column:
        """The number of the only set bit: so many stand below it."""
        return F.bit_count((x - 1).bitwiseAND(F.bitwise_not(x)))

    def places(x: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(x, i) != 0)

    starts = F.col("bits").bitwiseAND(F.bitwise_not(near(F.shiftleft)))
    ends = F.col("bits").bitwiseAND(F.bitwise_not(near(F.shiftrightunsigned)))
    return F.when(F.bit_count(starts) == 1, F.array(part(only(starts), only(ends)))).otherwise(F.zip_with(places(starts), places(ends), part))


def _matched(cuts: DataFrame, stretches: DataFrame, marks: DataFrame, folder: str) -> DataFrame:
    """The rows of ``cuts`` whose hash is in ``marks``, with pieces array<struct<lo0, shifts, own, theirs>>: the lines of the earlier
    texts' ranges, where the text may repeat them. Only texts that are asked for are shuffled."""
    wanted = stretches.select("doc_id", "mark", F.inline("ranges"))
    origins = wanted.select(F.col("id0").alias("t_id"), F.col("mark0").alias("t_mark"), "lo0", "hi0").distinct()
    origins = origins.groupBy("t_id", "t_mark").agg(F.collect_list(F.struct("lo0", "hi0")).alias("asked"))
    some = store.small(staged(origins.select(F.col("t_mark").alias("some")).distinct(), folder, "origins"), 16)
    texts = cuts.select("doc_id", "mark", "cut").join(some, F.col("mark") == F.col("some"), "left_semi")
    theirs = (texts.join(origins, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("mark") == F.col("t_mark")))
              .select("t_id", "t_mark", F.inline_outer(let(_alike(_lines(F.col("cut"))), lambda lines: F.transform("asked", lambda r: F.struct(
                  r["lo0"].alias("t_lo"), r["hi0"].alias("t_hi"), _cut_out(lines, r["lo0"], r["hi0"]).alias("theirs")))))))
    # rows of equal id and text give the same
    theirs = staged(theirs.dropDuplicates(["t_id", "t_mark", "t_lo", "t_hi"]), folder, "theirs")
    both = wanted.join(theirs, F.col("id0").eqNullSafe(F.col("t_id")) & (F.col("mark0") == F.col("t_mark"))
                       & (F.col("lo0") == F.col("t_lo")) & (F.col("hi0") == F.col("t_hi")))
    own = F.col("doc_id").eqNullSafe(F.col("id0")) & (F.col("mark") == F.col("mark0"))
    # the join's keys are those of the grouping (NULL ids by a column of their own), so nothing is shuffled twice
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    pieces = (both.select(name.alias("p_name"), F.col("doc_id").isNull().alias("p_null"), F.col("mark").alias("p_mark"),
                          F.struct("lo0", "shifts", own.alias("own"), "theirs").alias("piece"))
              .groupBy("p_name", "p_null", "p_mark").agg(F.collect_list("piece").alias("pieces")))
    here = cuts.join(marks, F.col("mark") == F.col("some"), "left_semi").withColumns({"name": name, "nameless": F.col("doc_id").isNull()})
    return here.join(pieces, (F.col("name") == F.col("p_name")) & (F.col("nameless") == F.col("p_null")) & (F.col("mark") == F.col("p_mark")), "left")


def _marks(stretches: DataFrame, folder: str) -> DataFrame:
    return store.small(staged(stretches.select(F.col("mark").alias("some")).distinct(), folder, "marks"), 16)


def repeated_runs(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, mark, runs array<struct<s, e>>): the line ranges that repeat earlier ones, merged and in order;
    mark is the text's hash."""
    cuts = _staged_cuts(docs, folder)
    stretches = _stretches_of(cuts, folder)
    runs = let(_alike(_lines(F.col("cut"))), _equal_runs)
    found = _matched(cuts, stretches, _marks(stretches, folder), folder).filter("pieces IS NOT NULL")
    return found.select("doc_id", "mark", runs.alias("runs")).dropDuplicates(["doc_id", "mark"]).filter(F.size("runs") > 0)


def _has_words(text: Column, n: int) -> Column:
    """At least ``n`` words; looks no further than that many."""
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", n + 2), "")) >= n


def _cleaned(docs: DataFrame, min_words: int) -> DataFrame:
    """(row struct<the columns of docs but text>, text, removed): the rows with their remaining texts and the number of lines gone."""
    folder = store.scratch(docs.sparkSession, "lines")
    cuts = _staged_cuts(docs, folder)
    stretches = _stretches_of(cuts, folder)
    marks = _marks(stretches, folder)

    def piece(lines: Column, s: Column, e: Column) -> Column:
        return F.array_join(F.slice(lines, s + 1, e - s + 1), "")

    def long_runs(lines: Column) -> Column:
        runs = F.when(F.col("pieces").isNotNull(), let(_alike(lines), _equal_runs))
        return F.filter(runs, lambda r: _has_words(piece(lines, r["s"], r["e"]), min_words))

    def rest(lines: Column, runs: Column) -> Column:
        """What is left of the text, and the number of lines gone."""
        def after(k: Column) -> Column:
            return F.coalesce(F.get(runs, k - 1)["e"] + 1, F.lit(0))

        pieces = F.transform(runs, lambda r, k: piece(lines, after(k), r["s"] - 1))
        left = F.concat(F.array_join(pieces, ""), piece(lines, after(F.size(runs)), F.size(lines) - 1))
        gone = F.aggregate(runs, F.lit(0), lambda n, r: n + r["e"] + 1 - r["s"])
        # the white space in front of the first line is not the text's
        text = F.when(F.get(runs, F.lit(0))["s"] == 0, left).otherwise(F.substr(left, F.lit(2)))
        return F.struct(_plain(text).alias("text"), gone.cast("long").alias("removed"))

    done = let(_lines(F.col("cut")), lambda lines: let(F.coalesce(long_runs(lines), F.array().cast("array<struct<s:int,e:int>>")), lambda runs: rest(lines, runs)))
    # the user's columns stay inside one struct, so no name of theirs meets one of ours; only texts with repeats are shuffled
    touched = _matched(cuts, stretches, marks, folder).select("row", done.alias("done"))
    text = F.col("row.text").cast("string")
    rows = docs.select(F.struct("*").alias("row")).withColumn("mark", F.when(text.isNotNull(), F.xxhash64(text)))
    plain = F.struct(text.alias("text"), F.lit(0).cast("long").alias("removed"))
    passing = rows.join(marks, F.col("mark") == F.col("some"), "left_anti").select(F.col("row").dropFields("text").alias("row"), plain.alias("done"))
    return touched.unionByName(passing).select("row", "done.text", "done.removed")


def _columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` over ``_cleaned``, with the remaining text and its length."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kept = F.col("row.n_chars")
        new["n_chars"] = F.when(F.col("removed") > 0, F.char_length("text")).otherwise(kept).cast(docs.schema["n_chars"].dataType)
    return [(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns]


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated runs, with the columns of ``docs`` and _removed (the number of lines gone; ``docs`` may not have it)."""
    return _cleaned(docs, min_words).select(*_columns(docs), F.col("removed").alias("_removed"))


def keep_first(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` without repeated runs, with the columns of ``docs``; rows left without words go."""
    return _cleaned(docs, min_words).filter(_kept()).select(*_columns(docs))


def _kept() -> Column:
    return (F.col("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed, kept and the remaining text of every document."""
    out = _cleaned(store.documents(spark, sf_dir), MIN_WORDS)
    return out.select("row.doc_id", F.col("removed").alias("n_removed"), _kept().alias("kept"), "text")
