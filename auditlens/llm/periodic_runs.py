"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of words with smallest period q, of at least max(``min_length``, ``exponent`` * q) words, that no
neighbour extends. For its first word s, the suffixes at s and s + q share exactly length - q words. So:

1. Suffixes whose first words occur only once are dropped: a run makes two suffixes of one text share at least
   min_length * (exponent - 1) / exponent words.
2. The others are sorted by prefix doubling; the ranks of every round give the LCP of neighbours by descending powers of two.
3. Neighbours are united by decreasing LCP, with union-find whose classes hold their positions in order, the smaller
   class entering the larger. Two positions i < j that become neighbours at LCP v, with (exponent - 1) * (j - i) <= v, seed
   the stretch from i with period j - i and j - i + v words. Its right end is exact, because v is their LCP; it is a run if the
   word before does not continue it. The period is the smallest: with a smaller one, a position between i and j
   would share at least as many words with both, and i and j would not be neighbours.

All texts of a slice go through steps 1 and 2 together; words of different texts never compare equal. Rows stay in their
task, nothing is shuffled; memory follows the words of repeating texts times the logarithm of their longest repeat.

Defined results: NULL and word-less texts have no runs and an empty collapsed text. Rows that repeat a doc_id are documents
of their own; a NULL doc_id stays NULL. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import store, words

MIN_LENGTH = 24
EXPONENT = 3


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def _levels(first: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words compared, ranks, positions whose rank is shared), doubling the words until no rank is shared.

    ``first`` ranks the single words. A rank is the number of positions that sort before; equal ranks mean that as many
    words are equal, all inside one text.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    key = first[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(new, n))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(new, size)
    rank[n] = -1
    active = order[np.repeat(size > 1, size)]
    w = 1
    while True:
        yield w, rank, active
        if not len(active) or w >= width:
            return
        # positions past the end of all texts come first; past the end of one's own text stand other texts' words
        key = rank[active] * (n + 1) + rank[np.minimum(active + w, n)] + 1
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(new, len(key)))
        group = rank[active[new]]  # every group of the round before is here as a whole
        opened = np.concatenate(([True], group[1:] != group[:-1]))
        base = new[np.maximum.accumulate(np.where(opened, np.arange(len(new)), 0))]
        rank = rank.copy()
        rank[active] = np.repeat(group + new - base, size)
        active = active[np.repeat(size > 1, size)]
        w *= 2


def _neighbours(first: np.ndarray, least: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, lcp): suffixes next to each other in sorted order that share ``least`` words or more, by decreasing lcp."""
    ranks, widths, members = [], [], None
    for w, rank, active in _levels(first, longest):
        if w <= least:
            ranks, widths, members = [], [], active
        ranks.append(rank)
        widths.append(w)
    if members is None or not len(members):
        return (np.empty(0, np.int64),) * 3
    sa = members[np.argsort(ranks[-1][members], kind="stable")]
    same = ranks[0][sa[1:]] == ranks[0][sa[:-1]]
    x, y = sa[:-1][same], sa[1:][same]
    lcp, n = np.zeros(len(x), np.int64), len(first)
    for rank, w in zip(reversed(ranks), reversed(widths)):
        more = np.ones(len(x), bool)
        while more.any():  # once a round, but for the narrowest ranks
            a, b = np.minimum(x + lcp, n), np.minimum(y + lcp, n)
            more &= (a < n) & (b < n) & (rank[a] == rank[b])
            lcp[more] += w
            if w != widths[0]:
                break
    # the rest, less than the narrowest width, word by word
    more = np.ones(len(x), bool)
    while more.any():
        a, b = np.minimum(x + lcp, n), np.minimum(y + lcp, n)
        more &= (a < n) & (b < n) & (first[np.minimum(a, n - 1)] == first[np.minimum(b, n - 1)])
        lcp[more] += 1
    keep = np.flatnonzero(lcp >= least)
    keep = keep[np.argsort(-lcp[keep], kind="stable")]
    return x[keep], y[keep], lcp[keep]


def _seeds(x: list[int], y: list[int], lcp: list[int], min_length: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(i, period, lcp) of positions that become neighbours of one class close enough to repeat."""
    parent: dict[int, int] = {}
    own: dict[int, list[int]] = {}

    def root(p: int) -> int:
        up = parent.setdefault(p, p)
        while up != parent[up]:
            parent[up] = up = parent[parent[up]]
        if up != p:
            parent[p] = up
        return up

    for a, b, v in zip(x, y, lcp):
        a, b = root(a), root(b)
        large, small = own.pop(a, None) or [a], own.pop(b, None) or [b]
        if len(large) < len(small):
            large, small, a, b = small, large, b, a
        parent[b] = a
        at = [bisect_left(large, p) for p in small]
        last = len(small) - 1
        for k, (p, i) in enumerate(zip(small, at)):
            # neighbours of the united class: the next of the other class, unless one of this class stands before it
            if i and (not k or at[k - 1] < i):
                d = p - large[i - 1]
                if d * (exponent - 1) <= v and d + v >= min_length:
                    yield large[i - 1], d, v
            if i < len(large) and (k == last or at[k + 1] > i):
                d = large[i] - p
                if d * (exponent - 1) <= v and d + v >= min_length:
                    yield p, d, v
        if last < 16:
            for p, i in zip(reversed(small), reversed(at)):
                large.insert(i, p)
        else:
            large += small
            large.sort()
        own[a] = large


def runs_of(counts: np.ndarray, codes: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) arrays of all runs, sorted; ``codes`` are the words of texts with ``counts`` words."""
    text_of = np.repeat(np.arange(len(counts)), counts)
    least = max(1, -(-min_length * (exponent - 1) // exponent))
    if not len(codes):
        return (np.empty(0, np.int64),) * 4
    # texts in which as many words as the largest power of two up to ``least`` occur twice, by hash: no run elsewhere
    h, w = words.mix(codes.astype(np.uint64) + np.uint64(1)), 1
    while 2 * w <= least and len(h) > w:
        h = words.chain(h[:-w], h[w:])
        w *= 2
    here = text_of[:len(h)]
    h, here = h[here == text_of[w - 1:w - 1 + len(h)]], here[here == text_of[w - 1:w - 1 + len(h)]]
    h = words.chain(h, here.astype(np.uint64))
    order = np.argsort(h, kind="stable")
    again = np.concatenate((h[order][1:] == h[order][:-1], [False])) if len(h) else np.empty(0, bool)
    some = np.zeros(len(counts), bool)
    some[here[order][again]] = True
    keep = some[text_of]
    if not keep.any():
        return (np.empty(0, np.int64),) * 4
    begins = np.concatenate(([0], np.cumsum(np.where(some, counts, 0))[:-1]))
    codes, text_of = codes[keep], text_of[keep]
    first = _dense(text_of * (int(codes.max()) + 1) + codes)
    x, y, lcp = _neighbours(first, least, int(counts[some].max()))
    seeds = np.array(list(_seeds(x.tolist(), y.tolist(), lcp.tolist(), min_length, exponent)), np.int64).reshape(-1, 3)
    i, d, v = seeds.T
    # not when the word before continues the period
    text, before = text_of[i], np.maximum(i - 1, 0)
    free = (i == begins[text]) | (first[before] != first[before + d])
    text, start, length, period = text[free], i[free] - begins[text[free]], (d + v)[free], d[free]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _digests(batches: Iterator[pa.RecordBatch], min_length: int, exponent: int) -> Iterator[pa.RecordBatch]:
    for b in words.pieces(batches, "text"):
        n = b.num_rows
        counts, codes, vocabulary = words.split_words(b.column("text"), lower=False)
        text, start, length, period = runs_of(counts, codes, min_length, exponent)
        # words after the first period of a run go
        ends = np.cumsum(counts)
        change = np.zeros(len(codes) + 1, np.int64)
        at = (ends - counts)[text] + start
        np.add.at(change, at + period, 1)
        np.add.at(change, at + length, -1)
        kept = np.cumsum(change[:-1]) == 0
        left = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], ends))]
        flat = pa.DictionaryArray.from_arrays(pa.array(codes[kept]), vocabulary).dictionary_decode() if len(codes) else pa.array([], pa.large_string())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat), pa.scalar(" ", pa.large_string())).cast(pa.large_binary())
        collapsed = [hashlib.sha256(t.as_buffer()).hexdigest() for t in joined]
        listed: list[list[str]] = [[] for _ in range(n)]
        best: list[tuple[int, int, int] | None] = [None] * n
        for k, s, c, q in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist()):
            listed[k].append(f"{s},{c},{q}\n")
            if best[k] is None or c * best[k][2] > best[k][1] * q:  # in order of start and period
                best[k] = s, c, q
        digests = [hashlib.sha256("".join(x).encode()).hexdigest() for x in listed]
        columns = [[x and x[j] for x in best] for j in range(3)]
        milli = [x and 1000 * x[1] // x[2] for x in best]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(x) for x in listed], pa.int64()), *(pa.array([x if best[i] else None for i, x in enumerate(c)], pa.int64()) for c in columns),
             pa.array(milli, pa.int64()), pa.array(digests), pa.array(collapsed)],
            ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def run_digests(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Per row: number of runs, the run of the greatest exponent, and digests of all runs and of the text without
    its repeated periods."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda bs: _digests(bs, min_length, exponent),
                           "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                           "runs_sha256 string, collapsed_sha256 string")


def _listed(batches: Iterator[pa.RecordBatch], min_length: int, exponent: int) -> Iterator[pa.RecordBatch]:
    for b in words.pieces(batches, "text"):
        counts, codes, _ = words.split_words(b.column("text"), lower=False)
        text, *rest = runs_of(counts, codes, min_length, exponent)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(text)), *map(pa.array, rest)], ["doc_id", "start", "length", "period"])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, start, length, period): one row per run."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda bs: _listed(bs, min_length, exponent), "doc_id long, start long, length long, period long")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` in which every tenth document, by the crc32 of its id, repeats a stretch of its own words to its end.

    Such a text's words are joined by one space; others, and texts with a NULL id, stay as they are.
    """
    text = F.col("text").cast("string")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(ws: Column) -> Column:
        g, n = F.floor(h / 10), F.size(ws)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (F.lit(3) + g % 8)) + 1).cast("int")
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, a + (i - a) % p))), " ")

    chosen = docs.withColumn("_ws", F.when(h % 10 == 0, split))
    return chosen.select("doc_id", F.when(F.size("_ws") > 0, planted(F.col("_ws"))).otherwise(text).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(with_planted_periods(store.documents(spark, sf_dir).select("doc_id", "text")))
