"""Near-duplicate groups by b-bit MinHash.

1. ``sketch``: words of the whole text, distinct 5-word shingles (fewer words: the whole sequence), ``HASHES``
   minima; ``BANDS`` band keys from groups of minima; the low ``BITS`` bits of every minimum packed into longs.
2. Texts with equal shingle sets form a class (128-bit set key); only the member with the smallest id goes on.
3. The smallest member of a band key's bucket is its hub. Each document is first compared with the smallest hub of
   its buckets, which gives it at most one link upwards, then with the hubs that those links do not lead to the same
   place; so a large group costs about one pair per document.
   A candidate survives if the sizes allow the similarity and if the collision-corrected estimate from the bit counts
   is not far below the threshold (five standard errors); then the full sets are compared.
4. A bucket whose members still lie in different components may hide links between two of them: there, the members
   outside the bucket's largest component are joined, in blocks, with all members of other components, by a finer signature of
   ``FINE`` minima of ``FINE_BITS`` bits (its first ``ROUGH`` minima first), so that few pairs below the threshold leave their
   block to be compared in full. Members of one component are
   never paired, so a large group of copies with a few strangers costs rows in proportion to its size.
5. Connected components are found once, over classes and confirmed links; what step 4 adds joins whole components.

With 32 bands of 4 minima a pair at the threshold 0.75 is missed with probability 5e-6, and less above.

Defined results: a text without words has an empty set, links with nothing and is kept. Rows that repeat a
doc_id are one document: their links add up. A NULL doc_id links with nothing (component_id NULL) and is kept.
Ties go to the smallest doc_id. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm import store, words
from auditlens.llm.components import components
from auditlens.llm.store import staged

WIDTH = 5
HASHES = 128
BANDS = 32
BITS = 4
#: Minima of the finer signature that documents in crowded buckets get, and the bits of each.
FINE = 4096
FINE_BITS = 2
#: Minima of the finer signature that every pair of a block is tried by; the rest are for those that pass.
ROUGH = 1024
#: Members per block when an unresolved bucket is compared with itself.
BLOCK = 1024


def shingles(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingle hashes."""
    counts, codes, vocab = words.split_words(texts, lower=True)
    w = words.hash_vocabulary(vocab)[codes] if len(codes) else np.empty(0, np.uint64)
    full = words.chain(*(w[i:len(w) - width + 1 + i] for i in range(width))) if len(w) >= width else w[:0]
    for n, end in zip(counts, np.cumsum(counts)):
        if n >= width:
            yield np.unique(full[end - n:end - width + 1])
        elif n:
            yield words.chain(*(w[i:i + 1] for i in range(end - n, end)))
        else:
            yield w[:0]


def _minima(h: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    a = (words.mix(np.arange(1, hashes + 1, dtype=np.uint64)) | np.uint64(1))[:, None]
    b = words.mix(np.arange(hashes + 1, 2 * hashes + 1, dtype=np.uint64))[:, None]
    low = np.full(hashes, np.iinfo(np.uint64).max)
    step = (1 << 17) // hashes
    for s in range(0, len(h), step):
        low = np.minimum(low, (h[None, s:s + step] * a + b).min(axis=1))
    return words.mix(low)


def _pack(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the minima, 64 / bits of them to a long."""
    lanes = (low & np.uint64((1 << bits) - 1)).reshape(-1, 64 // bits)
    return np.bitwise_or.reduce(lanes << (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits)), axis=1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = np.arange(1, BANDS + 1, dtype=np.uint64)
    for b in words.pieces(batches, "text"):
        n, keys, bands, packed = [], [], [], []
        for h in shingles(b.column("text")):
            n.append(len(h))
            keys.append((words.mix(h).sum(dtype=np.uint64), words.mix(h ^ np.uint64(0xA5)).sum(dtype=np.uint64)))
            if len(h):
                low = _minima(h)
                bands.append(words.chain(band, *low.reshape(BANDS, -1).T).view(np.int64).tolist())
                packed.append(_pack(low).view(np.int64).tolist())
            else:
                bands.append([])
                packed.append([])
        k = np.array(keys, np.uint64).reshape(len(keys), 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]),
                                          pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))],
                                         ["doc_id", "n", "a", "b", "bands", "sig"])


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), a and b (set key), bands, sig (packed low bits) for every row."""
    return docs.mapInArrow(_sketch, "doc_id long, n long, a long, b long, bands array<long>, sig array<long>")


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in words.pieces(batches, "text"):
        fine = [_pack(_minima(h, FINE), FINE_BITS).view(np.int64).tolist() for h in shingles(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fine, pa.list_(pa.int64()))], ["doc_id", "fine"])


def _differing(x: Column, bits: int) -> Column:
    """The lanes of ``bits`` bits in which ``x``, an exclusive or, has a bit."""
    fold = 1
    while fold < bits:  # any differing bit of a lane shows in its lowest
        x = x.bitwiseOR(F.shiftrightunsigned(x, fold))
        fold *= 2
    lowest = sum(1 << k for k in range(0, 64, bits))
    return F.bit_count(x if bits == 1 else x.bitwiseAND(F.lit(lowest)))


def estimate(left: Column, right: Column, hashes: int = HASHES, bits: int = BITS) -> Column:
    """Collision-corrected similarity of two packed signatures: differing lanes by bit counts, then
    (share of equal lanes - C) / (1 - C), where C = 2^-bits is the chance that other minima look equal."""
    longs = hashes * bits // 64
    if longs <= 32:
        differ = F.lit(0)
        for i in range(longs):
            differ = differ + _differing(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i))), bits)
    else:  # spelled out, so many would make a method that is never compiled
        lanes = F.zip_with(F.slice(left, 1, longs), F.slice(right, 1, longs), lambda x, y: _differing(x.bitwiseXOR(y), bits))
        differ = F.aggregate(lanes, F.lit(0), lambda a, x: a + x)
    chance = 2.0 ** -bits
    return ((hashes - differ) / hashes - chance) / (1 - chance)


def _near_enough(left: Column, right: Column, per_cent: int, hashes: int, bits: int) -> Column:
    """The estimate is at most five standard errors below the threshold."""
    chance = 2.0 ** -bits
    same = chance + (1 - chance) * per_cent / 100
    error = (same * (1 - same) / hashes) ** 0.5 / (1 - chance)
    return estimate(left, right, hashes, bits) >= per_cent / 100 - 5 * error


def _sizes_allow(a: str, b: str, per_cent: int) -> Column:
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * per_cent


def _estimated(pairs: DataFrame, reps: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (x, y) whose signatures make the similarity possible."""
    sig = reps.select("doc_id", "n", "sig")
    return (pairs.join(sig.select(F.col("doc_id").alias("x"), F.struct("n", "sig").alias("p")), "x")
            .join(sig.select(F.col("doc_id").alias("y"), F.struct("n", "sig").alias("q")), "y")
            .filter(_sizes_allow("p", "q", per_cent) & _near_enough(F.col("p.sig"), F.col("q.sig"), per_cent, HASHES, BITS))
            .select("x", "y").distinct())


def _confirm(batches: Iterator[pa.RecordBatch], per_cent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = b.column("p"), b.column("q")
        ok = np.zeros(b.num_rows, bool)
        for i in range(b.num_rows):
            p, q = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (left, right))
            both = len(np.intersect1d(p, q, assume_unique=True))
            ok[i] = 100 * both >= per_cent * (len(p) + len(q) - both) and both > 0
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([b.column("x").filter(keep), b.column("y").filter(keep)], ["x", "y"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in words.pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([h.tobytes() for h in shingles(b.column("text"))],
                                                                       pa.binary())], ["doc_id", "grams"])


def _confirmed(pairs: DataFrame, docs: DataFrame, folder: str, name: str, per_cent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""
    ids = staged(pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct(),
                 folder, f"{name}-ids")
    sets = staged(docs.join(store.small(ids, 16), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, grams binary"),
                  folder, f"{name}-sets")
    full = (pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("grams").alias("p")), "x")
            .join(sets.select(F.col("doc_id").alias("y"), F.col("grams").alias("q")), "y"))
    return staged(full.mapInArrow(lambda bs: _confirm(bs, per_cent), "x long, y long").distinct(), folder, f"{name}-links")


def near_duplicates(docs: DataFrame, per_cent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    folder = store.scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(sketch(docs), folder, "sketch")

    # classes of equal sets; copies of a class link to its smallest id
    named = rows.filter("n > 0 AND doc_id IS NOT NULL")
    shared = staged(named.groupBy("a", "b", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("c"))
                    .filter("c > 1").drop("c"), folder, "classes")
    marked = named.join(shared, ["a", "b", "n"], "left")
    reps = staged(marked.filter("first IS NULL OR first = doc_id").select("doc_id", "n", "bands", "sig"), folder, "reps")
    copies = staged(named.select("doc_id", "a", "b", "n").join(shared, ["a", "b", "n"]).filter("first <> doc_id")
                    .select(F.col("doc_id").alias("a"), F.col("first").alias("b")), folder, "copies")

    # buckets of two and more
    exploded = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    buckets = staged(exploded.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"))
                     .filter("hub < last").drop("last"), folder, "buckets")
    members = staged(exploded.join(buckets, "key"), folder, "members")

    def linked(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(the confirmed ones of ``pairs``, the pairs that were tried)."""
        tried = staged(pairs, folder, f"{name}-pairs")
        near = staged(_estimated(tried, reps, per_cent), folder, f"{name}-near")
        return _confirmed(near, docs, folder, name, per_cent), tried

    def as_edges(links: DataFrame) -> DataFrame:
        return links.select(F.col("x").alias("a"), F.col("y").alias("b"))

    # every document against the smallest hub of its buckets: at most one link upwards each
    best = members.filter("doc_id <> hub").groupBy(F.col("doc_id").alias("x")).agg(F.min("hub").alias("y"))
    up, tried = linked(best, "best")
    # then against the other hubs, unless two steps upwards from both ends meet
    above = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
    top = staged(up.join(above, "y", "left").select("x", F.coalesce("z", "y").alias("top")), folder, "top")
    ends = (members.filter("doc_id <> hub").select(F.col("doc_id").alias("x"), F.col("hub").alias("y")).distinct()
            .join(top, "x", "left").join(top.select(F.col("x").alias("y"), F.col("top").alias("other")), "y", "left"))
    others = ends.filter(F.coalesce("top", "x") != F.coalesce("other", "y")).select("x", "y").join(tried, ["x", "y"], "left_anti")
    links, more = linked(others, "hubs")
    tried = tried.unionByName(more)
    found = staged(components(copies.unionByName(as_edges(up)).unionByName(as_edges(links)), folder, "round"), folder, "found")

    # buckets in which two members other than the hub lie in different components
    where = found.select(F.col("u").alias("doc_id"), "component")
    at = staged(members.join(where, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), folder, "at").filter("doc_id <> hub")
    shares = at.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_keys = staged(shares.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("c"),
                                                 F.max("n").alias("most")).filter("c > most")
                       .select("key", "major", F.ceil((F.col("c") - F.col("most")) / BLOCK).cast("int").alias("rows"),
                               F.ceil(F.col("c") / BLOCK).cast("int").alias("cols")), folder, "open")
    if not open_keys.isEmpty():
        crowd = staged(at.join(open_keys, "key"), folder, "crowd")
        crowd_ids = staged(crowd.select("doc_id").distinct(), folder, "crowd-ids")
        finer = staged(docs.join(store.small(crowd_ids, 16), "doc_id", "left_semi").mapInArrow(_finer, "doc_id long, fine array<long>")
                       .distinct(), folder, "finer")
        side = staged(crowd.join(reps.select("doc_id", "n", "bands"), "doc_id").join(finer, "doc_id")
                      .select("key", "major", "rows", "cols", "doc_id", "component", "n", "fine", F.slice("bands", F.lit(1), F.col("band")).alias("earlier"))
                      .distinct(), folder, "side")

        def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
            """Each row in its own block of one axis and in every block of the other."""
            return (df.withColumn(f"{own}_at", F.pmod(F.xxhash64("doc_id"), F.col(own)).cast("int"))
                    .withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1))))

        p, q = dealt(side.filter("component <> major"), "rows", "cols").alias("p"), dealt(side, "cols", "rows").alias("q")
        cross = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.rows_at") == F.col("q.rows_at")) & (F.col("p.cols_at") == F.col("q.cols_at"))
                       & (F.col("p.component") != F.col("q.component"))
                       # a pair outside the largest component is met once
                       & ((F.col("q.component") == F.col("q.major")) | (F.col("p.doc_id") < F.col("q.doc_id")))
                       & _sizes_allow("p", "q", per_cent) & _near_enough(F.col("p.fine"), F.col("q.fine"), per_cent, ROUGH, FINE_BITS)
                       # a pair that shares several buckets counts in the first of them
                       & ~F.arrays_overlap("p.earlier", "q.earlier")
                       & _near_enough(F.col("p.fine"), F.col("q.fine"), per_cent, FINE, FINE_BITS))
        pairs = (cross.select(F.greatest("p.doc_id", "q.doc_id").alias("x"), F.least("p.doc_id", "q.doc_id").alias("y")).distinct()
                 .join(tried, ["x", "y"], "left_anti"))
        links, _ = linked(pairs, "cross")
        # these links join whole components: only their roots are worked again
        root = lambda end: where.select(F.col("doc_id").alias(end), F.col("component").alias(f"{end}_root"))
        joined = (links.join(root("x"), "x", "left").join(root("y"), "y", "left")
                  .select(F.coalesce("x_root", "x").alias("a"), F.coalesce("y_root", "y").alias("b")))
        last = staged(components(joined, folder, "last"), folder, "joined").select(F.col("u").alias("component"), F.col("component").alias("low"))
        roots = found.unionByName(last.select(F.col("component").alias("u"), "component")).distinct()
        found = roots.join(last, "component", "left").select("u", F.coalesce("low", "component").alias("component")).distinct()

    return (rows.select("doc_id", F.col("n").alias("n_shingles"))
            .join(found.withColumnRenamed("u", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, per_cent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest id of its group, with the columns of ``docs``."""
    name = store.free(docs, "gone")
    gone = near_duplicates(docs, per_cent).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(store.documents(spark, sf_dir))
