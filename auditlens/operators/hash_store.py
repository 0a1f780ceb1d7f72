"""A growing table keyed by content hash, laid out so that a look-up reads only what may hold its keys.

Rows are partitioned by the first characters of the hash and sorted by hash inside each file, and every file carries
Parquet's Bloom filter of its hashes. A look-up takes the prefixes that it asks for (at most 16 ** ``PREFIX`` of
them, whatever the batch) as a partition filter, so other prefixes are not listed or read. A batch of few hashes
also goes down to the scan as an IN list, which the Bloom filters answer for whole row groups; only rows that really match
come back. Larger batches are semi-joined, which Spark broadcasts while the batch is the small side. What is joined to the
batch in the end are the hits, never the stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the hash that name a partition.
PREFIX = 2
#: Up to so many distinct hashes are looked up as a list.
LISTED = 1000
PREFIX_COLUMN = "hash_prefix"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class HashStore:
    """The table at ``path``, with its hashes in ``hash_col``."""

    def __init__(self, spark: SparkSession, path: str, hash_col: str = "content_hash"):
        self.spark, self.path, self.hash_col = spark, path, hash_col

    def _prefix(self):
        # the letter in front keeps partition values from being read as numbers
        return F.concat(F.lit("h"), F.substring(self.hash_col, 1, PREFIX))

    def append(self, rows: DataFrame) -> None:
        """Add ``rows``, one file per prefix that occurs; a prefix holds a 16 ** ``PREFIX``-th of any batch."""
        if rows.isEmpty():
            return
        name = f"parquet.bloom.filter.enabled#{self.hash_col}"
        (rows.withColumn(PREFIX_COLUMN, self._prefix()).repartition(PREFIX_COLUMN).sortWithinPartitions(PREFIX_COLUMN, self.hash_col)
         .write.mode("append").partitionBy(PREFIX_COLUMN).option(name, "true").parquet(self.path))

    def rows(self) -> DataFrame | None:
        """Everything stored; None before the first ``append``."""
        return self.spark.read.parquet(self.path) if exists(self.spark, self.path) else None

    def hits(self, asked: DataFrame) -> DataFrame:
        """The distinct hashes of ``asked`` that are stored."""
        stored, asked = self.rows(), asked.select(self.hash_col)
        if stored is None:
            return asked.limit(0)
        hashes = asked.filter(F.col(self.hash_col).isNotNull()).distinct()
        few = [r[0] for r in hashes.limit(LISTED + 1).collect()]
        if len(few) <= LISTED:
            prefixes = sorted({f"h{h[:PREFIX]}" for h in few})
            found = stored.filter(F.col(PREFIX_COLUMN).isin(prefixes) & F.col(self.hash_col).isin(few))
        else:
            prefixes = sorted(r[0] for r in hashes.select(self._prefix()).distinct().collect())  # at most 16 ** PREFIX
            found = stored.filter(F.col(PREFIX_COLUMN).isin(prefixes)).join(hashes, self.hash_col, "left_semi")
        return found.select(self.hash_col).distinct()

    def new_only(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` whose hash is not stored; a NULL hash counts as new."""
        return df.join(self.hits(df), self.hash_col, "left_anti")
