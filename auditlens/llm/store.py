"""Shared helpers: folds by id, written intermediates, checked broadcasts.

Intermediates go to Parquet in the shared folder that ``spark.checkpoint.dir`` names, so every
executor can read them and a lost executor costs only its own tasks. A folder of our own is made
only where that setting is absent (tests on one machine).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run of operator ``name`` below the shared checkpoint folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str, name: str, **options: str) -> DataFrame:
    """``df`` written to ``folder/name`` and read back: lineage ends, nothing is computed twice. ``options`` are Parquet's."""
    df.write.options(**options).parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``. A NULL id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast when its counted size is below ``BROADCAST_BYTES``; otherwise as it is,
    and the join shuffles (adaptive execution splits its skewed partitions)."""
    limit = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names differ beyond case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
