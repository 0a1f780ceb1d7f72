"""Report sinks: versioned report folders, CSV tables and metric text files.

A version folder is claimed by creating it exclusively, and published by a manifest that is written last. Two jobs
that run at once get two versions; a folder without a manifest belongs to a job that is running or was
killed, and readers pass it over.

Paths may be any Hadoop-compatible URI; listing goes through the session's
Hadoop FileSystem so it works the same on a shared cluster store.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VERSION = re.compile(r"v=(\d+)$")
#: The file that holds a version for one job, and the one that publishes it.
CLAIM = "_CLAIM"
MANIFEST = "_MANIFEST.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, base: str, published: bool = True) -> list[int]:
    """Version numbers below ``base``, ascending; ``published`` leaves out those without a manifest."""
    fs, p = _fs(spark, base)
    found = []
    for st in fs.listStatus(p) if fs.exists(p) else []:
        m = _VERSION.search(st.getPath().getName())
        if m and (not published or fs.exists(_fs(spark, f"{base.rstrip('/')}/{m.group(0)}/{MANIFEST}")[1])):
            found.append(int(m.group(1)))
    return sorted(found)


def latest_version(spark: SparkSession, base: str) -> str | None:
    """The folder of the highest published version."""
    done = versions(spark, base)
    return f"{base.rstrip('/')}/v={done[-1]}" if done else None


def _claim(spark: SparkSession, folder: str) -> bool:
    """Take ``folder`` if no other job has it."""
    fs, p = _fs(spark, folder)
    jvm = spark.sparkContext._jvm
    try:
        if fs.getScheme() == "file":  # Hadoop's local create() tests and writes in two steps; a directory is made in one
            fs.mkdirs(p.getParent())
            jvm.java.nio.file.Files.createDirectory(jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)),
                                                    spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            return True
        if fs.exists(p):  # a folder of someone else, or of an older layout without a claim
            return False
        return bool(fs.createNewFile(_fs(spark, f"{folder}/{CLAIM}")[1]))
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def next_version(spark: SparkSession, base: str) -> str:
    """``base/v=N``, claimed for the caller, with N above every existing version (1 when none)."""
    n = max(versions(spark, base, published=False), default=0)
    while True:
        n += 1
        folder = f"{base.rstrip('/')}/v={n}"
        if _claim(spark, folder):
            return folder


def publish(spark: SparkSession, folder: str) -> None:
    """Write the manifest, which lists the tables of ``folder``: from now on it is a version."""
    fs, p = _fs(spark, folder)
    names = sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory() and not st.getPath().getName().startswith(("_", ".")))
    out = fs.create(_fs(spark, f"{folder}/{MANIFEST}")[1], False)
    try:
        out.write(bytearray(json.dumps({"tables": names}).encode()))
    finally:
        out.close()


@contextmanager
def new_version(spark: SparkSession, base: str) -> Iterator[str]:
    """A claimed folder to write to; published when the block ends well."""
    folder = next_version(spark, base)
    yield folder
    publish(spark, folder)


def read_latest(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Table ``name`` of the highest published version."""
    folder = latest_version(spark, base)
    if folder is None:
        raise ValueError(f"no published version under {base}")
    return spark.read.parquet(f"{folder}/{name}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    if fmt == "csv":  # RFC 4180 quoting: a quote inside a field is doubled
        w = w.option("header", True).option("escape", '"')
    w.format(fmt).save(path)


def stage_bucketed(df: DataFrame, path: str, key: str, buckets: int = 64) -> DataFrame:
    """``df`` written to ``path`` in buckets of ``key``, one sorted file each: aggregates and joins by ``key`` over tables staged
    with the same number of buckets need no exchange. The table's name lives as long as the session, its files longer."""
    name = f"staged_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name))
    return df.sparkSession.table(name)


def write_reports(spark: SparkSession, tables: dict[str, DataFrame], base: str, fmt: str = "parquet") -> str:
    """Write every report table under a new version folder and publish it; returns that folder."""
    with new_version(spark, base) as out:
        for name, df in tables.items():
            write_table(df, f"{out}/{name}", fmt)
    return out


def metric_lines(metrics: DataFrame) -> DataFrame:
    """``metric : value`` text lines of a (metric, value) table."""
    return metrics.select(F.concat_ws(" : ", F.col("metric"), F.col("value").cast("string")).alias("value"))


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    # a metrics table has a handful of rows: one output file is intended
    metric_lines(metrics).coalesce(1).write.mode(mode).text(path)
