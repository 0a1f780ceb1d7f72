"""File-based inputs: screenshot listings and prompt templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions.template import split_template

IMAGE_GLOB = "*.{png,jpg,jpeg,PNG,JPG,JPEG}"


def list_images(spark: SparkSession, dirs: Sequence[str] | str, with_content: bool = True) -> DataFrame:
    """Images under one or more folders: path, length and SHA-256 of the bytes.

    One row per file; a screenshot's bytes are bounded by the file itself.
    """
    dirs = [dirs] if isinstance(dirs, str) else list(dirs)
    df = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).load(dirs)
    cols = [F.col("path"), F.col("length")]
    if with_content:
        cols.append(F.sha2(F.col("content"), 256).alias("content_hash"))
    return df.select(*cols).dropDuplicates(["path"])


def load_template(spark: SparkSession, path: str) -> tuple[str, str]:
    """(system, user) template parts of one small template file."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    return split_template(text)
