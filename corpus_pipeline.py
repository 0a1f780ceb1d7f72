"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder of ``spark.checkpoint.dir`` and reads it back as the next stage's docs, so lineage ends at every stage.
All but the last return the columns of ``documents``; the last adds mix_weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlens.llm import decontamination, line_dedup, minhash_dedup, mixing, quality_classifier, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that repeat an earlier one."""
    return line_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in the target mix."""
    return mixing.sample_mix(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("mix", mix)]

#: Training by gradient steps, content-defined chunks and raking have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.scratch(spark, "pipeline")
    docs = store.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store.staged(stage(spark, docs, sf_dir), folder, name)
    return docs
