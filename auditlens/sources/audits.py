"""Audit tables from CSV files, each file's own headers resolved to the canonical fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from auditlens.sources.columns import find_verdict_column, map_columns
from auditlens.sources.csv import CsvScan, scan_csv

#: Default input names below the input folder.
MANUAL_FILE = "Manual Audits.csv"
AI_FILE = "AI Audits.csv"


def audit_headers(names: Sequence[str]) -> dict[str, str | None]:
    """Canonical name (call_id, auditor, verdict and the fields) -> header of one file."""
    found = map_columns(names) | {"verdict": find_verdict_column(names)}
    if found["call_id"] is None:
        raise ValueError(f"could not map the call id column of an audit file with the header {list(names)}")
    return found


@dataclass(frozen=True)
class AuditFiles:
    """``rows``: call_id, auditor, verdict, the fields, _has (which of them the row's file has a column for) and _seq.
    ``header_map``: (variant, field, cell, header). ``rejects`` and ``counts``: see ``CsvScan``."""

    rows: DataFrame
    header_map: DataFrame
    rejects: DataFrame
    counts: DataFrame


def read_audits(spark: SparkSession, paths: Sequence[str] | str, **options) -> AuditFiles:
    """Audit files of any header spellings and column orders; ``options`` go to ``scan_csv``."""
    scan: CsvScan = scan_csv(spark, paths, **options)
    return AuditFiles(scan.by_field(audit_headers), scan.place_table(audit_headers), scan.rejects(), scan.counts())


def default_inputs(spark: SparkSession, manual: str | None, ai: str | None, folder: str = "input") -> tuple[str, str]:
    """The given paths, or the default files of ``folder`` that exist."""
    def found(given: str | None, name: str) -> str:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(given or f"{folder}/{name}")
        if not given and not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise ValueError(f"no input given, and there is no {folder}/{name}")
        return given or f"{folder}/{name}"

    return found(manual, MANUAL_FILE), found(ai, AI_FILE)
