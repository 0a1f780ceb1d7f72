"""Queries over CSV files: audits written with several header spellings, read back file by file.

The orders' audits are written as three folders of CSV files whose headers differ in spelling, order and columns: the second has no
verdict, the third no reminder. Some records carry one cell more than their header. ``*_sql`` spell the same in DuckDB.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.plans import audit_job as AJ
from auditlens.plans import driver_tables as D
from auditlens.plans import oracle as O
from auditlens.session import checkpoint_dir
from auditlens.sources.audits import AuditFiles, read_audits

N_SPELLINGS = 3
#: One record in this many has a surplus cell.
SURPLUS_EVERY = 50
SURPLUS_CELL = "left over"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _spellings() -> list[list[tuple[str, str]]]:
    """Per folder: (header, name in ``ai_audits`` or 'note'), in the folder's own order."""
    own = ["call_id", "Call Verdict", *D.AI_HEADERS]
    shouted = [(h.upper().replace(" ", "_") + "_", a) for h, a in zip(D.MANUAL_HEADERS, D.AI_HEADERS)]
    spaced = [(" " + h.lower(), a) for h, a in zip(D.MANUAL_HEADERS, D.AI_HEADERS) if h != "Reminder"]
    return [[(h, h) for h in own] + [("Note", "note")],
            [*shouted, ("Note", "note"), ("CALLID", "call_id")],
            [("Verdict", "Call Verdict"), ("Note", "note"), *reversed(spaced), ("Call-Id", "call_id")]]


def _note(key: Column) -> Column:
    """A text that a CSV file has to quote."""
    return F.concat(F.lit('says "'), key.cast("string"), F.lit('", twice'))


def _line(cells: list[Column], surplus: Column) -> Column:
    quoted = [F.when(c.rlike('[",]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
              for c in cells]
    return F.concat_ws(",", *quoted, F.when(surplus, F.lit(SURPLUS_CELL)))


def write_spellings(spark: SparkSession, sf_dir: str) -> list[str]:
    """The folders of CSV files, one per spelling."""
    base = scratch(spark, "spellings")
    rows = D.ai_audits(spark, sf_dir).withColumn("note", _note(F.col("_seq")))
    surplus = F.col("_seq") % SURPLUS_EVERY == 0
    folders = []
    for v, columns in enumerate(_spellings()):
        header = ",".join(h for h, _ in columns)
        lines = rows.filter(F.col("_seq") % N_SPELLINGS == v).select(_line([F.col(f"`{a}`") for _, a in columns], surplus).alias(header))
        folders.append(f"{base}/spelling{v}")
        # whole lines: neither commas nor quotes mean anything to this writer, so every file gets its header and raw records
        (lines.write.option("header", True).option("sep", "\t").option("quote", "\x02").option("escape", "\x02")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folders[-1]))
    return folders


def _files(spark: SparkSession, sf_dir: str) -> AuditFiles:
    return read_audits(spark, write_spellings(spark, sf_dir))


def csv_intake_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label summary of audits read from files of three header spellings."""
    rows = _files(spark, sf_dir).rows
    return AJ.AuditReport(rows, rows).table("ai_summary")


def csv_intake_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, good and rejected ones per spelling."""
    folder = F.regexp_extract("file", r"/spelling(\d+)/", 1).cast("int").alias("spelling")
    sums = [F.sum(c).alias(c) for c in ("records", "good", "rejected")]
    return _files(spark, sf_dir).counts.groupBy(folder).agg(*sums)


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that no header has room for, with their raw text."""
    return _files(spark, sf_dir).rejects.select(F.regexp_extract("file", r"/spelling(\d+)/", 1).cast("int").alias("spelling"),
                                                "reason", "n_cells", "n_header", "raw")


def csv_header_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which header of which variant fills which field."""
    return _files(spark, sf_dir).header_map


def csv_intake_summary_sql() -> str:
    base = (f"SELECT *, s1 % {N_SPELLINGS} AS spelling FROM ({O.ai_src()}) WHERE s1 % {SURPLUS_EVERY} <> 0 "
            f"AND (s1 % {N_SPELLINGS} = 1 OR lower(trim(verdict)) IN ('yes', 'no'))")
    return O.summary_of(base, {K.FIELDS.index("reminder"): "spelling <> 2"})


def csv_intake_counts_sql() -> str:
    bad = f"count(*) FILTER (WHERE o_orderkey % {SURPLUS_EVERY} = 0)"
    return (f"SELECT CAST(o_orderkey % {N_SPELLINGS} AS INTEGER) AS spelling, count(*) AS records, count(*) - {bad} AS good, "
            f"{bad} AS rejected FROM orders GROUP BY 1")


def csv_rejects_sql() -> str:
    parts = []
    for v, columns in enumerate(_spellings()):
        names = {"call_id": "call_id_raw", "Call Verdict": "verdict", "note": "'\"says \"\"' || s1 || '\"\", twice\"'"}
        cells = ", ".join(f"coalesce({names.get(a) or f'f{D.AI_HEADERS.index(a)}'}, '')" for _, a in columns)
        parts.append(f"SELECT {v} AS spelling, 'surplus cells' AS reason, {len(columns) + 1} AS n_cells, {len(columns)} AS n_header, "
                     f"concat_ws(',', {cells}, {O.q(SURPLUS_CELL)}) AS raw FROM ({O.ai_src()}) "
                     f"WHERE s1 % {N_SPELLINGS} = {v} AND s1 % {SURPLUS_EVERY} = 0")
    return " UNION ALL ".join(parts)


def csv_header_map_sql() -> str:
    """Variants are numbered by their sorted headers: capitals, then 'Verdict', then small letters."""
    where = {"call_id": "call_id", "Call Verdict": "verdict"} | dict(zip(D.AI_HEADERS, K.FIELDS))
    rows = []
    for variant, v in enumerate((1, 2, 0)):
        columns = _spellings()[v]
        cells = {where[a]: (i, h) for i, (h, a) in enumerate(columns) if a in where}
        for field in ("call_id", "auditor", *K.FIELDS, "verdict"):
            i, h = cells.get(field, (None, None))
            rows.append(f"({variant}, {O.q(field)}, {'NULL' if i is None else i}, {O.q(h)})")
    return ("SELECT CAST(v AS INTEGER) AS variant, field, CAST(c AS INTEGER) AS cell, header "
            f"FROM (VALUES {', '.join(rows)}) AS t(v, field, c, header)")


QUERIES = {f.__name__: f for f in (csv_intake_summary, csv_intake_counts, csv_rejects, csv_header_map)}
ORACLE = {f.__name__.removesuffix("_sql"): f for f in (csv_intake_summary_sql, csv_intake_counts_sql, csv_rejects_sql, csv_header_map_sql)}
