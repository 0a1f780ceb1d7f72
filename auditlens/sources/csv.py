"""Robust CSV scan for audit spreadsheets exported as CSV.

* files are read by NAME: every file's own header row says which column is which, so files with other column
  orders, extra or missing columns go together;
* encoding per file: a distributed validity check of the raw line bytes (``is_valid_utf8``) picks UTF-8, else
  Latin-1 (which decodes any byte);
* every column is read as text (no inference: ids like ``007`` stay intact);
* pandas' default NA strings become NULL right after the scan;
* ``_seq`` records input order (file, split, position) for first/last-row-wins;
* a row with more cells than its file's header names goes to the rejects, with file, position and raw text, unless
  all the surplus cells are empty. ``read_csv`` alone refuses such rows, as pandas does; ``scan_csv`` gives both sides.
  A row with fewer cells is filled with NULL, as by pandas, or rejected too (``short_rows="reject"``);
* a blank header cell still names a column (``Unnamed: 2``), also at the end of the header.

The rows come from Spark's permissive CSV parser: rows of another width than the widest header carry their raw text in the
corrupt-record column, from which their cells are counted; rows of that width need no count.

What is known per file (encoding, header) stays a table that the rows are joined to; only the distinct headers
reach the driver, sorted, so that column order never depends on the run. Paths are never rebuilt from metadata, so spaces,
``%`` and brackets in them do no harm.

``multiLine`` parsing (quoted newlines) makes a file one split; for very large single files, stage them to Parquet
once and read that instead. A header cell may not hold a newline.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.sources.columns import resolve_column


#: More distinct headers than this are taken for a mistake (data files without header rows).
MAX_HEADERS = 1000


def file_facts(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(file, utf8, commas): per file, are all bytes valid UTF-8, and the commas of its first line."""
    t = spark.read.text(paths if isinstance(paths, str) else list(paths))
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    commas = F.length("value") - F.length(F.replace("value", F.lit(","), F.lit("")))
    return (t.select(F.col("_metadata.file_path").alias("file"), F.expr("is_valid_utf8(value)").alias("ok"), commas.alias("n"), at.alias("at"))
            .groupBy("file").agg(F.bool_and("ok").alias("utf8"), F.min_by("n", "at").alias("commas")))


def null_tokens(df: DataFrame, tokens: Sequence[str] = K.CSV_NA_TOKENS, skip=("_seq", "_raw")) -> DataFrame:
    """Exact-match NA strings -> NULL over every string column."""
    toks = list(tokens)
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype == "string" and name not in skip:
            c = F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c)
        cols.append(c.alias(name))
    return df.select(*cols)


def pandas_header_names(names: Sequence[str]) -> list[str]:
    """Repeated header names suffixed pandas-style: ``A, A`` -> ``A, A.1``.

    Spark resolves names case-insensitively, so ``A`` and ``a`` also count as a
    repeat (``A, a`` -> ``A, a.1``); pandas would keep both as they are.
    """
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n.lower(), 0)
        out.append(n if k == 0 else f"{n}.{k}")
        seen[n.lower()] = k + 1
    return out


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Column names of a header row: blank cells are ``Unnamed: i``, repeats are suffixed."""
    return pandas_header_names([(h or "").removeprefix("\ufeff") or f"Unnamed: {i}" for i, h in enumerate(cells)])


@dataclass(frozen=True)
class CsvScan:
    """Rows of CSV files before their cells are named.

    ``rows``: _cells (array), _raw (NULL when the row has as many cells as the widest header), _n (cells), _variant
    (which of ``headers`` its file has) and _seq. ``headers``: the distinct header rows as column names, sorted.
    """

    rows: DataFrame
    headers: list[list[str]]
    short_rows: str
    na_tokens: Sequence[str] | None

    def _width(self) -> Column:
        return F.get(F.array(*[F.lit(len(h)) for h in self.headers]), F.col("_variant"))

    def problem(self) -> Column:
        """Why a row cannot be placed; NULL for a good one."""
        surplus = F.col("_n") - self._width()
        # trailing commas are surplus cells without anything in them
        empty = F.coalesce(F.length("_raw") - F.length(F.rtrim(F.col("_raw"), F.lit(","))), F.lit(0)) >= surplus
        out = F.when((surplus > 0) & ~empty, F.lit("surplus cells"))
        return out.when(surplus < 0, F.lit("missing cells")) if self.short_rows == "reject" else out

    def good(self) -> DataFrame:
        return self.rows.filter(self.problem().isNull())

    def rejects(self) -> DataFrame:
        """(file, block, pos, reason, n_cells, n_header, raw) of the rows that are not in ``good``."""
        raw = F.coalesce(F.col("_raw"), F.array_join(F.transform("_cells", lambda c: F.coalesce(_quoted(c), F.lit(""))), ","))
        return (self.rows.withColumn("reason", self.problem()).filter("reason IS NOT NULL")
                .select("_seq.file", "_seq.block", "_seq.pos", "reason", F.col("_n").alias("n_cells"), self._width().alias("n_header"), raw.alias("raw")))

    def counts(self) -> DataFrame:
        """(file, records, good, rejected): every record of every file is one or the other."""
        bad = self.problem().isNotNull()
        return (self.rows.groupBy(F.col("_seq.file").alias("file"))
                .agg(F.count("*").alias("records"), F.count_if(~bad).alias("good"), F.count_if(bad).alias("rejected")))

    def by_name(self, rows: DataFrame | None = None) -> DataFrame:
        """The good rows with a column for every header name of any file; names differ beyond case."""
        places: dict[str, tuple[str, list[tuple[int, int]]]] = {}
        for v, names in enumerate(self.headers):
            for i, name in enumerate(names):
                places.setdefault(name.lower(), (name, []))[1].append((v, i))
        out = []
        for name, at in places.values():
            cell = F.lit(None).cast("string")
            for v, i in at:
                cell = F.when(F.col("_variant") == v, F.get("_cells", F.lit(i))).otherwise(cell)
            out.append(cell.alias(name))
        named = (self.good() if rows is None else rows).select(*out, "_seq")
        return null_tokens(named, self.na_tokens) if self.na_tokens else named

    def unified(self, groups: Sequence[Sequence[str]]) -> CsvScan:
        """One name per group of aliases: the column that a header has for a group takes the group's first alias."""
        def names(header: list[str]) -> list[str]:
            hits = {resolve_column(header, aliases): aliases[0] for aliases in groups}
            return pandas_header_names([hits.get(h, h) for h in header])

        return replace(self, headers=[names(h) for h in self.headers])

    def places(self, resolve: Callable[[list[str]], Mapping[str, str | None]]) -> list[dict[str, int | None]]:
        """For each header variant, the cell of every field that ``resolve`` finds among its names."""
        return [{f: (names.index(h) if h is not None else None) for f, h in resolve(names).items()} for names in self.headers]

    def place_table(self, resolve: Callable[[list[str]], Mapping[str, str | None]]) -> DataFrame:
        """(variant, field, cell, header): which header fills which field; one row per variant and field."""
        rows = [(v, f, i, None if i is None else names[i])
                for v, (names, at) in enumerate(zip(self.headers, self.places(resolve))) for f, i in at.items()]
        return self.rows.sparkSession.createDataFrame(rows, "variant int, field string, cell int, header string")

    def by_field(self, resolve: Callable[[list[str]], Mapping[str, str | None]]) -> DataFrame:
        """The good rows with a column per field of ``resolve``, filled from each file's own header for it, and _has:
        a map from field to whether the row's file has such a column."""
        table = self.place_table(resolve)
        fields = list(self.places(resolve)[0])
        # one row per header variant, at most MAX_HEADERS
        at = table.groupBy(F.col("variant").alias("_v")).agg(F.map_from_entries(F.collect_list(F.struct("field", "cell"))).alias("_at"))
        rows = self.good().join(F.broadcast(at), F.col("_variant") == F.col("_v"))
        named = rows.select(*[F.get("_cells", F.col("_at")[f]).alias(f) for f in fields],
                            F.transform_values("_at", lambda f, i: i.isNotNull()).alias("_has"), "_seq")
        return null_tokens(named, self.na_tokens) if self.na_tokens else named


def _quoted(cell: Column) -> Column:
    return F.when(cell.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def _count_cells(raw: Column) -> Column:
    """Cells of a raw record: its commas outside quoted cells, and one."""
    bare = F.when(raw.contains('"'), F.regexp_replace(raw, r'(^|,)[ \t]*"(?:[^"]|"")*"', "$1")).otherwise(raw)
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def scan_csv(spark: SparkSession, paths: Sequence[str] | str, na_tokens: Sequence[str] | None = K.CSV_NA_TOKENS,
             multi_line: bool = True, detect_encoding: bool = True, short_rows: str = "keep") -> CsvScan:
    """The records of CSV files with headers, each with its file's header variant."""
    if short_rows not in ("keep", "reject"):
        raise ValueError("short_rows must be 'keep' or 'reject'")
    paths = [paths] if isinstance(paths, str) else list(paths)
    facts = file_facts(spark, paths)
    seen = facts.agg(F.max("commas").alias("commas"), F.bool_and("utf8").alias("utf8"), F.bool_or("utf8").alias("some")).first()
    if seen["commas"] is None:
        raise ValueError(f"no CSV input under {paths}")
    width = seen["commas"] + 1
    cells = [f"_cell{i}" for i in range(width)]

    def scan(encoding: str) -> DataFrame:
        df = (spark.read.schema(", ".join(f"{c} string" for c in [*cells, "_raw"])).option("header", False).option("multiLine", multi_line)
              .option("columnNameOfCorruptRecord", "_raw").option("escape", '"').option("encoding", encoding).csv(paths))
        raw = F.regexp_replace("_raw", r"[\r\n]+$", "")
        # the count names a cell, because the parser refuses to give the raw text alone
        return df.select(F.array(*cells).alias("_cells"), raw.alias("_raw"), F.coalesce(_count_cells(raw), F.greatest(F.lit(width), -F.length(cells[0]))).alias("_n"),
                         F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                  F.monotonically_increasing_id().alias("pos")).alias("_seq"))

    if not detect_encoding or seen["utf8"]:
        rows = scan("UTF-8")
    else:
        own = facts.select(F.col("file").alias("_f"), "utf8")
        parts = [scan(enc).join(own.filter(F.col("utf8") == flag), F.col("_seq.file") == F.col("_f")).select("_cells", "_raw", "_n", "_seq")
                 for enc, flag in (("UTF-8", True), ("ISO-8859-1", False)) if seen["some"] or not flag]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    file = F.col("_seq.file")
    head = F.slice("_cells", F.lit(1), F.least(F.col("_n"), F.lit(width)))
    heads = rows.groupBy(file.alias("_file")).agg(F.min("_seq").alias("_first"), F.min_by(head, "_seq").alias("_head"))
    variants = [list(r["_head"]) for r in heads.select("_head").distinct().limit(MAX_HEADERS + 1).collect()]
    if len(variants) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different header rows")
    variants.sort(key=lambda v: [h or "" for h in v])
    number = F.array_position(F.array(*[F.array(*[F.lit(h).cast("string") for h in v]) for v in variants]), F.col("_head")).cast("int") - 1
    body = (rows.join(heads.select("_file", "_first", number.alias("_variant")), file == F.col("_file"))
            .filter(F.col("_seq") != F.col("_first")).select("_cells", "_raw", "_n", "_variant", "_seq"))
    return CsvScan(body, [header_names(v) for v in variants], short_rows, na_tokens)


def read_csv(spark: SparkSession, paths: Sequence[str] | str, na_tokens: Sequence[str] | None = K.CSV_NA_TOKENS,
             multi_line: bool = True, detect_encoding: bool = True, unify: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Read header CSV files by name, as all-string columns with per-file encoding and ``_seq``.

    ``unify``: groups of aliases that are one column, whichever of them a file's header has.
    A row with surplus cells is an error when it is read; take ``scan_csv`` to set such rows aside.
    """
    scan = scan_csv(spark, paths, na_tokens, multi_line, detect_encoding).unified(unify)
    text = F.concat(F.lit("CSV row with more cells than its header names in "), F.col("_seq.file"), F.lit(": "), F.coalesce(F.col("_raw"), F.lit("")))
    fine = F.when(scan.problem().isNotNull(), F.raise_error(text).cast("boolean")).otherwise(F.lit(True))
    return scan.by_name(scan.rows.filter(fine))
