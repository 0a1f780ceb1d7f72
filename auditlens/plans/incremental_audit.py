"""Audit reports kept up to date batch by batch.

The label summaries add up, but the comparison takes the last row of a call: a later row has to take the earlier one's counts
back. A batch therefore touches only its own calls: their stored last rows give the old comparison, these and the batch the
new one, and the difference of the two counts goes onto the totals. Totals are 12 rows per report.

Every batch is a published version (``sources.sinks``) with its last row per call and side, laid out in buckets of the call id, and
the totals after it. A reader takes the totals of the latest published version; a batch that was killed left nothing. Of the stored
rows only the buckets that the batch's calls fall into are read; ``compact`` writes one version that stands for all
before it. One writer at a time: a batch that finds another one published since it began is refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.operators import compare as C
from auditlens.operators import summary as S
from auditlens.operators.hash_store import exists
from auditlens.plans import audit_job as AJ
from auditlens.sources import sinks

SIDES = ("manual", "ai")
_ROW = ["side", "call_id", "auditor", *K.FIELDS, "batch"]
_COUNTS = [short for short, _ in K.SUMMARY_LABEL_COLUMNS]


def _last(rows: DataFrame) -> DataFrame:
    others = [c for c in _ROW if c not in ("side", "call_id")]
    picked = rows.groupBy("side", "call_id").agg(F.max_by(F.struct(*others), "batch").alias("_r"))
    return picked.select("side", "call_id", *[F.col("_r")[c].alias(c) for c in others])


class IncrementalAudit:
    """The reports below ``path``, for one blank policy and label default."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, blank_policy: str = "match", unknown_label: str | None = K.CORRECT):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.blank_policy, self.unknown_label = blank_policy, unknown_label

    # --- reading ------------------------------------------------------------------
    def _folder(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def _paths(self, done: list[int]) -> list[str]:
        """The tables of all batches, from the latest compacted version on; each has one row per call and side."""
        full = max((v for v in done if exists(self.spark, f"{self._folder(v)}/compacted")), default=0)
        return [f"{self._folder(full)}/compacted"] * bool(full) + [f"{self._folder(v)}/rows" for v in done if v > full]

    def _stored(self, done: list[int]) -> DataFrame | None:
        """Last rows of all batches, from the latest compacted version on."""
        frames = [self.spark.read.parquet(p) for p in self._paths(done)]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def _totals(self, name: str) -> DataFrame | None:
        latest = sinks.latest_version(self.spark, self.path)
        return self.spark.read.parquet(f"{latest}/{name}") if latest else None

    def statistics(self) -> DataFrame:
        """``compare.summary_statistics`` over every row appended so far."""
        return C.with_rates(self._totals("statistics"))

    def summary(self, side: str) -> DataFrame:
        """``summary.field_summary`` of one side over every row appended so far."""
        return S.with_average(self._totals("summaries").filter(F.col("side") == side).drop("side"))

    # --- writing ------------------------------------------------------------------
    def _compared(self, rows: DataFrame | None) -> DataFrame | None:
        """The counts of ``rows``, one row per call and side."""
        if rows is None:
            return None
        manual, ai = (rows.filter(F.col("side") == s).withColumn("_seq", F.col("batch")).drop("side", "batch") for s in SIDES)
        return C.statistics_counts(C.compare_calls(manual, ai.drop("auditor"), self.blank_policy, self.unknown_label, single=True))

    def _add(self, before: DataFrame | None, parts: list[tuple[int, DataFrame | None]], keys: list[str]) -> DataFrame:
        """Sums of count tables with equal keys; a part with sign -1 is taken back."""
        frames = [before] * (before is not None)
        for sign, df in parts:
            if df is not None:
                frames.append(df.select(*keys, *[(F.col(c) * sign).alias(c) for c in df.columns if c not in keys]))
        out = reduce(DataFrame.unionByName, frames)
        return out.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in out.columns if c not in keys])

    def append(self, manual: DataFrame, ai: DataFrame) -> str:
        """Take in a batch of raw audit tables (as for ``AuditReport``; either may be empty); returns its version folder.
        Rows of a later batch are later than all before, whatever their ``_seq``."""
        done = sinks.versions(self.spark, self.path)
        inp = AJ.prepare(manual, ai)
        with sinks.new_version(self.spark, self.path) as out:
            number = int(out.rpartition("=")[2])
            sides = [C.latest_calls(C.audit_rows(df, m, "_seq", with_auditor=True)).withColumn("side", F.lit(side))
                     for side, df, m in (("manual", inp.manual, inp.manual_map), ("ai", inp.ai, inp.ai_map))]
            rows = sides[0].unionByName(sides[1]).withColumn("batch", F.lit(number).cast("long")).select(*_ROW)
            bucket = F.pmod(F.xxhash64("call_id"), F.lit(self.buckets)).cast("int").alias("bucket")
            (rows.select("*", bucket).repartition("bucket").sortWithinPartitions("bucket", "call_id")
             .write.partitionBy("bucket").parquet(f"{out}/rows"))
            fresh = self.spark.read.schema(f"{self._ddl(rows)}, bucket int").parquet(f"{out}/rows")
            stored, old = self._stored(done), None
            if stored is not None:
                touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
                ids = fresh.select("bucket", "call_id")
                old = stored.filter(F.col("bucket").isin(touched)).join(ids, ["bucket", "call_id"], "left_semi").select(*_ROW)
                old = _last(old) if len(self._paths(done)) > 1 else old
                old.write.parquet(f"{out}/_staged/old")
                old = self.spark.read.parquet(f"{out}/_staged/old")
            # rows of this batch are later than all before
            now = fresh.select(*_ROW)
            if old is not None:
                now = now.unionByName(old.join(fresh.select("side", "call_id"), ["side", "call_id"], "left_anti").select(*_ROW))
            change = [(1, self._compared(now)), (-1, self._compared(old))]
            self._add(self._totals("statistics"), change, ["field_pos", "field_name"]).coalesce(1).write.parquet(f"{out}/statistics")
            counted = [S.field_summary(df, m, self.unknown_label).select("field_pos", "field_name", *_COUNTS, "n_defaulted").withColumn("side", F.lit(side))
                       for side, df, m in (("manual", inp.manual, inp.manual_map), ("ai", inp.ai, inp.ai_map))]
            self._add(self._totals("summaries"), [(1, counted[0]), (1, counted[1])], ["side", "field_pos", "field_name"]).coalesce(1).write.parquet(f"{out}/summaries")
            if sinks.versions(self.spark, self.path) != done:
                raise RuntimeError(f"another batch was published below {self.path} while this one was worked; append it again")
        return out

    def compact(self) -> str:
        """A version whose rows stand for those of all before it; the totals stay."""
        done = sinks.versions(self.spark, self.path)
        with sinks.new_version(self.spark, self.path) as out:
            stored = self._stored(done)
            last = _last(stored).select(*_ROW, F.pmod(F.xxhash64("call_id"), F.lit(self.buckets)).cast("int").alias("bucket"))
            last.repartition("bucket").sortWithinPartitions("bucket", "call_id").write.partitionBy("bucket").parquet(f"{out}/compacted")
            for name in ("statistics", "summaries"):
                self._totals(name).coalesce(1).write.parquet(f"{out}/{name}")
            if sinks.versions(self.spark, self.path) != done:
                raise RuntimeError(f"another batch was published below {self.path} meanwhile; compact again")
        return out

    @staticmethod
    def _ddl(df: DataFrame) -> str:
        return ", ".join(f"{n} {t}" for n, t in df.dtypes)
