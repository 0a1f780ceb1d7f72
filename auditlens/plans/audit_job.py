"""Audit comparison job: manual vs AI audit tables -> report tables.

Inputs are two audit tables with a ``_seq`` column giving input order: raw ones (one header each,
any spelling) or the rows of ``read_audits`` (files of several spellings). ``AuditReport`` builds each report DataFrame only when it
is asked for; nothing is collected. Six reports read the paired comparison, so
a job that writes several of them materialises it once and hands it back with
``use_comparison`` (``plans/jobs.run_audit`` does this).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.operators import compare as C
from auditlens.operators import summary as S
from auditlens.functions.text import call_id_before_dot
from auditlens.sources.columns import find_verdict_column, map_columns


@dataclass
class AuditInputs:
    manual: DataFrame
    ai: DataFrame
    manual_map: dict
    ai_map: dict
    manual_verdict: str | None
    ai_verdict: str | None


def prepare(manual: DataFrame, ai: DataFrame) -> AuditInputs:
    """Verdict filter, header mapping and NULL-id drop for both sides. A table of ``read_audits`` has its
    columns resolved file by file already."""
    mv, av = (find_verdict_column(t.columns) for t in (manual, ai))
    m_map, a_map = (_own_names() if S.HAS in t.columns else map_columns(t.columns) for t in (manual, ai))
    if not m_map["call_id"] or not a_map["call_id"]:
        raise ValueError("could not map the call id column in one or both audit tables")
    m = S.verdict_filter(manual, mv).filter(F.col(m_map["call_id"]).isNotNull())
    a = S.verdict_filter(ai, av).filter(F.col(a_map["call_id"]).isNotNull())
    return AuditInputs(m, a, m_map, a_map, mv, av)


def _own_names() -> dict[str, str]:
    return {name: name for name in ("call_id", "auditor", *K.FIELDS)}


def summaries(inp: AuditInputs, unknown_label=K.CORRECT) -> dict[str, DataFrame]:
    manual_ids = inp.manual.select(call_id_before_dot(F.col(inp.manual_map["call_id"])).alias("call_id"))
    ai_matched = C.matched_ids_semi(inp.ai, inp.ai_map["call_id"], manual_ids)
    return {
        "ai_summary": S.field_summary(inp.ai, inp.ai_map, unknown_label),
        "manual_summary": S.field_summary(inp.manual, inp.manual_map, unknown_label),
        "ai_matched_summary": S.field_summary(ai_matched, inp.ai_map, unknown_label),
    }


def comparison(inp: AuditInputs, blank_policy="match", unknown_label=K.CORRECT) -> DataFrame:
    m_rows = C.audit_rows(inp.manual, inp.manual_map, "_seq", with_auditor=True)
    a_rows = C.audit_rows(inp.ai, inp.ai_map, "_seq")
    return C.compare_calls(m_rows, a_rows, blank_policy, unknown_label)


def overview(inp: AuditInputs, cmp: DataFrame) -> DataFrame:
    """Verdict counts of both sides plus comparison totals, as (section, metric, value)."""
    def block(section, counts):
        return counts.select(F.inline(F.array(
            *[F.struct(F.lit(section).alias("section"), F.lit(m).alias("metric"),
                       F.col(m).cast("double").alias("value"))
              for m in ("total", "yes", "no", "yes_ratio")])))
    tot = C.comparison_totals(cmp)
    comp = tot.select(F.inline(F.array(
        *[F.struct(F.lit("comparison").alias("section"), F.lit(m).alias("metric"),
                   F.col(m).cast("double").alias("value"))
          for m in ("matched_calls", "total_fields", "matched_fields", "accuracy")])))
    return (block("ai", S.verdict_counts(inp.ai, inp.ai_verdict))
            .unionByName(block("manual", S.verdict_counts(inp.manual, inp.manual_verdict)))
            .unionByName(comp))


class AuditReport:
    """Report tables of one audit comparison, each built only when first asked for
    (building a DataFrame runs Catalyst analysis, which is not free for the
    wide 12-field comparison)."""

    def __init__(self, manual: DataFrame, ai: DataFrame, blank_policy="match", unknown_label=K.CORRECT):
        self.inp = prepare(manual, ai)
        self.blank_policy, self.unknown_label = blank_policy, unknown_label
        self._cache: dict[str, DataFrame] = {}

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    def summary(self, side: str) -> DataFrame:
        inp, u = self.inp, self.unknown_label
        if side == "ai":
            return self._get(side, lambda: S.field_summary(inp.ai, inp.ai_map, u))
        if side == "manual":
            return self._get(side, lambda: S.field_summary(inp.manual, inp.manual_map, u))
        manual_ids = inp.manual.select(call_id_before_dot(F.col(inp.manual_map["call_id"])).alias("call_id"))
        return self._get(side, lambda: S.field_summary(
            C.matched_ids_semi(inp.ai, inp.ai_map["call_id"], manual_ids), inp.ai_map, u))

    def use_rows(self, stage) -> None:
        """Give every comparison and the matched summary rows that ``stage(df, side)`` has written in buckets of the
        call id: they then need no exchange, for either blank policy."""
        inp = self.inp
        rows = {"manual": C.audit_rows(inp.manual, inp.manual_map, "_seq", with_auditor=True),
                "ai": C.audit_rows(inp.ai, inp.ai_map, "_seq")}
        self._cache["rows"] = {side: stage(df, side) for side, df in rows.items()}
        self._cache.pop("comparison", None)

    def compared(self, blank_policy: str, unknown_label: str | None) -> DataFrame:
        """The comparison under another policy than the report's own, over the same rows."""
        rows = self._cache.get("rows")
        if rows is None:
            return comparison(self.inp, blank_policy, unknown_label)
        return C.compare_calls(rows["manual"], rows["ai"], blank_policy, unknown_label)

    def use_comparison(self, staged: DataFrame) -> None:
        """Derive every comparison-based table from an already materialised comparison
        (e.g. written once to the job's folder) instead of recomputing it per table."""
        self._cache["comparison"] = staged
        self._cache.pop("stats", None)

    @property
    def comparison(self) -> DataFrame:
        return self._get("comparison", lambda: self.compared(self.blank_policy, self.unknown_label))

    @property
    def statistics(self) -> DataFrame:
        return self._get("stats", lambda: C.summary_statistics(self.comparison))

    def table(self, name: str) -> DataFrame:
        sides = {"ai_summary": "ai", "manual_summary": "manual", "ai_matched_summary": "ai_matched"}
        if name in sides:
            return self.summary(sides[name])
        if name == "overall":
            parts = [S.with_overall_line(S.overall_accuracy(self.summary(s))).withColumn("side", F.lit(s))
                     for s in ("ai", "manual", "ai_matched")]
            return parts[0].unionByName(parts[1]).unionByName(parts[2])
        if name == "overview":
            return overview(self.inp, self.comparison)
        if name == "fieldwise":
            return S.fieldwise_comparison(self.summary("ai"), self.summary("manual"))
        if name == "binary_comparison":
            return C.binary_comparison(self.comparison)
        if name == "value_comparison":
            return C.value_comparison(self.comparison)
        if name == "summary_statistics":
            return self.statistics
        if name == "macro_accuracy":
            return C.macro_accuracy(self.statistics)
        if name == "comparison":
            return self.comparison
        raise KeyError(name)


REPORT_TABLES = ["ai_summary", "manual_summary", "ai_matched_summary", "overall", "overview", "fieldwise",
                 "binary_comparison", "value_comparison", "summary_statistics", "macro_accuracy", "comparison"]


def audit_report(manual: DataFrame, ai: DataFrame, blank_policy="match",
                 unknown_label=K.CORRECT) -> dict[str, DataFrame]:
    """All report tables (builds every plan; prefer ``AuditReport`` for a subset)."""
    rep = AuditReport(manual, ai, blank_policy, unknown_label)
    return {name: rep.table(name) for name in REPORT_TABLES}
