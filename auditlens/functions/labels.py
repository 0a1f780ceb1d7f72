"""Verdict-label normalisation and matching as Spark column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.text import _c, blank_to_null, py_strip, rlike_any


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_badge(u: str) -> str | None:
    """The badge rules in plain Python, for the known spellings below."""
    return next((label for label, tokens in K.BADGE_RULES if any(t in u for t in tokens)), None)


#: Canonical spellings (upper-cased) and the badge the rules give them: equality is tested before any rule runs.
KNOWN_SPELLINGS = {u: _rule_badge(u) for u in sorted({label.upper() for label, _ in K.BADGE_RULES} | {K.NOT_DISCUSSED.upper()})}


def badge_sql(u_sql: str, method: str = "regex") -> str:
    """SQL text of the badge rules over an (upper-cased, stripped) SQL expression."""
    whens = [f"WHEN {u_sql} = {_sql_str(u)} THEN {_sql_str(label)}" for u, label in KNOWN_SPELLINGS.items() if label]
    for label, tokens in K.BADGE_RULES:
        if method == "regex":
            cond = f"{u_sql} RLIKE {_sql_str('|'.join(re.escape(t) for t in tokens))}"
        else:
            cond = " OR ".join(f"contains({u_sql}, {_sql_str(t)})" for t in tokens)
        whens.append(f"WHEN {cond} THEN {_sql_str(label)}")
    return "CASE " + " ".join(whens) + " ELSE CAST(NULL AS STRING) END"


def badge_from_upper(u, method: str = "regex") -> Column:
    """Badge of text that is already stripped and upper-cased.

    ``method='regex'``: one alternation per rule (6 expressions; compact plans
    for wide tables of short labels). ``method='contains'``: literal byte
    search per token (faster on long free text, larger plans). Given a column
    NAME, the rules are sent to the JVM as one SQL expression (one call instead
    of dozens of expression-builder round trips).
    """
    if isinstance(u, str):
        return F.expr(badge_sql(f"`{u}`", method))
    out = None
    for label, tokens in K.BADGE_RULES:
        if method == "regex":
            hit = u.rlike("|".join(re.escape(t) for t in tokens))
        else:
            hit = rlike_any(u, tokens)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(None).cast("string"))


def badge(c, method: str = "regex") -> Column:
    """Classify free text into a canonical label by ordered substring rules; NULL if none."""
    return badge_from_upper(F.upper(py_strip(c)), method)


def upper_stripped(c) -> Column:
    """The text the badge rules look at; project it once, then use ``badge_from_upper``."""
    return F.upper(py_strip(c))


def normalise_label(c, unknown_label: str | None = K.CORRECT,
                    blank_tokens=K.NULLS_AUDIT) -> Column:
    """Blank -> 'Correct (Not Discussed)'; else the badge; else ``unknown_label``."""
    return (F.when(blank_to_null(c, blank_tokens).isNull(), F.lit(K.NOT_DISCUSSED))
            .otherwise(F.coalesce(badge(c), F.lit(unknown_label).cast("string"))))


def label_from_badge(blank, badge_col, unknown_label: str | None = K.CORRECT) -> Column:
    """Canonical label from a precomputed blank flag and badge (keeps each regex evaluated once)."""
    return (F.when(blank, F.lit(K.NOT_DISCUSSED))
            .otherwise(F.coalesce(badge_col, F.lit(unknown_label).cast("string"))))


def match_class(label, canonical: bool = False) -> Column:
    """Equivalence class for matching: the correct family collapses to one class.

    ``canonical=True`` skips the strip for labels produced by the normaliser.
    """
    low = F.lower(_c(label) if canonical else py_strip(label))
    return F.when(low.isin([x.lower() for x in K.CORRECT_FAMILY]), F.lit("ok")).otherwise(low)


def label_match(manual_label, ai_label, canonical: bool = False) -> Column:
    """1 when the two normalised labels agree (case/space-insensitive, correct family equal)."""
    return F.when(_c(manual_label).isNull(), F.lit(1)).otherwise(
        match_class(manual_label, canonical).eqNullSafe(match_class(ai_label, canonical)).cast("int"))
