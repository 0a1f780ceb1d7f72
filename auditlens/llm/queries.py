"""Registered queries of the training-data operators and their DuckDB oracle SQL."""

from __future__ import annotations

from auditlens.llm import decontamination, importance, line_dedup, mixing, pii, preference, quality_rules
from auditlens.llm.ann_tree import op12_ann_search
from auditlens.llm.language_id import op1_language_id
from auditlens.llm.lm_scoring import op3_lm_scoring
from auditlens.llm.minhash_dedup import op2_minhash_dedup
from auditlens.llm.periodic_runs import op13_periodic_runs
from auditlens.llm.quality_classifier import op8_quality_classifier

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_chat_formatting": preference.op6_chat_formatting,
    "op7_pii": pii.op7_pii,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_ann_search": op12_ann_search,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": decontamination.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op6_chat_formatting": preference.ORACLE,
    "op11_importance_resampling": importance.ORACLE,
}
