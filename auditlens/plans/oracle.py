"""DuckDB SQL for the correctness gate: the same derivations and semantics as
the Spark plans, written independently as plain SQL over the driver views.

The Spark side strips with a Unicode-aware pattern; the derived inputs only
carry ASCII spaces, so SQL ``trim`` is equivalent on them.
"""

from __future__ import annotations

from auditlens import constants as K
from auditlens.plans import driver_tables as D


def q(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, expr: str) -> str:
    return f"({sql_list(values)})[(({expr}) % {len(values)}) + 1]"


def blank(x: str, tokens=K.NULLS_AUDIT) -> str:
    toks = ", ".join(q(t.lower()) for t in sorted(set(tokens)))
    return f"({x} IS NULL OR lower(trim({x})) IN ({toks}))"


def badge(x: str) -> str:
    parts = [f"WHEN regexp_matches(upper(trim({x})), {q('|'.join(tokens))}) THEN {q(label)}"
             for label, tokens in K.BADGE_RULES]
    return "CASE " + " ".join(parts) + " ELSE NULL END"


def norm(x: str) -> str:
    parts = [f"WHEN regexp_matches(upper(trim({x})), {q('|'.join(tokens))}) THEN {q(label)}"
             for label, tokens in K.BADGE_RULES]
    return (f"CASE WHEN {blank(x)} THEN {q(K.NOT_DISCUSSED)} " + " ".join(parts)
            + f" ELSE {q(K.CORRECT)} END")


def mclass(x: str) -> str:
    fam = ", ".join(q(v.lower()) for v in K.CORRECT_FAMILY)
    return f"(CASE WHEN lower({x}) IN ({fam}) THEN 'ok' ELSE lower({x}) END)"


def cid(x: str) -> str:
    return f"trim(split_part({x}, '.', 1))"


# --- derived audit pair --------------------------------------------------------
def manual_src() -> str:
    cols = [
        "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 2 THEN CAST(l_orderkey AS VARCHAR) || '.0' "
        "ELSE CAST(l_orderkey AS VARCHAR) END AS call_id_raw",
        "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'Auditor ' || CAST(l_suppkey % 4 AS VARCHAR) END AS auditor",
        f"{pick(D.VERDICT_CASES, 'l_partkey + l_suppkey + l_linenumber')} AS verdict",
    ]
    for i in range(12):
        cols.append(f"{pick(D.LABEL_CASES, f'l_partkey * {2 * i + 1} + l_suppkey * {i + 1} + l_linenumber')} AS f{i}")
    cols += ["l_linenumber AS s1", "l_partkey AS s2", "l_suppkey AS s3"]
    return "SELECT " + ", ".join(cols) + " FROM lineitem"


def ai_src() -> str:
    cols = ["CAST(o_orderkey AS VARCHAR) AS call_id_raw",
            f"{pick(D.VERDICT_CASES, 'o_orderkey + o_custkey')} AS verdict"]
    for i in range(12):
        cols.append(f"{pick(D.LABEL_CASES, f'o_orderkey * {i + 3} + o_custkey + {i}')} AS f{i}")
    cols += ["o_orderkey AS s1", "0 AS s2", "0 AS s3"]
    return "SELECT " + ", ".join(cols) + " FROM orders"


def _filtered(src: str) -> str:
    return (f"SELECT * FROM ({src}) WHERE lower(trim(verdict)) IN ('yes', 'no') "
            f"AND call_id_raw IS NOT NULL")


def summary_sql(side: str) -> str:
    """Per-field label summary of one side: 'ai', 'manual' or 'ai_matched'."""
    if side == "manual":
        base = _filtered(manual_src())
    elif side == "ai":
        base = _filtered(ai_src())
    else:
        base = (f"SELECT * FROM ({_filtered(ai_src())}) a WHERE {cid('a.call_id_raw')} IN "
                f"(SELECT {cid('call_id_raw')} FROM ({_filtered(manual_src())}))")
    return summary_of(base)


def summary_of(base: str, only: dict[int, str] | None = None) -> str:
    """The label summary of the rows of ``base``; ``only[i]``: which rows count for field i."""
    only = only or {}
    norm_cols = ", ".join(f"{norm(f'f{i}')} AS v{i}, ({'NOT ' + blank(f'f{i}')} AND ({badge(f'f{i}')}) IS NULL) AS d{i}"
                          for i in range(12))
    parts = []
    for i, f in enumerate(K.FIELDS):
        here = only.get(i, "true")
        counts = ", ".join(f"count(*) FILTER (WHERE v{i} = {q(label)} AND {here}) AS {short}"
                           for short, label in K.SUMMARY_LABEL_COLUMNS)
        parts.append(f"SELECT {i + 1} AS field_pos, {q(K.FIELD_DISPLAY[f])} AS field_name, {counts}, "
                     f"count(*) FILTER (WHERE d{i} AND {here}) AS n_defaulted FROM n")
    body = " UNION ALL ".join(parts)
    return (f"WITH n AS (SELECT *, {norm_cols} FROM ({base})), s AS ({body}) "
            "SELECT field_pos, field_name, correct + correct_nd + inferred AS cumulative_correct, correct, "
            "correct_nd, inferred, missing, incorrect, hallucination, "
            "correct + correct_nd + inferred + missing + incorrect + hallucination AS total_calls, n_defaulted, "
            "CASE WHEN correct + correct_nd + inferred + missing + incorrect + hallucination > 0 THEN "
            "(correct + correct_nd + inferred) / (correct + correct_nd + inferred + missing + incorrect + hallucination) "
            "ELSE 0.0 END AS average FROM s")


def overall_sql() -> str:
    parts = []
    for side in ("ai", "manual", "ai_matched"):
        parts.append(
            f"SELECT CAST(sum(cumulative_correct) AS BIGINT) AS total_correct, "
            f"CAST(sum(total_calls) AS BIGINT) AS total_calls_fields, "
            f"CASE WHEN sum(total_calls) > 0 THEN CAST(sum(cumulative_correct) AS DOUBLE) / CAST(sum(total_calls) AS DOUBLE) "
            f"ELSE 0.0 END AS overall_accuracy, {q(side)} AS side, "
            "format('Total correct = {} Total calls fields = {} , overall accuracy = {}/{}', CAST(sum(cumulative_correct) AS BIGINT), "
            "CAST(sum(total_calls) AS BIGINT), CAST(sum(cumulative_correct) AS BIGINT), CAST(sum(total_calls) AS BIGINT)) AS overall_line "
            f"FROM ({summary_sql(side)})")
    return " UNION ALL ".join(parts)


def _latest(src: str, with_auditor: bool) -> str:
    aud = ", coalesce(trim(auditor), 'Manual Auditor') AS auditor" if with_auditor else ""
    fields = ", ".join(f"CASE WHEN {blank(f'f{i}')} THEN NULL ELSE trim(f{i}) END AS f{i}" for i in range(12))
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT {cid('call_id_raw')} AS call_id{aud}, {fields}, "
            f"row_number() OVER (PARTITION BY {cid('call_id_raw')} ORDER BY s1 DESC, s2 DESC, s3 DESC) AS rn "
            f"FROM ({_filtered(src)})) WHERE rn = 1")


def comparison_sql() -> str:
    cols = ["call_id", "m.auditor AS manual_auditor"]
    for i, f in enumerate(K.FIELDS):
        mn, an = norm(f"m.f{i}"), norm(f"a.f{i}")
        cols += [f"CASE WHEN m.f{i} IS NULL THEN {an} ELSE {mn} END AS {f}_manual",
                 f"{an} AS {f}_ai",
                 f"CASE WHEN m.f{i} IS NULL THEN 1 ELSE CAST({mclass(mn)} = {mclass(an)} AS INTEGER) END AS {f}_match",
                 f"CAST(m.f{i} IS NULL AS INTEGER) AS {f}_imputed"]
    matches = " + ".join(f"{f}_match" for f in K.FIELDS)
    return (f"WITH m AS ({_latest(manual_src(), True)}), a AS ({_latest(ai_src(), False)}), "
            f"c AS (SELECT {', '.join(cols)} FROM m JOIN a USING (call_id)) "
            f"SELECT *, {matches} AS matches, 12 AS total_fields, ({matches}) / 12 * 100.0 AS accuracy FROM c")


def binary_comparison_sql() -> str:
    fields = ", ".join(f"{f}_match AS {f}" for f in K.FIELDS)
    return (f"SELECT call_id, manual_auditor, {fields}, matches, total_fields, round(accuracy, 2) AS accuracy "
            f"FROM ({comparison_sql()})")


def value_comparison_sql() -> str:
    fields = ", ".join(f"{f}_manual, {f}_ai" for f in K.FIELDS)
    return f"SELECT call_id, {fields} FROM ({comparison_sql()})"


def summary_statistics_sql() -> str:
    parts = []
    for i, f in enumerate(K.FIELDS):
        counts = ", ".join(f"count(*) FILTER (WHERE {f}_manual = {q(label)}) AS {short}"
                           for short, label in K.SUMMARY_LABEL_COLUMNS)
        parts.append(
            f"SELECT {i + 1} AS field_pos, {q(K.FIELD_DISPLAY[f])} AS field_name, {counts}, "
            f"CAST(coalesce(sum({f}_match), 0) AS BIGINT) AS matched_calls, count({f}_match) AS compared_calls, "
            f"CAST(coalesce(sum({f}_imputed), 0) AS BIGINT) AS n_imputed, count(*) AS total_calls FROM c")
    acc = "CASE WHEN total_calls > 0 THEN matched_calls / total_calls * 100.0 ELSE 0.0 END"
    return (f"WITH c AS ({comparison_sql()}), s AS ({' UNION ALL '.join(parts)}) "
            f"SELECT *, correct + correct_nd + inferred AS cumulative_correct, {acc} AS accuracy, "
            f"CASE WHEN {acc} >= 90.0 THEN 'green' WHEN {acc} >= 75.0 AND {acc} <= 89.9 THEN 'yellow' "
            f"WHEN {acc} < 75.0 THEN 'red' END AS band FROM s")


def overview_sql() -> str:
    def block(section, src):
        f = _filtered(src)
        return (f"SELECT {q(section)} AS section, metric, value FROM (SELECT "
                f"CAST(count(*) AS DOUBLE) AS total, "
                f"CAST(count(*) FILTER (WHERE lower(trim(verdict)) = 'yes') AS DOUBLE) AS yes, "
                f"CAST(count(*) FILTER (WHERE lower(trim(verdict)) = 'no') AS DOUBLE) AS no, "
                f"CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE lower(trim(verdict)) = 'yes') / count(*) "
                f"ELSE 0.0 END AS yes_ratio FROM ({f})) "
                f"UNPIVOT (value FOR metric IN (total, yes, no, yes_ratio))")
    comp = (f"SELECT 'comparison' AS section, metric, value FROM (SELECT CAST(count(*) AS DOUBLE) AS matched_calls, "
            f"CAST(coalesce(sum(total_fields), 0) AS DOUBLE) AS total_fields, "
            f"CAST(coalesce(sum(matches), 0) AS DOUBLE) AS matched_fields, "
            f"CASE WHEN sum(total_fields) > 0 THEN sum(matches) / sum(total_fields) * 100.0 ELSE 0.0 END AS accuracy "
            f"FROM ({comparison_sql()})) UNPIVOT (value FOR metric IN (matched_calls, total_fields, matched_fields, accuracy))")
    return f"{block('ai', ai_src())} UNION ALL {block('manual', manual_src())} UNION ALL {comp}"


def fieldwise_sql() -> str:
    return (f"SELECT a.field_pos, a.field_name, "
            f"CAST(a.cumulative_correct AS VARCHAR) || '/' || CAST(a.total_calls AS VARCHAR) AS ai_fraction, "
            f"CASE WHEN a.total_calls > 0 THEN a.cumulative_correct / a.total_calls ELSE 0.0 END AS ai_ratio, "
            f"CAST(m.cumulative_correct AS VARCHAR) || '/' || CAST(m.total_calls AS VARCHAR) AS manual_fraction, "
            f"CASE WHEN m.total_calls > 0 THEN m.cumulative_correct / m.total_calls ELSE 0.0 END AS manual_ratio "
            f"FROM ({summary_sql('ai')}) a JOIN ({summary_sql('manual')}) m USING (field_pos)")


def macro_accuracy_sql() -> str:
    return f"SELECT round(coalesce(avg(accuracy), 0.0), 6) AS macro_accuracy FROM ({summary_statistics_sql()})"


# --- id restoration ----------------------------------------------------------------
def _restore_ctes() -> str:
    toks = ", ".join(q(t) for t in K.NULLS_RESTORE)
    return (
        "calls AS (SELECT CAST(l_orderkey AS VARCHAR) AS call_id, CAST(l_partkey AS VARCHAR) AS seller, "
        "CAST(l_suppkey AS VARCHAR) AS caller FROM lineitem), "
        "valid AS (SELECT trim(coalesce(seller, '')) AS s, trim(coalesce(caller, '')) AS c, "
        "trim(coalesce(call_id, '')) AS id FROM calls), "
        "lookup AS (SELECT s AS seller, c AS caller, min(id) AS call_id FROM valid "
        "WHERE s <> '' AND c <> '' AND id <> '' GROUP BY s, c HAVING count(*) = 1), "
        f"audit AS (SELECT CASE WHEN l_returnflag = 'R' THEN {pick(D.MISSING_ID_FORMS, 'l_linenumber + l_suppkey')} "
        "ELSE CAST(l_orderkey AS VARCHAR) END AS call_id, ' ' || CAST(l_partkey AS VARCHAR) AS seller, "
        "CAST(l_suppkey AS VARCHAR) AS caller, l_linenumber AS line, l_partkey AS part FROM lineitem), "
        f"flag AS (SELECT *, (call_id IS NULL OR trim(call_id) IN ({toks})) AS id_missing FROM audit), "
        "restored AS (SELECT CASE WHEN f.id_missing AND l.call_id IS NOT NULL THEN l.call_id ELSE f.call_id END "
        "AS call_id, f.seller AS seller_glid, f.caller AS caller_glid, f.line, f.part, f.id_missing, "
        "(f.id_missing AND l.call_id IS NOT NULL) AS id_restored FROM flag f LEFT JOIN lookup l "
        "ON f.id_missing AND trim(f.seller) = l.seller AND trim(f.caller) = l.caller)")


def restore_pair_counts_sql() -> str:
    return (f"WITH {_restore_ctes()} SELECT s AS seller, c AS caller, count(*) AS n FROM valid "
            "WHERE s <> '' AND c <> '' AND id <> '' GROUP BY s, c")


def json_path_extract_sql() -> str:
    return ("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, "
            "CAST(json_extract_string(props, '$.missing') AS VARCHAR) AS missing FROM events")


def restore_lookup_sql() -> str:
    return f"WITH {_restore_ctes()} SELECT seller, caller, call_id FROM lookup"


def restore_ids_sql() -> str:
    return f"WITH {_restore_ctes()} SELECT * FROM restored"


def restore_counters_sql() -> str:
    return (f"WITH {_restore_ctes()}, agg AS (SELECT count(*) AS total_rows, "
            "count(*) FILTER (WHERE id_missing) AS missing_before, "
            "count(*) FILTER (WHERE id_restored) AS restored FROM restored) "
            "SELECT metric, value FROM (SELECT total_rows, missing_before, restored, "
            "missing_before - restored AS still_missing FROM agg) "
            "UNPIVOT (value FOR metric IN (total_rows, missing_before, restored, still_missing))")


# --- first / last row per key ------------------------------------------------------
DEDUPE_COLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag"


def row_per_key_sql(last: bool) -> str:
    d = "DESC" if last else "ASC"
    return (f"SELECT {DEDUPE_COLS} FROM (SELECT {DEDUPE_COLS}, row_number() OVER (PARTITION BY l_orderkey "
            f"ORDER BY l_linenumber {d}, l_partkey {d}, l_suppkey {d}) AS rn FROM lineitem) WHERE rn = 1")


def dup_counts_sql() -> str:
    return ("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_keys, "
            "count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem")


# --- model health ------------------------------------------------------------------
def _probe_ctes() -> str:
    status = (f"CASE WHEN event_type = 'error' THEN ({'[' + ', '.join(str(s) for s in D.PROBE_ERROR_STATUS) + ']'})"
              f"[(event_id % {len(D.PROBE_ERROR_STATUS)}) + 1] "
              "WHEN event_type = 'signup' AND value < 25 THEN NULL ELSE 200 END")
    skip = "|".join(K.SKIP_MODEL_KEYWORDS)
    rules = " ".join(f"WHEN {' OR '.join(f'contains(lower(err), {q(t)})' for t in toks)} THEN {q(label)}"
                     for label, toks in K.ERROR_CLASS_RULES)
    return (
        f"p0 AS (SELECT {pick(D.MODEL_FAMILIES, 'user_id')} || '-' || CAST(user_id AS VARCHAR) AS model, "
        f"{status} AS http_status, event_id, user_id, ts FROM events), "
        "p AS (SELECT model, http_status, CASE WHEN http_status = 200 THEN '{\"choices\": []}' "
        "WHEN http_status = 502 THEN 'Bad gateway <html>' WHEN http_status IS NOT NULL THEN "
        f"'{{\"error\": {{\"message\": \"' || {pick(D.PROBE_MESSAGES, 'event_id + user_id')} || '\"}}}}' END AS body, "
        f"CASE WHEN http_status IS NULL THEN {q(D.PROBE_EXCEPTION)} END AS exception, ts, event_id FROM p0), "
        "latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model "
        "ORDER BY ts DESC, event_id DESC) AS rn FROM p) WHERE rn = 1), "
        "e AS (SELECT model, http_status, CASE WHEN http_status IS NULL THEN exception ELSE coalesce("
        "CASE WHEN json_valid(body) THEN json_extract_string(body, '$.error.message') END, body) END AS err "
        f"FROM latest WHERE NOT regexp_matches(lower(model), {q(skip)})), "
        "o AS (SELECT model, CASE WHEN http_status = 200 THEN 'Healthy' ELSE 'Broken' END AS status, "
        f"CASE WHEN http_status = 200 THEN '' ELSE CASE {rules} ELSE {q(K.ERROR_CLASS_DEFAULT)} END END AS error_type, "
        f"CASE WHEN http_status = 200 THEN '' ELSE err END AS error, "
        f"CASE WHEN http_status = 200 THEN '' ELSE substr(err, 1, {K.ERROR_TEXT_LIMIT}) END AS error_short FROM e)")


def model_candidates_sql() -> str:
    skip = "|".join(K.SKIP_MODEL_KEYWORDS)
    return (f"WITH {_probe_ctes()} SELECT DISTINCT model FROM p "
            f"WHERE NOT regexp_matches(lower(model), {q(skip)})")


def healthy_models_sql() -> str:
    return f"WITH {_probe_ctes()} SELECT model FROM o WHERE status = 'Healthy'"


def broken_models_sql() -> str:
    return f"WITH {_probe_ctes()} SELECT model, error_type, error, error_short FROM o WHERE status = 'Broken'"


def health_summary_sql() -> str:
    return (f"WITH {_probe_ctes()} SELECT 'healthy' AS metric, count(*) FILTER (WHERE status = 'Healthy') AS value "
            "FROM o UNION ALL SELECT 'broken', count(*) FILTER (WHERE status = 'Broken') FROM o "
            "UNION ALL SELECT 'error:' || error_type, count(*) FROM o WHERE status = 'Broken' GROUP BY error_type")


# --- document badges, content hashes, percent text ---------------------------------
def badge_documents_sql() -> str:
    return f"SELECT doc_id, {badge('text')} AS badge FROM documents"


def hash_new_only_sql() -> str:
    return ("WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents), "
            "known AS (SELECT h.content_hash FROM h JOIN labels l USING (doc_id)) "
            "SELECT doc_id, content_hash FROM h WHERE content_hash NOT IN (SELECT content_hash FROM known)")


def percent_text_sql() -> str:
    return ("WITH k AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), "
            "c AS (SELECT 'type ' || event_type AS item, n, (SELECT CAST(sum(n) AS BIGINT) FROM k) AS total FROM k UNION ALL "
            "SELECT 'event ' || CAST(event_id AS VARCHAR), event_id % 16000, 16000 FROM events) "
            "SELECT item, n, CAST(total AS BIGINT) AS total, "
            "CAST(n AS VARCHAR) || '/' || CAST(CAST(total AS BIGINT) AS VARCHAR) || ' | ' || "
            "printf('%.2f', CASE WHEN total > 0 THEN n / total * 100.0 ELSE 0.0 END) || '%' AS share_text FROM c")


# --- prompt benchmark statistics ------------------------------------------------------
def responses() -> str:
    return (
        "r0 AS (SELECT event_id // 5 AS row_id, "
        f"{pick(D.MODEL_IDS, 'event_id')} AS model, event_type <> 'error' AS ok, "
        "event_type <> 'error' AND event_type <> 'view' AS usage, "
        "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value / 100.0 AS latency, event_type FROM events), "
        "r AS (SELECT row_id, model, CASE WHEN ok THEN 'Response: ' || event_type || ' ' || CAST(k AS VARCHAR) "
        "ELSE 'ERROR' END AS response, latency, CASE WHEN usage THEN k * 10 + 50 END AS prompt_tokens, "
        "CASE WHEN usage THEN k + 5 END AS completion_tokens, "
        "CASE WHEN usage THEN k * 10 + 50 + k + 5 END AS total_tokens, "
        "CASE WHEN ok THEN 'Success' ELSE 'Failed' END AS status FROM r0), "
        "prices AS (SELECT * FROM (VALUES "
        + ", ".join(f"({q(m[0])}, {m[2]}::DOUBLE, {m[3]}::DOUBLE)" for m in D.DEFAULT_MODELS)
        + ") t(model, pin, pout)), "
        "rc AS (SELECT r.*, CASE WHEN prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL THEN "
        "prompt_tokens / 1e6 * coalesce(pin, 0.0) + completion_tokens / 1e6 * coalesce(pout, 0.0) END AS cost "
        "FROM r LEFT JOIN prices USING (model))")


def response_cost_sql() -> str:
    return f"WITH {responses()} SELECT row_id, model, prompt_tokens, completion_tokens, round(cost, 12) AS cost FROM rc"


def model_stats_sql() -> str:
    def mean_ok(c):
        return f"round(coalesce(avg({c}) FILTER (WHERE status = 'Success'), 0.0), 6)"
    return (f"WITH {responses()} SELECT model, count(*) AS requests, "
            "count(*) FILTER (WHERE status = 'Success') AS success, count(*) FILTER (WHERE status <> 'Success') AS failed, "
            "round(coalesce(avg(latency), 0.0), 6) AS avg_latency, round(coalesce(min(latency), 0.0), 6) AS min_latency, "
            "round(coalesce(max(latency), 0.0), 6) AS max_latency, "
            "round(coalesce(stddev_samp(latency), 0.0), 6) AS stddev_latency, "
            f"{mean_ok('prompt_tokens')} AS avg_prompt_tokens, {mean_ok('completion_tokens')} AS avg_completion_tokens, "
            f"{mean_ok('total_tokens')} AS avg_total_tokens, {mean_ok('cost')} AS avg_cost, "
            "round(coalesce(quantile_cont(latency, 0.95), 0.0), 6) AS p95_latency FROM rc GROUP BY model")


def run_totals_sql() -> str:
    return (f"WITH {responses()} SELECT count(*) FILTER (WHERE status = 'Success') AS successful_requests, "
            "count(*) FILTER (WHERE status <> 'Success') AS failed_requests FROM rc")


def response_pivot_sql() -> str:
    cols = ", ".join(f"coalesce(max(response) FILTER (WHERE model = {q(m)}), 'ERROR') AS \"{m}\"" for m in D.MODEL_IDS)
    return f"WITH {responses()} SELECT row_id, {cols} FROM rc GROUP BY row_id"


# --- dataset build ------------------------------------------------------------------
def _dnorm(x: str) -> str:
    toks = ", ".join(q(t) for t in sorted(set(K.NULLS_DATASET)))
    return f"(CASE WHEN {x} IS NULL OR lower(trim({x})) IN ({toks}) THEN NULL ELSE trim({x}) END)"


def _clean_id(x: str) -> str:
    return f"(CASE WHEN lower(trim(coalesce({x}, ''))) IN ('', 'nan') THEN NULL ELSE trim({x}) END)"


def _dataset_ctes() -> str:
    w1 = "regexp_extract(text, '^([A-Za-z]+)', 1)"
    did = "CAST(doc_id AS VARCHAR)"
    call_json = (
        f"CASE WHEN lang = 'en' THEN '{{\"buyer_details\": {{\"buyer_name\": \"' || {w1} || "
        "'\", \"buyer_location\": {\"buyer_city\": \"' || source || '\"}, \"buyer_number\": ' || "
        f"CAST(n_chars AS VARCHAR) || '}}, \"seller_details\": {{\"name\": \"S' || {did} || "
        "'\", \"seller_location\": \"' || lang || '\"}}' "
        f"WHEN lang = 'fr' THEN '{{''buyer_details'': {{''name'': ''' || {w1} || ''', ''buyer_location'': ''' "
        f"|| source || '''}}, ''buyer_Number'': ''' || {did} || '''}}' "
        f"WHEN lang = 'de' THEN '{{\"k\": ' || {did} || '}}' ELSE '' END")
    expected = []
    for key, aliases in K.EXPECTED_OUTPUT_FIELDS.items():
        col = {"buyer_name": "x_buyer_name", "verdict": "x_verdict", "accuracy_score": "x_acc",
               "completeness_score": "x_comp", "reasoning": "x_reason"}.get(key)
        if col is None:
            continue
        v = _dnorm(col)
        if "score" in key:
            d = f"TRY_CAST({v} AS DOUBLE)"
            val = (f"CASE WHEN regexp_matches({v}, {q(K.NUMBER_PATTERN)}) AND {d} = floor({d}) THEN "
                   f"CAST(CAST({d} AS BIGINT) AS VARCHAR) WHEN regexp_matches({v}, {q(K.NUMBER_PATTERN)}) THEN "
                   f"CAST({d} AS VARCHAR) ELSE CAST(to_json({v}) AS VARCHAR) END")
        else:
            val = f"CAST(to_json({v}) AS VARCHAR)"
        expected.append(f"CASE WHEN {v} IS NOT NULL THEN '  \"{key}\": ' || {val} END")
    body = "concat_ws(',\n', " + ", ".join(expected) + ")"
    exp = f"CASE WHEN {body} = '' THEN '{{}}' ELSE '{{\n' || {body} || '\n}}' END"

    def ext(path):
        return f"nullif(json_extract_string(pj, '{path}'), '')"

    def loc(base, key, city):
        p = f"{base}.{key}"
        return (f"CASE WHEN json_type(pj, '{p}') = 'OBJECT' THEN coalesce({ext(p + '.' + city)}, {ext(p + '.city')}) "
                f"WHEN json_type(pj, '{p}') = 'VARCHAR' THEN {ext(p)} END")
    derived_any = " OR ".join(f"({e}) IS NOT NULL" for e in [
        loc("$.buyer_details", "buyer_location", "buyer_city"),
        f"coalesce({ext('$.buyer_details.buyer_name')}, {ext('$.buyer_details.name')})",
        f"coalesce({ext('$.buyer_details.buyer_number')}, {ext('$.buyer_details.buyer_phone')}, {ext('$.buyer_Number')})",
        loc("$.seller_details", "seller_location", "seller_city"),
        f"coalesce({ext('$.seller_details.seller_name')}, {ext('$.seller_details.name')})"])
    return (
        f"calls AS (SELECT CASE WHEN doc_id % 10 = 3 THEN ' ' || {did} || ' ' ELSE {did} END AS cid_raw, "
        f"{call_json} AS c_json, CASE WHEN doc_id % 4 = 0 THEN '{{\"buyer_city\": \"' || source || '\"}}' "
        "WHEN doc_id % 4 = 1 THEN 'undefined' END AS c_inf, doc_id AS s1, 0 AS s2 FROM documents), "
        "cj AS (SELECT CAST(user_id AS VARCHAR) AS cid_raw, CASE WHEN event_type = 'purchase' THEN props ELSE '' END "
        "AS j_json, CASE WHEN event_type = 'signup' THEN '{\"buyer_name\": \"u' || CAST(user_id AS VARCHAR) || '\"}' "
        "ELSE 'null' END AS j_inf, ts AS s1, event_id AS s2 FROM events), "
        "man AS (SELECT CAST(conv_id AS VARCHAR) AS cid_raw, CASE WHEN role = 'system' THEN '  ' ELSE text END AS tr, "
        "CASE role WHEN 'user' THEN 'manual' WHEN 'assistant' THEN 'ai' ELSE ' Manual ' END AS typ, "
        "CASE WHEN quality IS NOT NULL THEN 'Buyer ' || CAST(conv_id AS VARCHAR) END AS x_buyer_name, "
        "CASE quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS x_verdict, "
        "CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'n/a' ELSE CAST(quality * 100 AS VARCHAR) || '.0' END AS x_acc, "
        "CASE WHEN quality = 1 THEN '92.5' WHEN quality = 0 THEN '-' END AS x_comp, "
        "CASE WHEN toxic = 1 THEN 'flagged \"toxic\"' || chr(9) || 'content' WHEN quality = 1 THEN 'Matches the call.' END "
        "AS x_reason, turn AS s1 FROM conversations c LEFT JOIN labels l ON c.conv_id = l.doc_id), "
        f"c1 AS (SELECT * FROM (SELECT {_clean_id('cid_raw')} AS call_id, c_json, c_inf, row_number() OVER "
        f"(PARTITION BY {_clean_id('cid_raw')} ORDER BY s1, s2) AS rn FROM calls WHERE {_clean_id('cid_raw')} IS NOT NULL) "
        "WHERE rn = 1), "
        f"j1 AS (SELECT * FROM (SELECT {_clean_id('cid_raw')} AS call_id, j_json, j_inf, row_number() OVER "
        f"(PARTITION BY {_clean_id('cid_raw')} ORDER BY s1, s2) AS rn FROM cj WHERE {_clean_id('cid_raw')} IS NOT NULL) "
        "WHERE rn = 1), "
        f"tr AS (SELECT call_id, tr FROM (SELECT {_clean_id('cid_raw')} AS call_id, tr, row_number() OVER "
        f"(PARTITION BY {_clean_id('cid_raw')} ORDER BY s1 DESC) AS rn FROM man WHERE trim(tr) <> '' AND "
        f"{_clean_id('cid_raw')} IS NOT NULL) WHERE rn = 1), "
        f"m1 AS (SELECT * FROM (SELECT {_clean_id('cid_raw')} AS call_id, x_buyer_name, x_verdict, x_acc, x_comp, "
        f"x_reason, row_number() OVER (PARTITION BY {_clean_id('cid_raw')} ORDER BY s1) AS rn FROM man WHERE "
        f"lower(trim(typ)) = 'manual' AND {_clean_id('cid_raw')} IS NOT NULL) WHERE rn = 1), "
        "e AS (SELECT m1.*, c1.c_json, c1.c_inf, j1.j_json, j1.j_inf, tr.tr FROM m1 LEFT JOIN c1 USING (call_id) "
        "LEFT JOIN j1 USING (call_id) LEFT JOIN tr USING (call_id) "
        "WHERE c1.call_id IS NOT NULL OR j1.call_id IS NOT NULL), "
        f"f AS (SELECT *, {_dnorm('tr')} AS transcript, coalesce({_dnorm('j_json')}, {_dnorm('c_json')}) AS call_json, "
        f"coalesce({_dnorm('c_inf')}, {_dnorm('j_inf')}) AS inf0, {exp} AS expected_output FROM e), "
        "g AS (SELECT *, CASE WHEN json_valid(call_json) THEN call_json "
        "WHEN json_valid(replace(call_json, '''', '\"')) THEN replace(call_json, '''', '\"') END AS pj FROM f), "
        f"h AS (SELECT *, CASE WHEN inf0 IS NOT NULL THEN TRUE WHEN pj IS NULL OR json_type(pj) <> 'OBJECT' THEN FALSE "
        f"ELSE coalesce({derived_any}, FALSE) END AS has_inf FROM g), "
        "cls AS (SELECT call_id, expected_output, '{\"call_id\": ' || CAST(to_json(call_id) AS VARCHAR) || '}' AS metadata, "
        "CASE WHEN transcript IS NULL THEN 'transcript' WHEN call_json IS NULL THEN 'call_json' "
        "WHEN NOT has_inf THEN 'inferred_details' WHEN expected_output = '{}' THEN 'manual_audit' END AS reject_reason FROM h)")


def dataset_status_sql() -> str:
    return f"WITH {_dataset_ctes()} SELECT call_id, reject_reason, expected_output, metadata FROM cls"


def dataset_counters_sql() -> str:
    def rows_dups(src, prefix, cond="TRUE"):
        return (f"(SELECT CAST(count(*) AS BIGINT) AS {prefix}_rows, CAST(count(*) - count(DISTINCT "
                f"{_clean_id('cid_raw')}) AS BIGINT) AS {prefix}_dups FROM {src} WHERE {_clean_id('cid_raw')} "
                f"IS NOT NULL AND {cond})")
    metrics = ["calls_rows", "manual_rows", "manual_typed_rows", "call_jsons_rows", "eligible",
               *[f"missing_{x}" for x in K.REJECT_REASONS], "final", "calls_dups", "manual_typed_dups",
               "call_jsons_dups"]
    r = ("(SELECT CAST(count(*) AS BIGINT) AS eligible, "
         + ", ".join(f"CAST(count(*) FILTER (WHERE reject_reason = '{x}') AS BIGINT) AS missing_{x}"
                     for x in K.REJECT_REASONS)
         + ", CAST(count(*) FILTER (WHERE reject_reason IS NULL) AS BIGINT) AS final FROM cls)")
    return (f"WITH {_dataset_ctes()}, w AS (SELECT * FROM {rows_dups('calls', 'calls')}, {rows_dups('man', 'manual')}, "
            f"{rows_dups('man', 'manual_typed', "lower(trim(typ)) = 'manual'")}, {rows_dups('cj', 'call_jsons')}, {r}) "
            f"SELECT metric, value FROM w UNPIVOT (value FOR metric IN ({', '.join(metrics)}))")


# --- screenshot audits ------------------------------------------------------------
def _screen_ctes() -> str:
    def nearest(centres):
        c = "[" + ", ".join(f"CAST(trunc({v} * scale) AS INTEGER)" for v in centres) + "]"
        return (f"list_sort(list_transform(range({len(centres)}), lambda i: struct_pack(d := abs(cy - ({c})[i + 1]), "
                f"i := i)))[1].i")
    grid = " ".join(f"WHEN col = {c} AND rw = {r} THEN {q(f)}" for (c, r), f in K.GRID_FIELDS.items())
    badge_cases = " ".join(f"WHEN regexp_matches(upper(trim(text)), {q('|'.join(tokens))}) THEN {q(label)}"
                           for label, tokens in K.BADGE_RULES)
    return (
        "images AS (SELECT o_orderkey AS image_id, CASE WHEN starts_with(o_orderpriority, '1') THEN 1800 ELSE 900 END "
        f"AS height, {D.SCREEN_WIDTH} AS width, o_orderstatus, o_custkey FROM orders), "
        "hdr AS (SELECT image_id, CASE WHEN o_orderstatus = 'P' THEN 'Ticket' ELSE 'Call ID: ' || "
        "CAST(image_id AS VARCHAR) END || ' ' || '| Auditor: Clerk ' || CAST(o_custkey % 7 AS VARCHAR) AS header "
        "FROM images), "
        "hf AS (SELECT image_id, coalesce(nullif(regexp_extract(header, '(?i)Call\\s*ID:\\s*(\\d+)', 1), ''), 'Unknown') "
        "AS call_id, coalesce(nullif(trim(regexp_extract(header, '(?i)Auditor:\\s*([^|]+)', 1)), ''), 'Unknown') "
        "AS auditor FROM hdr), "
        f"det AS (SELECT l_orderkey AS image_id, l_linenumber AS seq, l_partkey AS s2, l_suppkey AS s3, {pick(D.LABEL_CASES, 'l_partkey + l_linenumber * 3')} "
        "AS text, CAST(l_partkey % 600 AS DOUBLE) AS x0, CAST((l_suppkey * 37 + l_linenumber * 101) % 880 AS DOUBLE) AS y0 "
        "FROM lineitem), "
        f"b AS (SELECT d.image_id, seq, s2, s3, CASE {badge_cases} END AS label, "
        "CAST(trunc((x0 + x0 + 41 + x0 + 41 + x0) / 4) AS INTEGER) + CAST(trunc(width * 0.6) AS INTEGER) AS cx, "
        "CAST(trunc((y0 + y0 + y0 + 21 + y0 + 21) / 4) AS INTEGER) AS cy, height / 900.0 AS scale, width "
        "FROM det d JOIN images i USING (image_id)), "
        "g AS (SELECT image_id, seq, s2, s3, label, CASE WHEN cx < CAST(trunc(width * 0.8) AS INTEGER) THEN 1 ELSE 2 END AS col, "
        "cy < CAST(trunc(460 * scale) AS INTEGER) AS man, "
        f"CASE WHEN cy < CAST(trunc(460 * scale) AS INTEGER) THEN {nearest(K.GRID_MANUAL_CENTRES)} "
        f"ELSE {nearest(K.GRID_AI_CENTRES)} END AS rw FROM b WHERE label IS NOT NULL), "
        f"placed AS (SELECT image_id, seq, s2, s3, CASE WHEN man THEN 'manual' ELSE 'ai' END AS section, CASE {grid} END AS field, "
        "label FROM g), "
        "last AS (SELECT image_id, section, field, label FROM (SELECT *, row_number() OVER (PARTITION BY image_id, "
        "section, field ORDER BY seq DESC, s2 DESC, s3 DESC) AS rn FROM placed WHERE field IS NOT NULL) WHERE rn = 1)")


def grid_cells_sql() -> str:
    return f"WITH {_screen_ctes()} SELECT image_id, section, field, label FROM last"


def screen_header_sql() -> str:
    return f"WITH {_screen_ctes()} SELECT image_id, call_id, auditor FROM hf"


def _screen_cmp() -> str:
    cols, matches, compared = [], [], []
    for f in K.FIELDS:
        m = f"max(label) FILTER (WHERE section = 'manual' AND field = {q(f)})"
        a = f"coalesce(max(label) FILTER (WHERE section = 'ai' AND field = {q(f)}), 'Correct')"
        cols.append(f"{m} AS m_{f}, {a} AS a_{f}")
    wide = f"SELECT i.image_id, {', '.join(cols)} FROM images i LEFT JOIN last USING (image_id) GROUP BY i.image_id"
    has = "(" + " OR ".join(f"m_{f} IS NOT NULL" for f in K.AUDITED_FIELDS) + ")"
    out = []
    for f in K.FIELDS:
        if f in K.AUDITED_FIELDS:
            out += [f"CASE WHEN has_manual THEN coalesce(m_{f}, a_{f}) END AS {f}_manual", f"a_{f} AS {f}_ai",
                    f"CASE WHEN has_manual THEN CASE WHEN m_{f} IS NULL THEN 1 ELSE "
                    f"CAST({mclass(f'm_{f}')} = {mclass(f'a_{f}')} AS INTEGER) END END AS {f}_match"]
        else:
            out += [f"CAST(NULL AS VARCHAR) AS {f}_manual", f"a_{f} AS {f}_ai", f"CAST(NULL AS INTEGER) AS {f}_match"]
        matches.append(f"coalesce({f}_match, 0)")
        compared.append(f"CAST({f}_match IS NOT NULL AS INTEGER)")
    return (f"WITH {_screen_ctes()}, w AS ({wide}), c AS (SELECT w.image_id, coalesce(hf.call_id, 'Unknown') AS call_id, "
            f"coalesce(hf.auditor, 'Unknown') AS auditor, {has} AS has_manual, {', '.join(out)} FROM w "
            f"LEFT JOIN hf USING (image_id)) SELECT *, {' + '.join(matches)} AS matches, "
            f"{' + '.join(compared)} AS compared_fields, CASE WHEN {' + '.join(compared)} > 0 THEN "
            f"({' + '.join(matches)}) / ({' + '.join(compared)}) * 100.0 END AS accuracy FROM c")


def screen_comparison_sql() -> str:
    return _screen_cmp()


def screen_field_accuracy_sql() -> str:
    parts = [f"SELECT {i + 1} AS field_pos, {q(K.FIELD_DISPLAY[f])} AS field_name, count({f}_match) AS compared, "
             f"CAST(coalesce(sum({f}_match), 0) AS BIGINT) AS matched FROM s" for i, f in enumerate(K.FIELDS)]
    return (f"WITH s AS ({_screen_cmp()}), u AS ({' UNION ALL '.join(parts)}) SELECT *, CASE WHEN compared > 0 THEN "
            "matched / compared * 100.0 END AS accuracy FROM u")


def screen_binary_sql() -> str:
    cols = ", ".join(f"{f}_match AS {f}" for f in K.FIELDS)
    return (f"WITH s AS ({_screen_cmp()}) SELECT image_id, call_id, auditor, {cols}, matches, compared_fields, "
            "round(accuracy, 2) AS accuracy FROM s")


def screen_values_sql() -> str:
    cols = ", ".join(f"{f}_manual, {f}_ai" for f in K.FIELDS)
    return f"WITH s AS ({_screen_cmp()}) SELECT image_id, call_id, {cols} FROM s"


def screen_summary_statistics_sql() -> str:
    parts = []
    for i, f in enumerate(K.FIELDS):
        counts = ", ".join(f"count(*) FILTER (WHERE {f}_manual = {q(label)}) AS {short}" for short, label in K.SUMMARY_LABEL_COLUMNS)
        parts.append(f"SELECT {i + 1} AS field_pos, {q(K.FIELD_DISPLAY[f])} AS field_name, {counts}, count({f}_match) AS compared, "
                     f"CAST(coalesce(sum({f}_match), 0) AS BIGINT) AS matched FROM s")
    return (f"WITH s AS ({_screen_cmp()}), u AS ({' UNION ALL '.join(parts)}), a AS (SELECT *, CASE WHEN compared > 0 THEN "
            "matched / compared * 100.0 END AS accuracy FROM u) SELECT *, CASE WHEN accuracy >= 90 THEN 'green' "
            "WHEN accuracy >= 75 AND accuracy <= 89.9 THEN 'yellow' WHEN accuracy < 75 THEN 'red' END AS band FROM a")


def screen_overall_sql() -> str:
    rates = ", ".join(f"avg({f}_match)" for f in K.FIELDS)
    return (f"WITH s AS ({_screen_cmp()}), t AS (SELECT CAST(coalesce(sum(compared_fields), 0) AS BIGINT) AS compared, "
            f"CAST(coalesce(sum(matches), 0) AS BIGINT) AS matched, [{rates}] AS rates FROM s) "
            "SELECT compared, matched, CASE WHEN compared > 0 THEN matched / compared * 100.0 END AS accuracy, "
            "round(list_avg(rates) * 100.0, 6) AS macro_accuracy FROM t")


def benchmark_comparison_sql() -> str:
    models = [*D.MODEL_IDS, D.ABSENT_MODEL]
    cols = ", ".join(f"coalesce(max(response) FILTER (WHERE model = {q(m)}), 'ERROR') AS \"{m}\"" for m in models)
    return (f"WITH {responses()} SELECT e.event_id AS row_id, e.event_type, {cols} FROM events e "
            "LEFT JOIN rc ON rc.row_id = e.event_id GROUP BY 1, 2")


def benchmark_summary_sql() -> str:
    zeros = ", ".join("0" if c in ("requests", "success", "failed") else "0.0" for c in (
        "requests", "success", "failed", "avg_latency", "min_latency", "max_latency", "stddev_latency",
        "avg_prompt_tokens", "avg_completion_tokens", "avg_total_tokens", "avg_cost", "p95_latency"))
    return f"{model_stats_sql()} UNION ALL SELECT {q(D.ABSENT_MODEL)}, {zeros}"


def inferred_details_sql() -> str:
    def out(city, name, number, seller_city, seller):
        return (f"'{{\"buyer_city\": ' || {city} || ', \"buyer_name\": ' || {name} || ', \"buyer_number\": ' || {number} || "
                f"', \"seller_city\": ' || {seller_city} || ', \"seller_name\": ' || {seller} || '}}'")
    no = "'\"\"'"

    def text(x):
        return f"'\"' || {x} || '\"'"
    c0 = out(text("'C' || k"), text("event_type"), no, text("'S' || k"), no)
    c1 = out(no, text("'N' || k"), f"CASE WHEN event_id = 0 THEN {no} ELSE k END", no, no)
    c6 = out(no, no, text("k"), no, text("event_type"))
    notes = {2: "no value found", 3: "not an object", 4: "party is not an object", 5: "unparsable"}
    whens = " ".join(f"WHEN {c} THEN {q(n)}" for c, n in notes.items())
    return ("WITH t AS (SELECT event_id, event_type, CAST(event_id AS VARCHAR) AS k, event_id % 7 AS c FROM events) "
            f"SELECT event_id, CASE c {whens} END AS note, CASE c WHEN 0 THEN {c0} WHEN 1 THEN {c1} WHEN 6 THEN {c6} END AS details FROM t")


def doc_label_agreement_sql() -> str:
    return (f"WITH j AS (SELECT l.quality, coalesce({badge('d.text')}, 'none') AS badge FROM labels l JOIN documents d USING (doc_id)) "
            "SELECT quality, badge, count(*) AS n, (quality = 1) = (badge IN ('Correct', 'Correct (Not Discussed)', 'Inferred')) AS agrees "
            "FROM j GROUP BY quality, badge")


# --- rendered prompts ---------------------------------------------------------------
def fanout_prompts_sql() -> str:
    """The patterns consume what the library only looks ahead to: only their first group is used, which is the same."""
    def prompt(x):
        s = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
        blanks = ", ".join(q(t) for t in K.NULLS_PROMPT)
        return f"CASE WHEN {x} IS NULL OR lower({s}) IN ({blanks}) THEN '' ELSE {s} END"

    def group(x, pattern, default):
        return f"coalesce(nullif(trim(regexp_extract({x}, {q(pattern)}, 1)), ''), {q(default)})"

    def value_of(name):
        return "\\b" + name + "\\s*=\\s*([^|#\\-\\n\\r\\t]+?)(?:\\b\\w+\\s*=|$)"

    def filled(template, pairs):
        out = q(template)
        for placeholder, value in pairs:
            out = f"replace({out}, {q(placeholder)}, {value})"
        return out

    system = filled(D.SYSTEM_TEMPLATE, zip(K.SYSTEM_PLACEHOLDERS, ["s_name", "s_company"]))
    user = filled(D.USER_TEMPLATE, zip(K.USER_PLACEHOLDERS, ["d", "p", "pa", "o", "s_name", "b_name"]))
    return (
        "WITH seller AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey), "
        "raw AS (SELECT c.conv_id, c.turn, CASE WHEN c_nationkey % 3 = 0 THEN 'Name=' || replace(c_name, '#', ' ') || ' Company=' || c_mktsegment "
        "|| ' City=' || n_name WHEN c_nationkey % 3 = 1 THEN 'Company=' || c_mktsegment || ' | City=' || n_name "
        "ELSE 'Name=' || c_name || ' Company=' || c_mktsegment END AS details, 'Product=' || p_name || ' Type=' || p_type AS product, "
        "prev.text AS past, CASE WHEN c.turn % 2 = 0 THEN 'Hello, a buyer named ' || split_part(c.text, ' ', 1) || ' from ' "
        "|| coalesce(n_name, '') || '. ' || c.text ELSE c.text END AS ongoing "
        "FROM conversations c LEFT JOIN conversations prev ON prev.conv_id = c.conv_id AND prev.turn = c.turn - 1 "
        "LEFT JOIN seller ON c.conv_id = c_custkey LEFT JOIN part ON c.conv_id = p_partkey), "
        f"clean AS (SELECT conv_id, turn, {prompt('details')} AS d, {prompt('product')} AS p, {prompt('past')} AS pa, {prompt('ongoing')} AS o FROM raw), "
        f"named AS (SELECT *, {group('d', value_of('Name'), 'Seller')} AS s_name, {group('d', value_of('Company'), 'Company')} AS s_company, "
        f"{group('o', 'buyer named\\s+([A-Za-z\\s]+?)(?:\\s+from|$)', K.DEFAULT_BUYER_NAME)} AS b_name FROM clean) "
        f"SELECT conv_id, turn, model, {system} AS system_prompt, {user} AS user_prompt "
        f"FROM named, (SELECT unnest({sql_list([m[0] for m in D.DEFAULT_MODELS])}) AS model)")
