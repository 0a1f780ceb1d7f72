"""Audit-shaped inputs derived from the driver's TPC-H-like tables.

The reference works on spreadsheets of call audits; the test harness ships
TPC-H-like parquet tables instead. These functions derive audit tables from
them with deterministic column arithmetic over the WHOLE table (no row is
dropped), so the work grows with the data. The same derivations are spelled
in DuckDB SQL in ``auditlens.plans.oracle`` for the correctness gate.

Manual audits come from ``lineitem`` (several audit rows per call id, i.e.
re-audits: last row wins), AI audits from ``orders`` (one row per call id),
with different header spellings on each side so header mapping is exercised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens import constants as K

# Label and verdict spellings cycled through the derived audits (test cases
# of the label normaliser: exact, shouted, OCR-mangled, blank, unknown).
LABEL_CASES = ["Correct", "CORRECT (Not Discussed)", "Inferred", "JNCORRECT", "IORRFIT", "Missing",
               "MISCVSSF", "Hallucination", "-", "None", None, "", "Prince", "information",
               "tomorrow", "half", "xyz"]
VERDICT_CASES = ["Yes", "no", " NO ", "Skipped", "", None, "YES "]

MANUAL_HEADERS = ["Buyer Name", "Buyer Location", "Buyer Contact Details", "Lead Tag", "Product Name",
                  "Specifications", "Buyer Required Quantity", "Price Quoted by Seller",
                  "Seller Actionables", "Buyer Intent", "Buyer Questions", "Reminder"]
AI_HEADERS = ["buyerName", "buyer_location", "Contact", "LeadTag", "product name", "Specification",
              "quantity", "Price", "actionables", "Buyer-Intent", "buyer questions", "Reminder"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_lit(v) -> str:
    return "CAST(NULL AS STRING)" if v is None else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pick(values, idx: Column) -> Column:
    # the literal array goes to the JVM as one SQL expression (one round trip)
    arr = F.expr("array(" + ", ".join(_sql_lit(v) for v in values) + ")")
    return F.element_at(arr, (idx % len(values) + 1).cast("int"))


def manual_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    k, p, s, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    call_id = (F.when(n == 7, F.lit(None).cast("string"))
               .when(n == 2, F.concat(k.cast("string"), F.lit(".0")))
               .otherwise(k.cast("string")))
    auditor = F.when(s % 4 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("Auditor "), (s % 4).cast("string")))
    cols = [call_id.alias("Call ID"), auditor.alias("Auditor"),
            _pick(VERDICT_CASES, p + s + n).alias("Verdict")]
    for i, h in enumerate(MANUAL_HEADERS):
        cols.append(_pick(LABEL_CASES, p * (2 * i + 1) + s * (i + 1) + n).alias(h))
    cols.append(F.struct(n.alias("line"), p.alias("part"), s.alias("supp")).alias("_seq"))
    return li.select(*cols)


def ai_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cols = [k.cast("string").alias("call_id"), _pick(VERDICT_CASES, k + c).alias("Call Verdict")]
    for i, h in enumerate(AI_HEADERS):
        cols.append(_pick(LABEL_CASES, k * (i + 3) + c + i).alias(h))
    cols.append(k.alias("_seq"))
    return o.select(*cols)


# --- id restoration: lineitem as source of truth and as the audit to repair --
# seller := l_partkey, caller := l_suppkey, call id := l_orderkey.
# Return-flag 'R' rows lose their id in one of several spellings; some of
# the spellings are NOT missing for the case-sensitive vocabulary.
MISSING_ID_FORMS = [None, "", "nan", " None ", "NULL", "null", "<NA>"]


def restore_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = read(spark, sf_dir, "lineitem")
    calls = li.select(F.col("l_orderkey").cast("string").alias("Call ID"),
                      F.col("l_partkey").cast("string").alias("Seller GLID"),
                      F.col("l_suppkey").cast("string").alias("Caller GLID"))
    blanked = _pick(MISSING_ID_FORMS, F.col("l_linenumber") + F.col("l_suppkey"))
    audit = li.select(
        F.when(F.col("l_returnflag") == "R", blanked)
        .otherwise(F.col("l_orderkey").cast("string")).alias("Call ID"),
        F.concat(F.lit(" "), F.col("l_partkey").cast("string")).alias("Seller GLID"),
        F.col("l_suppkey").cast("string").alias("Caller GLID"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
    )
    return calls, audit


# --- model health: every event is one probe of a model --------------------------
MODEL_FAMILIES = ["openai/gpt-mini", "google/text-embedding", "acme/Vision-Pro", "meta/llama-chat",
                  "acme/whisper-large", "cohere/Rerank-v2", "qwen/chat", "black/FLUX-dev", "mistral/small"]
PROBE_ERROR_STATUS = [401, 403, 429, 504, 400, 500, 502]
PROBE_MESSAGES = ["Authentication Error: invalid api_key", "Permission denied: forbidden for this team",
                  "Rate limit exceeded, retry later", "upstream request timeout",
                  "Invalid request: unknown parameter max_tokens", "model is overloaded",
                  "model crashed: " + "stack frame; " * 45]
PROBE_EXCEPTION = "ReadTimeout: read timed out (read timeout=25)"


def _pick_int(values, idx: Column) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (idx % len(values) + 1).cast("int"))


def probe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events")
    et, eid, uid = F.col("event_type"), F.col("event_id"), F.col("user_id")
    status = (F.when(et == "error", _pick_int(PROBE_ERROR_STATUS, eid))
              .when((et == "signup") & (F.col("value") < 25), F.lit(None).cast("int"))
              .otherwise(F.lit(200)))
    body = (F.when(status == 200, F.lit('{"choices": []}'))
            .when(status == 502, F.lit("Bad gateway <html>"))
            .when(status.isNotNull(), F.concat(F.lit('{"error": {"message": "'),
                                               _pick(PROBE_MESSAGES, eid + uid), F.lit('"}}'))))
    return ev.select(
        F.concat(_pick(MODEL_FAMILIES, uid), F.lit("-"), uid.cast("string")).alias("model"),
        status.alias("http_status"), body.alias("body"),
        F.when(status.isNull(), F.lit(PROBE_EXCEPTION)).alias("exception"),
        F.col("ts"), eid.alias("event_id"))


# --- prompt benchmark ------------------------------------------------------------
# Model dimension: (id, display name, input / output USD per million tokens).
DEFAULT_MODELS = K.DEFAULT_MODELS
MODEL_IDS = [m[0] for m in DEFAULT_MODELS]
ABSENT_MODEL = "delta-none"  # in the benchmark's list, never answers

SYSTEM_TEMPLATE = ("You are {{seller_name}} of {{seller_company}}. Answer as the seller, briefly and in the "
                   "buyer's language.")
USER_TEMPLATE = ("Seller: {{seller_detail}}\nProduct: {{prdDetail}}\nEarlier: {{convintronew}}\n"
                 "Now: {{origConvDetail}}\n\nWrite {{seller_name}}'s next reply to {{buyer_name}}.")


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is one model answer: five consecutive events form one input row."""
    ev = read(spark, sf_dir, "events")
    eid = F.col("event_id")
    ok = F.col("event_type") != "error"
    k = F.get_json_object(F.col("props"), "$.k").cast("long")
    has_usage = ok & (F.col("event_type") != "view")
    pt = F.when(has_usage, k * 10 + 50)
    ct = F.when(has_usage, k + 5)
    return ev.select(
        F.expr("event_id div 5").alias("row_id"),
        _pick(MODEL_IDS, eid).alias("model"),
        F.when(ok, F.concat(F.lit("Response: "), F.col("event_type"), F.lit(" "), k.cast("string")))
        .otherwise(F.lit(K.ERROR_RESPONSE)).alias("response"),
        (F.col("value") / 100.0).alias("latency"),
        pt.alias("prompt_tokens"), ct.alias("completion_tokens"), (pt + ct).alias("total_tokens"),
        F.when(ok, F.lit(K.SUCCESS_STATUS)).otherwise(F.lit(K.FAILED_STATUS)).alias("status"),
    )


def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input rows of the benchmark: every turn of a conversation, with the
    previous turn as past conversation, the customer of the same number as seller
    and the part of the same number as product."""
    conv = read(spark, sf_dir, "conversations")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    prev = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("past"))
    seller = cust.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    nk = F.col("c_nationkey") % 3
    details = (F.when(nk == 0, F.concat(F.lit("Name="), F.regexp_replace("c_name", "#", " "),
                                        F.lit(" Company="), F.col("c_mktsegment"), F.lit(" City="), F.col("n_name")))
               .when(nk == 1, F.concat(F.lit("Company="), F.col("c_mktsegment"), F.lit(" | City="), F.col("n_name")))
               .otherwise(F.concat(F.lit("Name="), F.col("c_name"), F.lit(" Company="), F.col("c_mktsegment"))))
    first_word = F.split(F.col("text"), " ").getItem(0)
    ongoing = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Hello, a buyer named "), first_word, F.lit(" from "),
                                                      F.coalesce(F.col("n_name"), F.lit("")), F.lit(". "),
                                                      F.col("text"))).otherwise(F.col("text"))
    j = (conv.join(prev, ["conv_id", "turn"], "left")
         .join(seller, F.col("conv_id") == F.col("c_custkey"), "left")
         .join(part, F.col("conv_id") == F.col("p_partkey"), "left"))
    return j.select(
        "conv_id", "turn",
        details.alias("User Details"),
        F.concat(F.lit("Product="), F.col("p_name"), F.lit(" Type="), F.col("p_type")).alias("Product Details"),
        F.col("past").alias("Past Conversation"),
        ongoing.alias("Ongoing Conversation"),
    )


# --- dataset build: documents -> calls, events -> call_jsons, conversations+labels -> audit
def dataset_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    did = F.col("doc_id").cast("string")
    w1 = F.regexp_extract(F.col("text"), "^([A-Za-z]+)", 1)
    call_json = (F.when(F.col("lang") == "en", F.concat(
        F.lit('{"buyer_details": {"buyer_name": "'), w1, F.lit('", "buyer_location": {"buyer_city": "'),
        F.col("source"), F.lit('"}, "buyer_number": '), F.col("n_chars").cast("string"),
        F.lit('}, "seller_details": {"name": "S'), did, F.lit('", "seller_location": "'), F.col("lang"),
        F.lit('"}}')))
        .when(F.col("lang") == "fr", F.concat(
            F.lit("{'buyer_details': {'name': '"), w1, F.lit("', 'buyer_location': '"), F.col("source"),
            F.lit("'}, 'buyer_Number': '"), did, F.lit("'}")))
        .when(F.col("lang") == "de", F.concat(F.lit('{"k": '), did, F.lit("}")))
        .otherwise(F.lit("")))
    inferred = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('{"buyer_city": "'), F.col("source"), F.lit('"}')))
                .when(F.col("doc_id") % 4 == 1, F.lit("undefined")))
    calls = docs.select(
        F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit(" "), did, F.lit(" "))).otherwise(did).alias("Call ID"),
        F.col("source").alias("Call Summary"), call_json.alias("call_json"), inferred.alias("inferred_details"),
        F.col("doc_id").alias("_seq"))

    ev = read(spark, sf_dir, "events")
    cj = ev.select(
        F.col("user_id").cast("string").alias("PNS_Call_ID"),
        F.when(F.col("event_type") == "purchase", F.col("props")).otherwise(F.lit("")).alias("call_json"),
        F.when(F.col("event_type") == "signup",
               F.concat(F.lit('{"buyer_name": "u'), F.col("user_id").cast("string"), F.lit('"}')))
        .otherwise(F.lit("null")).alias("inferred_details"),
        F.struct("ts", "event_id").alias("_seq"))

    conv = read(spark, sf_dir, "conversations")
    labels = read(spark, sf_dir, "labels")
    j = conv.join(labels, conv["conv_id"] == labels["doc_id"], "left")
    qual, tox = F.col("quality"), F.col("toxic")
    manual = j.select(
        F.col("conv_id").cast("string").alias("Call ID"),
        F.when(F.col("role") == "system", F.lit("  ")).otherwise(F.col("text")).alias("Transcript"),
        F.when(F.col("role") == "user", F.lit("manual")).when(F.col("role") == "assistant", F.lit("ai"))
        .otherwise(F.lit(" Manual ")).alias("Type"),
        F.when(qual.isNotNull(), F.concat(F.lit("Buyer "), F.col("conv_id").cast("string"))).alias("Ai: Buyer Name"),
        F.when(qual == 1, F.lit("Yes")).when(qual == 0, F.lit("No")).alias("Verdict"),
        F.when(qual.isNull(), F.lit(None).cast("string")).when(tox == 1, F.lit("n/a"))
        .otherwise(F.concat((qual * 100).cast("string"), F.lit(".0"))).alias("Accuracy Score"),
        F.when(qual == 1, F.lit("92.5")).when(qual == 0, F.lit("-")).alias("Completeness Score"),
        F.when(tox == 1, F.lit('flagged "toxic"\tcontent')).when(qual == 1, F.lit("Matches the call."))
        .alias("Reasoning"),
        F.col("turn").alias("_seq"))
    return calls, manual, cj


# --- screenshot audits: orders -> images + header detections, lineitem -> panel detections
SCREEN_WIDTH = 1600


def screenshot_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders")
    images = o.select(F.col("o_orderkey").alias("image_id"),
                      F.when(F.col("o_orderpriority").startswith("1"), F.lit(1800)).otherwise(F.lit(900))
                      .alias("height"), F.lit(SCREEN_WIDTH).alias("width"))
    head0 = F.when(F.col("o_orderstatus") == "P", F.lit("Ticket")).otherwise(
        F.concat(F.lit("Call ID: "), F.col("o_orderkey").cast("string")))
    head1 = F.concat(F.lit("| Auditor: Clerk "), (F.col("o_custkey") % 7).cast("string"))
    empty_box = F.array(*[F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))] * 4)
    headers = o.select(F.col("o_orderkey").alias("image_id"), F.inline(F.array(
        F.struct(F.struct(F.lit(0).alias("line"), F.lit(0).cast("long").alias("part"),
                          F.lit(0).cast("long").alias("supp")).alias("seq"), head0.alias("text")),
        F.struct(F.struct(F.lit(1).alias("line"), F.lit(0).cast("long").alias("part"),
                          F.lit(0).cast("long").alias("supp")).alias("seq"), head1.alias("text"))))).select(
        "image_id", F.lit("header").alias("region"), "seq", empty_box.alias("bbox"), "text",
        F.lit(1.0).alias("prob"))
    li = read(spark, sf_dir, "lineitem")
    x0 = (F.col("l_partkey") % 600).cast("double")
    y0 = ((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 101) % 880).cast("double")

    def pt(x, y):
        return F.struct(x.alias("x"), y.alias("y"))
    bbox = F.array(pt(x0, y0), pt(x0 + 41, y0), pt(x0 + 41, y0 + 21), pt(x0, y0 + 21))
    panel = li.select(F.col("l_orderkey").alias("image_id"), F.lit("panel").alias("region"),
                      F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
                               F.col("l_suppkey").alias("supp")).alias("seq"), bbox.alias("bbox"),
                      _pick(LABEL_CASES, F.col("l_partkey") + F.col("l_linenumber") * 3).alias("text"),
                      F.col("l_discount").alias("prob"))
    return images, headers.unionByName(panel)


def call_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, call): one call text per event, seven shapes in turn: object and text locations, a Python dict,
    values that count as none, a list, a party that is no object, no JSON, and numbers outside the parties."""
    k, kind = F.col("event_id").cast("string"), F.col("event_type")
    shapes = [
        F.concat(F.lit('{"buyer_details":{"buyer_location":{"buyer_city":"C'), k, F.lit('","city":"x"},"buyer_name":"'), kind,
                 F.lit('"},"seller_details":{"seller_location":"S'), k, F.lit('"}}')),
        F.concat(F.lit("{'buyer_details': {'name': 'N"), k, F.lit("', 'buyer_phone': "), k, F.lit("}, 'open': None}")),
        F.lit('{"buyer_details":{"buyer_name":"","name":""},"buyer_Number":0}'),
        F.lit("[1]"), F.lit('{"buyer_details":"t"}'), F.concat(F.lit("call "), k),
        F.concat(F.lit('{"buyer_Number":"'), k, F.lit('","seller_details":{"name":"'), kind, F.lit('"}}'))]
    return read(spark, sf_dir, "events").select("event_id", F.get(F.array(*shapes), (F.col("event_id") % 7).cast("int")).alias("call"))
