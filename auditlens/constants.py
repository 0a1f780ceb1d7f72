"""Fixed vocabulary of the audit domain.

Everything in this module is a FIXED VALUE: field lists, header synonyms,
label tokens, null vocabularies and text patterns that must equal the
behaviour being reproduced for results to match. They are stated plainly,
in their natural order, and the operators build their expressions from them.
"""

from __future__ import annotations

# --- FIXED VALUES: the 12 audited fields, in display order -----------------
FIELDS = [
    "buyer_name",
    "buyer_location",
    "buyer_contact",
    "lead_tag",
    "product_name",
    "specifications",
    "quantity",
    "price",
    "actionables",
    "buyer_intent",
    "buyer_questions",
    "reminder",
]

# --- FIXED VALUES: display label of each field ------------------------------
FIELD_DISPLAY = {
    "buyer_name": "Buyer Name",
    "buyer_location": "Buyer Location",
    "buyer_contact": "Buyer Contact Details",
    "lead_tag": "Lead Tag",
    "product_name": "Product Name",
    "specifications": "Specifications",
    "quantity": "Buyer Required Quantity",
    "price": "Price Quoted by Seller",
    "actionables": "Seller Actionables",
    "buyer_intent": "Buyer Intent",
    "buyer_questions": "Buyer Questions",
    "reminder": "Reminder",
}

# --- FIXED VALUES: header synonyms per field (tried in this order) ----------
FIELD_SYNONYMS = {
    "buyer_name": ["buyername", "buyer name"],
    "buyer_location": ["buyerlocation", "buyer location"],
    "buyer_contact": ["buyercontact", "buyer contact", "buyer contact details", "contact"],
    "lead_tag": ["leadtag", "lead tag"],
    "product_name": ["productname", "product name"],
    "specifications": ["specifications", "specification"],
    "quantity": ["quantity", "buyerrequiredquantity", "buyer required quantity"],
    "price": ["price", "pricequotedbyseller", "price quoted by seller"],
    "actionables": ["actionables", "selleractionables", "seller actionables"],
    "buyer_intent": ["buyerintent", "buyer intent"],
    "buyer_questions": ["buyerquestions", "buyer questions"],
    "reminder": ["reminder"],
}
CALL_ID_SYNONYMS = ["callid", "call id"]
AUDITOR_SYNONYMS = ["auditor", "manualauditor", "manual auditor", "auditedby", "audited by"]
# substring fallback for a field header skips headers containing these
HEADER_EXCLUDE = ["reason", "sublabel", "subfield"]
DEFAULT_AUDITOR = "Manual Auditor"

# --- FIXED VALUES: canonical labels ----------------------------------------
CORRECT = "Correct"
NOT_DISCUSSED = "Correct (Not Discussed)"
INFERRED = "Inferred"
INCORRECT = "Incorrect"
MISSING = "Missing"
HALLUCINATION = "Hallucination"
# labels that count as "correct" and match each other
CORRECT_FAMILY = [CORRECT, NOT_DISCUSSED, INFERRED]

# --- FIXED VALUES: badge tokens; substring test on upper-cased stripped text,
# rules applied in this order, first hit wins -------------------------------
BADGE_RULES = [
    (INFERRED, ["INFERRED", "INFER", "INF"]),
    (NOT_DISCUSSED, ["NOT DISCUSSED", "NDT DISCUSSED", "NOT DISCVSSED", "NDT DISCVSSED", "MISCVSSF"]),
    (INCORRECT, ["INCORRECT", "INCO", "JNCO", "JNC", "INC", "NCR", "ICR"]),
    (CORRECT, ["CORRECT", "COAR", "COPP", "COER", "COPPECT", "COA", "COE", "CORR", "CDRRECT",
               "CDRR", "CDRE", "OPREIT", "OPRE", "IORRFIT", "IORR", "IRR", "ORR", "ORRFIT"]),
    (MISSING, ["MISSING", "MISS", "MIS", "MSS", "MSI"]),
    (HALLUCINATION, ["HALLUCINATION", "HALL", "HAL", "LUCI", "HAC"]),
]

# summary column per canonical label, in report order
SUMMARY_LABEL_COLUMNS = [
    ("correct", CORRECT),
    ("correct_nd", NOT_DISCUSSED),
    ("inferred", INFERRED),
    ("missing", MISSING),
    ("incorrect", INCORRECT),
    ("hallucination", HALLUCINATION),
]

# --- FIXED VALUES: null vocabularies (compared after strip) ----------------
# audit comparison: case-insensitive
NULLS_AUDIT = ["", "none", "null", "-", "nan"]
# screenshot audit: case-insensitive
NULLS_SCREEN = ["", "none", "null", "-"]
# id restoration: case-sensitive
NULLS_RESTORE = ["", "nan", "NaN", "NULL", "None", "<NA>"]
# dataset build: case-insensitive
NULLS_DATASET = ["", "null", "none", "nan", "-", "undefined"]
# prompt benchmark: case-insensitive, blank becomes "" rather than null
NULLS_PROMPT = ["nan", "null", "none", "<na>"]
# pandas' default NA strings, applied at CSV scan time
CSV_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                 "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                 "nan", "null"]

# --- text patterns ------------------------------------------------------------
# characters Python's str.strip() removes (derived by rule: str.isspace)
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# FIXED VALUES: extraction patterns
CALL_ID_HEADER_PATTERN = r"(?iU)Call\s*ID:\s*(\d+)"
AUDITOR_HEADER_PATTERN = r"(?iU)Auditor:\s*([^|]+)"
SELLER_NAME_PATTERN = r"(?Ud)\bName\s*=\s*([^|#\-\n\r\t]+?)(?=\b\w+\s*=|$)"
SELLER_COMPANY_PATTERN = r"(?Ud)\bCompany\s*=\s*([^|#\-\n\r\t]+?)(?=\b\w+\s*=|$)"
BUYER_NAME_PATTERN = r"(?Ud)buyer named\s+([A-Za-z\s]+?)(?=\s+from|$)"
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
UNKNOWN_HEADER_VALUE = "Unknown"
DEFAULT_BUYER_NAME = "Buyer"

# --- FIXED VALUES: model health --------------------------------------------
SKIP_MODEL_KEYWORDS = ["embedding", "embed", "rerank", "image", "vision", "tts", "stt",
                       "speech", "audio", "transcribe", "moderation", "whisper", "dall", "flux"]
# ordered: first rule whose any token is a substring of the lower-cased text
ERROR_CLASS_RULES = [
    ("Authentication", ["authentication", "api_key"]),
    ("Permission", ["permission", "forbidden"]),
    ("RateLimit", ["rate limit", "429"]),
    ("Timeout", ["timeout"]),
    ("InvalidRequest", ["invalid"]),
]
ERROR_CLASS_DEFAULT = "Unknown"
ERROR_TEXT_LIMIT = 500

# --- FIXED VALUES: prompt benchmark ----------------------------------------
MAX_WORKERS = 8
RETRY_STATUS_CODES = [429, 500, 502, 503, 504]
RETRY_ATTEMPTS = 3
RETRY_BACKOFF_SECONDS = 2
SUCCESS_STATUS = "Success"
FAILED_STATUS = "Failed"
ERROR_RESPONSE = "ERROR"
SYSTEM_PLACEHOLDERS = ["{{seller_name}}", "{{seller_company}}"]
USER_PLACEHOLDERS = ["{{seller_detail}}", "{{prdDetail}}", "{{convintronew}}",
                     "{{origConvDetail}}", "{{seller_name}}", "{{buyer_name}}"]

# default models: id, display name, USD per million input / output tokens
DEFAULT_MODELS = [
    ("alpha-lite", "Alpha Lite", 0.075, 0.30),
    ("alpha-flash", "Alpha Flash", 0.075, 0.30),
    ("beta-nano", "Beta Nano", 0.15, 0.60),
    ("beta-mini", "Beta Mini", 0.30, 1.20),
    ("gamma-26b", "Gamma 26B", 0.20, 0.80),
]

# --- FIXED VALUES: screenshot grid (base height 900) ----------------------
GRID_BASE_HEIGHT = 900.0
GRID_MANUAL_CENTRES = [120, 180, 240, 300, 360, 420]
GRID_AI_CENTRES = [580, 640, 700, 760, 820, 880]
GRID_SECTION_SPLIT = 460
GRID_PANEL_X = 0.6
GRID_COLUMN_SPLIT_X = 0.8
# (column, row) -> field
GRID_FIELDS = {
    (1, 0): "buyer_name",
    (2, 0): "buyer_location",
    (1, 1): "buyer_contact",
    (2, 1): "lead_tag",
    (1, 2): "product_name",
    (2, 2): "specifications",
    (1, 3): "quantity",
    (2, 3): "price",
    (1, 4): "actionables",
    (2, 4): "buyer_intent",
    (1, 5): "buyer_questions",
    (2, 5): "reminder",
}
# fields a screenshot's manual section audits
AUDITED_FIELDS = ["buyer_name", "buyer_location", "buyer_contact", "product_name",
                  "specifications", "quantity", "price", "actionables"]

# --- FIXED VALUES: dataset build -------------------------------------------
ID_ALIASES = ["Call ID", "call_id", "CallID"]
CALL_JSONS_ID_ALIASES = ["Call ID", "call_id", "CallID", "PNS_Call_ID"]
TRANSCRIPT_ALIASES = ["Transcript", "transcript"]
TYPE_ALIASES = ["Type", "type"]
CALL_JSON_ALIASES = ["call_json", "Call JSON", "CallJSON"]
INFERRED_ALIASES = ["inferred_details", "Inferred Details", "InferredDetails"]
MANUAL_INFERRED_COLUMNS = ["Inferred Details", "inferred_details"]
MANUAL_TYPE_VALUE = "manual"
EXPECTED_OUTPUT_FIELDS = {
    "buyer_name": ["buyer_name", "Buyer Name", "BuyerName", "Ai: Buyer Name"],
    "buyer_location": ["buyer_location", "Buyer Location", "BuyerLocation", "Ai: Buyer Location"],
    "buyer_contact": ["buyer_contact", "Buyer Contact", "BuyerContact", "Buyer Contact Details",
                      "Ai: Buyer Contact Details"],
    "product_name": ["product_name", "Product Name", "ProductName", "Ai: Product Name"],
    "specifications": ["specifications", "Specifications", "Specification", "Ai: Specifications"],
    "buyer_required_quantity": ["buyer_required_quantity", "Buyer Required Quantity", "Quantity",
                                "Ai: Buyer Required Quantity"],
    "price_quoted": ["price_quoted", "Price Quoted", "Price Quoted by Seller", "Price",
                     "Ai: Price Quoted by Seller"],
    "seller_actionables": ["seller_actionables", "Seller Actionables", "Actionables of the Seller",
                           "Actionables", "Ai: Actionables of the Seller"],
    "lead_tag": ["lead_tag", "Lead Tag", "LeadTag", "Ai: Lead Tag"],
    "buyer_intent": ["buyer_intent", "Buyer Intent", "BuyerIntent", "Ai: Buyer Intent"],
    "buyer_questions": ["buyer_questions", "Buyer Questions", "BuyerQuestions", "Ai: Buyer Questions"],
    "reminder": ["reminder", "Reminder", "Ai: Reminder"],
    "verdict": ["verdict", "Verdict"],
    "category": ["category", "Category"],
    "reasoning": ["reasoning", "Reasoning"],
    "accuracy_score": ["accuracy_score", "Accuracy Score", "AccuracyScore"],
    "completeness_score": ["completeness_score", "Completeness Score", "CompletenessScore"],
}
SECTION_RULE = "------------------"
SECTION_TITLES = ["Call JSON", "Inferred Details", "Transcript"]
# reject reasons, in the order they are tested
REJECT_REASONS = ["transcript", "call_json", "inferred_details", "manual_audit"]

# --- FIXED VALUES: report formatting ---------------------------------------
BAND_GREEN_MIN = 90.0
BAND_YELLOW_MIN = 75.0
BAND_YELLOW_MAX = 89.9
