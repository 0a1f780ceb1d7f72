import json

from auditlens.operators import dataset as DS

CALLS_S = "`Call ID` string, `Call Summary` string, call_json string, inferred_details string, _seq long"
CJ_S = "`Call ID` string, call_json string, _seq long"
MAN_S = ("`Call ID` string, Transcript string, `Ai: Buyer Name` string, `Ai: Buyer Location` string, "
         "`Buyer Contact Details` string, `Product Name` string, Verdict string, `Accuracy Score` string, "
         "`Completeness Score` string, Reasoning string, Type string, _seq long")
INF = '{"buyer_city": "Pune"}'
CALLS = [
    ("1001", "s", '{"a": 1}', INF, 1), ("1001", "dup", '{"a": 2}', INF, 2),
    ("1002", "s", '{"a": 1}', INF, 3), ("1003", "s", "", INF, 4),
    ("1004", "s", '{"buyer_name": "Dave"}', None, 5), ("1005", "", '{"a": 1}', INF, 6),
    ("1006", "s", '{"a": 1}', INF, 7), ("2001", "s", '{"a": 1}', INF, 8),
]
CJ = [("1003", '{"call": "x"}', 1), ("1005", None, 2)]
FULL = ("Alice", "Mumbai", "9876543210", "Aluminium Sheets", "Yes", "100.0", "90", "Matches the call.")
BLANK = ("NaN", "None", "", "-", None, "nan", "null", "undefined")


def man(cid, transcript, vals, seq):
    a, b, c, d, v, acc, comp, r = vals
    return (cid, transcript, a, b, c, d, v, acc, comp, r, "manual", seq)


MANUAL = [man("1001", "hello", FULL, 1), man("1002", "NaN", FULL, 2), man("1003", "t3", FULL, 3),
          man("1004", "t4", FULL, 4), man("1005", "t5", FULL, 5), man("1006", "t6", BLANK, 6),
          man("3001", "t7", FULL, 7)]


def _sources(spark, manual=MANUAL, calls=CALLS, cj=CJ):
    return DS.DatasetSources(spark.createDataFrame(calls, CALLS_S), spark.createDataFrame(manual, MAN_S),
                             spark.createDataFrame(cj, CJ_S))


def test_golden_counters(spark):
    src = _sources(spark)
    cls = DS.classify(src)
    got = {r.metric: r.value for r in DS.counters(src, cls).collect()}
    assert got == {"calls_rows": 8, "manual_rows": 7, "manual_typed_rows": 7, "call_jsons_rows": 2, "eligible": 6,
                   "missing_transcript": 1, "missing_call_json": 0, "missing_inferred_details": 1,
                   "missing_manual_audit": 1, "final": 3, "calls_dups": 1, "manual_typed_dups": 0,
                   "call_jsons_dups": 0}
    reasons = {r.call_id: r.reject_reason for r in cls.collect()}
    assert reasons == {"1001": None, "1002": "transcript", "1003": None, "1004": "inferred_details",
                       "1005": None, "1006": "manual_audit"}


def test_golden_expected_output_and_input(spark):
    src = _sources(spark)
    rows = {r.call_id: r for r in DS.accepted(DS.classify(src)).collect()}
    exp = json.dumps({"buyer_name": "Alice", "buyer_location": "Mumbai", "buyer_contact": "9876543210",
                      "product_name": "Aluminium Sheets", "verdict": "Yes", "reasoning": "Matches the call.",
                      "accuracy_score": 100, "completeness_score": 90}, indent=2, ensure_ascii=False)
    assert rows["1001"].expected_output == exp
    assert rows["1001"].metadata == '{"call_id": "1001"}'
    call_json = json.dumps({"a": 1}, indent=2)
    inferred = json.dumps({"buyer_city": "Pune"}, indent=2)
    sep = "------------------"
    assert rows["1001"].input == (f"Call JSON\n{sep}\n{call_json}\n\nInferred Details\n{sep}\n{inferred}"
                                  f"\n\nTranscript\n{sep}\nhello")
    assert json.loads(rows["1003"].input.split(sep)[1].rsplit("\n\n", 1)[0]) == {"call": "x"}


def test_fallbacks_literal_dict_scores_and_cross_type_transcript(spark):
    lit = "{'buyer_details': {'name': 'Ravi', 'buyer_location': {'city': 'Pune'}, 'buyer_phone': 98}}"
    calls = [("1", "s", lit, None, 1)]
    vals = ("A", None, None, None, None, "92.5", "n/a", None)
    manual = [man("1", None, vals, 1), ("1", "from ai row", None, None, None, None, None, None, None, None, "ai", 2)]
    src = _sources(spark, manual=manual, calls=calls, cj=[])
    r = DS.classify(src).collect()[0]
    assert r.reject_reason is None
    assert r.transcript == "from ai row"
    assert json.loads(r.inferred_details) == {"buyer_city": "Pune", "buyer_name": "Ravi", "buyer_number": 98,
                                              "seller_city": "", "seller_name": ""}
    assert r.inferred_details == json.dumps(json.loads(r.inferred_details), ensure_ascii=False)
    assert json.loads(r.expected_output) == {"buyer_name": "A", "accuracy_score": 92.5, "completeness_score": "n/a"}
