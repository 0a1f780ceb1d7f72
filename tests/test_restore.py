from pyspark.sql import functions as F

from auditlens.operators.restore import restore_counters, restore_ids, unique_pair_lookup

CALLS = [("101", "111", "222"), ("102", "333", "444"), ("103", "333", "444"), ("104", "777", "888"),
         ("105", "900", "901"), ("105", "900", "901")]
AUDIT = [("", "111", "222", "A"), ("NaN", "333", "444", "B"), (None, "555", "666", "C"), ("999", "777", "888", "D")]
SCHEMA_C = "`Call ID` string, `Seller GLID` string, `Caller GLID` string"
SCHEMA_A = SCHEMA_C + ", `Audit Column` string"


def test_golden(spark):
    calls = spark.createDataFrame(CALLS[:4], SCHEMA_C)
    audit = spark.createDataFrame(AUDIT, SCHEMA_A)
    assert unique_pair_lookup(calls).count() == 2
    out = {r["Audit Column"]: r["Call ID"] for r in restore_ids(audit, calls).collect()}
    assert out == {"A": "101", "B": "NaN", "C": None, "D": "999"}
    cnt = {r.metric: r.value for r in restore_counters(restore_ids(audit, calls)).collect()}
    assert cnt == {"total_rows": 4, "missing_before": 3, "restored": 1, "still_missing": 2}


def test_same_id_twice_stays_ambiguous_and_keys_are_stripped(spark):
    calls = spark.createDataFrame(CALLS, SCHEMA_C)
    audit = spark.createDataFrame([("None", " 900 ", "901", "E"), ("<NA>", "", "901", "F"),
                                   ("", " 111", "222 ", "G")], SCHEMA_A)
    out = {r["Audit Column"]: (r["Call ID"], r.id_restored) for r in restore_ids(audit, calls).collect()}
    assert out == {"E": ("None", False), "F": ("<NA>", False), "G": ("101", True)}


def test_missing_id_column_is_created(spark):
    calls = spark.createDataFrame(CALLS[:1], SCHEMA_C)
    audit = spark.createDataFrame([("111", "222")], "`Seller GLID` string, `Caller GLID` string")
    assert [r["Call ID"] for r in restore_ids(audit, calls).collect()] == ["101"]


def test_independent_of_partitioning(spark):
    calls = spark.createDataFrame(CALLS * 3, SCHEMA_C)
    audit = spark.createDataFrame(AUDIT * 5, SCHEMA_A)
    a = sorted(map(tuple, restore_ids(audit.repartition(1), calls.repartition(1)).collect()), key=str)
    b = sorted(map(tuple, restore_ids(audit.repartition(7), calls.repartition(5)).collect()), key=str)
    assert a == b
    assert audit.count() == restore_ids(audit, calls).count()
