import itertools

import pytest
from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.labels import badge, label_match, normalise_label
from auditlens.functions.text import blank_to_null, call_id_before_dot, clean_id, fraction_text, py_strip

TRAPS = [
    ("information", "Inferred"), ("Prince", "Incorrect"), ("tomorrow", "Correct"), ("half", "Hallucination"),
    ("Not Correct", "Correct"), ("MISCVSSF", "Correct (Not Discussed)"), ("Incorrect (inferred)", "Inferred"),
    ("JNCORRECT", "Incorrect"), ("IORRFIT", "Correct"), ("Missing", "Missing"), ("xyz", None),
    ("CORRECT (Not Discussed)", "Correct (Not Discussed)"), ("NDT DISCVSSED", "Correct (Not Discussed)"),
]


def _one(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_badge_traps(spark):
    got = _one(spark, [t for t, _ in TRAPS], badge)
    assert got == [e for _, e in TRAPS]


def test_normalise_blank_and_unknown(spark):
    vals = [None, "", "  ", "-", "None", "NULL", "nan", "xyz", " correct "]
    got = _one(spark, vals, normalise_label)
    assert got == ["Correct (Not Discussed)"] * 7 + ["Correct", "Correct"]
    got = _one(spark, ["xyz"], lambda c: normalise_label(c, unknown_label=None))
    assert got == [None]


def test_match_is_an_equivalence(spark):
    labels = [K.CORRECT, K.NOT_DISCUSSED, K.INFERRED, K.INCORRECT, K.MISSING, K.HALLUCINATION]
    pairs = list(itertools.product(labels, labels))
    df = spark.createDataFrame(pairs, "m string, a string")
    got = {(r.m, r.a): r.x for r in df.select("m", "a", label_match(F.col("m"), F.col("a")).alias("x")).collect()}
    ok = set(K.CORRECT_FAMILY)
    for (m, a), x in got.items():
        assert x == int(m == a or (m in ok and a in ok))
        assert x == got[(a, m)]


def test_strip_matches_python(spark):
    vals = ["  a b  ", "\x1c x \x1f", "\t y\n", "z"]
    assert _one(spark, vals, py_strip) == [v.strip() for v in vals]


@pytest.mark.parametrize("tokens,case,vals,exp", [
    (K.NULLS_RESTORE, True, ["nan", "NAN", " None ", "null", "<NA>"], [None, "NAN", None, "null", None]),
    (K.NULLS_DATASET, False, ["Undefined", "-", "ok "], [None, None, "ok"]),
])
def test_blank_vocabularies(spark, tokens, case, vals, exp):
    assert _one(spark, vals, lambda c: blank_to_null(c, tokens, case)) == exp


def test_id_forms(spark):
    assert _one(spark, ["123.0", " 45 ", "7"], call_id_before_dot) == ["123", "45", "7"]
    assert _one(spark, [None, " nan ", " 9 ", ""], clean_id) == [None, None, "9", None]


def test_fraction_text_matches_python(spark):
    pairs = [(k, n) for n in range(1, 41) for k in range(0, n + 1)]
    df = spark.createDataFrame(pairs, "k long, n long")
    got = [r[0] for r in df.select(fraction_text(F.col("k"), F.col("n"))).collect()]
    exp = [f"{k}/{n} | {k / n * 100:.2f}%" for k, n in pairs]
    assert got == exp
