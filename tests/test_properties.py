"""Seeded property checks of the label rules against a direct Python reading of them."""
import random

from pyspark.sql import functions as F

from auditlens import constants as K
from auditlens.functions.labels import badge, label_match, normalise_label

FRAGMENTS = [t for _, toks in K.BADGE_RULES for t in toks] + [
    "x", "yz", " ", " ", "　", "-", "none", "NaN", "corr", "ect", "inf", "hal", "lu", "ci", "(", ")",
    "é", "ß", "\t", "not", "dis", "cussed"]


def py_badge(text):
    u = text.strip().upper()
    for label, toks in K.BADGE_RULES:
        if any(t in u for t in toks):
            return label
    return None


def py_norm(text):
    if text is None or text.strip().lower() in K.NULLS_AUDIT:
        return K.NOT_DISCUSSED
    return py_badge(text) or K.CORRECT


def test_badge_and_normalise_match_python(spark):
    rng = random.Random(11)
    vals = []
    for _ in range(3000):
        s = "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.5:
            s = s.lower() if rng.random() < 0.5 else s.title()
        vals.append(s)
    vals.append(None)
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    for method in ("regex", "contains"):
        got = df.select("v", badge(F.col("v"), method).alias("b"), normalise_label(F.col("v")).alias("n")).collect()
        for r in got:
            if r.v is not None:
                assert r.b == py_badge(r.v), (method, r.v)
            assert r.n == py_norm(r.v), r.v


def test_match_symmetric_and_reflexive(spark):
    rng = random.Random(5)
    labels = [K.CORRECT, K.NOT_DISCUSSED, K.INFERRED, K.INCORRECT, K.MISSING, K.HALLUCINATION]
    pairs = [(rng.choice(labels), rng.choice(labels)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select(label_match(F.col("a"), F.col("b")).alias("ab"), label_match(F.col("b"), F.col("a")).alias("ba"),
                     label_match(F.col("a"), F.col("a")).alias("aa")).collect()
    assert all(r.ab == r.ba and r.aa == 1 for r in rows)
