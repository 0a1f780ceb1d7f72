import random
import statistics

import pytest
from pyspark.sql import functions as F

from auditlens.operators import fanout as FO
from auditlens.operators.quantile import exact_percentile


def py_pct(vals, p):
    """Linear interpolation between order statistics, by the standard library where it defines it."""
    if len(vals) == 1:
        return vals[0]
    return {0.0: min, 1.0: max}.get(p, lambda v: statistics.quantiles(v, n=100, method="inclusive")[round(p * 100) - 1])(vals)


@pytest.mark.parametrize("accuracy", [1_000_000, 100])  # 100: a bracket far narrower than the large groups
def test_exact_percentile_matches_python(spark, accuracy):
    rng = random.Random(7)
    rows = []
    for g, n in (("a", 1), ("b", 2), ("c", 57), ("d", 400), ("hot", 3000)):
        for _ in range(n):
            rows.append((g, float(rng.choice([rng.randint(0, 50), rng.random() * 100]))))
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: r.percentile for r in exact_percentile(df, ["g"], "v", p, accuracy=accuracy).collect()}
        for g in got:
            exp = py_pct([v for k, v in rows if k == g], p)
            assert got[g] == pytest.approx(exp, rel=1e-12, abs=1e-12), (g, p)


def test_call_models_retries_and_failures(spark):
    class _Err(Exception):  # defined here so the workers receive it by value
        def __init__(self, code):
            super().__init__(f"status {code}")
            self.status_code = code

    def client(model, system, user):
        if model == "bad":
            raise _Err(400)
        if model == "flaky" and "retry" not in user:
            raise _Err(429)
        return {"response": f"{model}:{user}", "prompt_tokens": 3, "completion_tokens": 2, "total_tokens": 5}

    tasks = spark.createDataFrame([(1, "good", "s", "u"), (2, "bad", "s", "u"), (3, "flaky", "s", "u")],
                                  "row_id long, model string, system_prompt string, user_prompt string")
    sleeps = []
    out = {r.model: r for r in FO.call_models(tasks, client, sleep=sleeps.append).collect()}
    assert out["good"].status == "Success" and out["good"].total_tokens == 5
    assert out["bad"].status == "Failed" and out["bad"].response == "ERROR" and out["bad"].prompt_tokens is None
    assert out["flaky"].status == "Failed"  # 1 + 3 attempts, all 429


def test_model_stats_match_python(spark):
    rows = [(i, "m1" if i % 3 else "m2", "r", float(i % 17) / 3, (i if i % 4 else None), 5, None,
             "Success" if i % 5 else "Failed") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, model string, response string, latency double, "
                                     "prompt_tokens long, completion_tokens long, total_tokens long, status string")
    prices = FO.model_dimension(spark, [("m1", "M1", 1.0, 2.0), ("m2", "M2", 0.5, 0.5)])
    st = {r.model: r for r in FO.model_stats(FO.with_cost(df, prices)).collect()}
    for m in ("m1", "m2"):
        sub = [r for r in rows if r[1] == m]
        lat = [r[3] for r in sub]
        assert st[m].avg_latency == pytest.approx(sum(lat) / len(lat))
        assert st[m].p95_latency == pytest.approx(py_pct(lat, 0.95))
        assert st[m].stddev_latency == pytest.approx(statistics.stdev(lat))
        ok_pt = [r[4] for r in sub if r[7] == "Success" and r[4] is not None]
        assert st[m].avg_prompt_tokens == pytest.approx(sum(ok_pt) / len(ok_pt))
        assert st[m].failed == sum(1 for r in sub if r[7] == "Failed")


def test_fan_out_and_pivot(spark):
    rows = spark.createDataFrame([(1,), (2,)], "row_id long")
    models = [("x", "X", 0.0, 0.0), ("y", "Y", 0.0, 0.0)]
    fo = FO.fan_out(rows, models)
    assert fo.count() == 4
    res = fo.select("row_id", "model", F.concat(F.col("model"), F.lit("!")).alias("response")).filter(
        ~((F.col("row_id") == 2) & (F.col("model") == "y")))
    piv = {r.row_id: (r.x, r.y) for r in FO.response_pivot(res, ["x", "y"]).collect()}
    assert piv == {1: ("x!", "y!"), 2: ("x!", "ERROR")}
