"""Queries without a SQL oracle, checked against literal expected rows and round trips on sf0.001."""
import json

from conftest import SF001

from auditlens.functions import jsonx as J
from auditlens.functions import template as T
from auditlens.plans import driver_tables as D
from auditlens.plans import queries as Q

SYSTEM = "{{seller_name}}|{{seller_company}}"
USER = "{{seller_detail}}|{{prdDetail}}|{{convintronew}}|{{origConvDetail}}|{{seller_name}}|{{buyer_name}}"


def test_prompts_of_literal_rows(spark):
    rows = [  # details, product, past, ongoing -> system, user
        (("Name=Ravi Company=Acme City=Pune", "Steel", None, "a buyer named Ram Lal from Pune"),
         ("Ravi|Acme", "Name=Ravi Company=Acme City=Pune|Steel||a buyer named Ram Lal from Pune|Ravi|Ram Lal")),
        (("Company=Acme | City=Pune", " nan ", "None", "buyer named Ram, x"), ("Seller|Company", "Company=Acme | City=Pune|||buyer named Ram, x|Seller|Buyer")),
        ((None, "has {{convintronew}}", "<NA>", "buyer named Zoë"), ("Seller|Company", "|has ||buyer named Zoë|Seller|Buyer")),
        (("Name=\u00a0Ana\u00a0", "p", "q", "null"), ("Ana|Company", "Name=\u00a0Ana|p|q||Ana|Buyer"))]
    df = spark.createDataFrame([r[0] for r in rows], "d string, p string, a string, o string")
    system, user = T.render_prompts(SYSTEM, USER, "d", "p", "a", "o")
    assert [(r.s, r.u) for r in df.select(system.alias("s"), user.alias("u")).collect()] == [r[1] for r in rows]


def test_prompt_defaults_are_parameters(spark):
    df = spark.createDataFrame([("", "", "", "")], "d string, p string, a string, o string")
    system, _ = T.render_prompts(SYSTEM, USER, "d", "p", "a", "o", default_seller="S", default_company="C")
    assert df.select(system.alias("s")).first().s == "S|C"


def test_fanout_covers_every_turn_and_model(spark):
    rows = D.read(spark, SF001, "conversations").count()
    out = Q.fanout_prompts(spark, SF001)
    assert out.count() == rows * len(D.DEFAULT_MODELS)
    assert out.filter("system_prompt LIKE '%{{%' OR user_prompt LIKE '%{{seller_detail}}%'").count() == 0


def test_template_split():
    assert T.split_template("System Prompt:\n a b \n\nUser Prompt:\n c ") == ("a b", "c")
    assert T.split_template("only system") == ("only system", "")
    assert T.split_template("s User Prompt: u User Prompt: v") == ("s", "u")


def test_dataset_build_sections(spark):
    cls = {r.call_id: r for r in Q._dataset(spark, SF001)[1].collect()}
    built = {r.call_id: r for r in Q.dataset_build(spark, SF001).collect()}
    assert set(built) == {k for k, r in cls.items() if r.reject_reason is None}
    rule = "------------------\n"
    for cid, r in built.items():
        call, inferred, transcript = (part.split(rule, 1)[1] for part in r.input.split("\n\n", 2) if rule in part)
        assert transcript == cls[cid].transcript
        for text, raw in ((call, cls[cid].call_json), (inferred, cls[cid].inferred_details)):
            if raw.startswith("{'"):  # a Python dict is not JSON and passes through
                assert text == raw
            else:
                assert json.loads(text) == json.loads(raw) and (text.startswith('{\n  "') or text == "{}")
        assert json.loads(r.expected_output) and r.expected_output.startswith('{\n  "')


def test_call_details_of_literal_texts(spark):
    def out(*v):
        keys = ("buyer_city", "buyer_name", "buyer_number", "seller_city", "seller_name")
        return dict(zip(keys, v))
    cases = [
        ('{"buyer_details":{"buyer_location":{"buyer_city":"Pune","city":"X"},"buyer_name":"","name":"Al é"},"seller_details":{"seller_location":"Delhi"}}',
         None, out("Pune", "Al é", "", "Delhi", "")),
        ("{'buyer_details': {'buyer_location': {'city': 'A'}, 'buyer_number': 98765}, 'x': None}", None, out("A", "", 98765, "", "")),
        ('{"buyer_details":"text"}', "party is not an object", None), ('{"seller_details":null,"buyer_Number":"1"}', "party is not an object", None),
        ("[1]", "not an object", None), ("zzz", "unparsable", None), (None, "no call json", None), ("{1, 2}", "unparsable", None),
        ('{"a":1,"a":2,"buyer_Number":"7"}', None, out("", "", "7", "", "")),
        ('{"buyer_details":{"buyer_location":[1],"buyer_phone":0,"name":false}}', "no value found", None),
        ("{'buyer_Number': True, 'x': '\\ud800'}", None, out("", "", True, "", ""))]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").withColumn("v", J.as_variant("t"))
    df = df.withColumn("p", J.details_problem(df.v, df.t))
    got = df.select("i", "p", J.inferred_details(df.v, df.p).alias("d"), J.pretty_json("t").alias("y")).orderBy("i").collect()
    assert [(r.p, r.d and json.loads(r.d)) for r in got] == [c[1:] for c in cases]
    assert got[5].y == "zzz" and got[4].y == "[\n  1\n]"


def test_score_texts(spark):
    want = {"0.0005": "0.0005", "12345678.5": "12345678.5", "1e20": "100000000000000000000", "1e23": "99999999999999991611392", "1e-5": "1e-05",
            "1.25E-7": "1.25e-07", "100.0": "100", "92.5": "92.5", "-3": "-3", ".5": "0.5", "n/a": '"n/a"', "123456789012345678": "123456789012345680"}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r.t: r.j for r in df.select("t", J.score_value("t").alias("j")).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == {k: json.loads(v) for k, v in want.items()}
    assert all(got[k] == want[k] for k in want if k != "123456789012345678")
