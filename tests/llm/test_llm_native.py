"""Decontamination, rules, preference formatting, PII and mixing: brute force and defined edges."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from auditlens.llm import decontamination, mixing, pii, preference, quality_rules, store

DOC = "doc_id long, text string, lang string, source string, row string, term string, item string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z")[:7] if len(r) == 4 else (*r, "en", "s", "x", "y", "z") for r in rows], DOC)


def python_nodes(df):
    return re.findall(r"Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def contaminated(rows, bench):
    out = []
    for i, t in rows:
        w = WORD.findall(ascii_lower(t))
        hit, items = set(), set()
        for item, bt in bench:
            b = WORD.findall(ascii_lower(bt))
            n = min(13, len(b))
            if item is None or not n:
                continue
            wins = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    items.add(str(item))
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((str(i), len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(30)] + ["É", "é", "x1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(k, text(rng.choice([1, 2, 5, 13, 14, 40]))) for k in range(12)] + [(3, text(20)), (50, None), (51, "..."), (None, "v1 v2"), (52, "v1 v1 v1")]
    rows = [(k, text(rng.randrange(0, 90))) for k in range(40)]
    rows += [(100 + k, text(10) + "; " + (bench[k][1] or "").upper() + " - " + text(3)) for k in range(len(bench) - 1)]
    rows += [(200, None), (201, ""), (202, "..."), (203, "V1"), (203, "V1"), (None, "v1 v1 v1 v1"), (204, "\n.v1 É v2." * 3000)]
    b = spark.createDataFrame([(i, t, "q") for i, t in bench], "item_id long, text string, word string")
    d = docs(spark, rows)
    out = decontamination.contamination(d, b)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect())
    assert got == contaminated(rows, bench)
    assert not python_nodes(out)
    left = decontamination.drop_contaminated(d, b)
    assert left.columns == d.columns
    bad = {r[0] for r in got if r[5]}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in rows if str(i) not in bad)


def test_contamination_of_empty_tables(spark):
    d = docs(spark, [(1, "a b")])
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.contamination(d.limit(0), b).count() == 0
    r = decontamination.contamination(d, b.limit(0)).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (2, 0, 0, False)


def test_proximity_finds_reordered_terms(spark):
    d = docs(spark, [(1, "filler " * 30 + "gamma then alpha and beta"), (2, "alpha " + "filler " * 50 + "beta gamma"), (3, "alpha beta")])
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    folder = store.scratch(spark, "prox")
    words = decontamination.benchmark_terms(b).withColumn("term", F.xxhash64("word"))
    index = decontamination.build_index(d, words.select("word", "term").distinct(), folder)
    phrases = decontamination.plan_phrases(words, index, 13, folder)
    near = decontamination.proximity(index, phrases, 10, folder).join(index.filter("first").select("row", F.col("doc_id").alias("d")), "row")
    assert [r.d for r in near.collect()] == [1]


def test_quality_rules_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "a b c d e a b c d e f"), (5, "one line here\none line here\n\none line here"),
            (6, "x y " * 30), (7, "é#ü$ |"), (7, "é#ü$ |"), (8, " ".join(f"the fox{k} and the dog{k} of." for k in range(20))), (9, "w " * 200_000)]
    out = quality_rules.quality_rules(docs(spark, rows))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and not python_nodes(out)

    def repeats(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, cover = {}, set()
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k:k + 5]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                cover |= {p + j for p in places for j in range(5)}
        return len(w), len(cover)

    for i, t in rows:
        assert (got[i].n_words, got[i].n_repeat_words) == repeats(t), i
    assert got[5].n_dup_lines == 2 and got[7].n_symbols == 3 and got[7].word_chars == 5
    assert [got[k].kept for k in (1, 2, 3, 6, 8)] == [False, False, False, False, True]
    assert got[1].base_failed and got[4].base_failed and not got[8].base_failed
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "pair_id long, turn long, role string, text string, c string")


def test_preference_prefix_and_masks(spark):
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "é!"),
         (2, 0, "user", "same"), (3, 5, None, None), (3, 5, "user", "z"), (None, 0, "user", "n"), (4, None, "assistant", "k")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "other"), (2, 0, "user", "same"), (3, 5, "unknown", ""),
         (None, 0, "user", "n"), (4, None, "assistant", "l")]
    out = preference.format_pairs(turns(spark, a), turns(spark, b))
    got = {r.pair_id: r for r in out.collect()}
    one = got[1]
    assert one.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert one.chosen == "<|im_start|>user\nmore<|im_end|>\n<|im_start|>assistant\né!<|im_end|>\n"
    assert (one.n_prompt, one.n_chosen, one.n_rejected, one.paired) == (2, 2, 1, True)
    s, e = map(int, one.chosen_mask.split(":"))
    assert one.chosen[s:e] == "é!" and one.rejected_mask == ""
    assert not got[2].paired and got[2].chosen == "" and not got[3].paired and not got[None].paired
    assert got[4].paired and got[4].prompt == "" and got[4].rejected.endswith("l<|im_end|>\n")
    assert not python_nodes(out)
    assert preference.format_pairs(turns(spark, []), turns(spark, [])).count() == 0


def test_preference_long_conversations_continue_in_blocks(spark):
    a = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(2500)]
    b = a[:2400] + [(1, 2400, "user", "else")]
    out = preference.format_pairs(turns(spark, a), turns(spark, b)).orderBy("block").collect()
    assert [r.block for r in out] == [0, 1, 2]
    whole = "".join(r.prompt for r in out) + "".join(r.chosen for r in out)
    assert whole == "".join(f"<|im_start|>{x[2]}\n{x[3]}<|im_end|>\n" for x in a)
    assert sum(r.n_prompt for r in out) == 2400 and sum(r.n_rejected for r in out) == 1


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 8 <= len(d) <= 15
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return True


def test_pii_matches_plain_patterns(spark):
    rng = random.Random(5)
    pieces = ["a@b.co", "x", "1.2.3.4", "255.256.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+49 (30) 1234-567", "+1", ".", "-", " ", "@", "5",
              "é", "😀", "00.1.02.255", "user.name+tag@mail.example.org", "_", "%", "(", "378282246310005"]
    rows = [(k, "".join(rng.choice(pieces) + rng.choice(["", " ", "", "\n"]) for _ in range(rng.randrange(40)))) for k in range(300)]
    rows += [(900, None), (901, ""), (902, "a@b.c_d@e.f x@y.z. q@w @e.r"), (903, "9" * 60_000 + " " + "a" * 60_000), (904, "1.2.3.4.5.6.7.8"), (904, "0.0.0.0")]
    out = pii.personal_data(docs(spark, rows))
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out.collect())
    want = []
    for i, t in rows:
        found = {k: [m.span() for m in re.finditer(p, (t or "") if i != 903 else t[:60_010]) if passes(k, m.group())] for k, p in PATTERNS.items()}
        text = ",".join(f"{k}:{s}:{e}" for k, spans in found.items() for s, e in spans)
        want.append((i, *(len(s) for s in found.values()), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert not python_nodes(out)
    assert pii.personal_data(docs(spark, [])).count() == 0


@pytest.mark.parametrize("text,spans", [
    ("IBAN DE89370400440532013000", "iban:5:27"), ("IBAN DE89370400440532013001", ""), ("account GB82 WEST 1234 5698 7654 32.", "iban:8:35"),
    ("call 030 1234567 now", "local_phone:5:16"), ("room 030 1234567 now", "")])
def test_pii_added_kinds(spark, text, spans):
    assert pii.personal_data(docs(spark, [(1, text)])).first().spans == spans


def test_raking_meets_the_margins(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randrange(1, 60) + rng.choice(["", "7", " | "]), rng.choice("ab"), rng.choice("xyz")) for k in range(600)]
    rows += [(601, None, None, None), (602, "", "a", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"x": 0.6, "y": 0.3, "z": 0.1}, "lang": {"a": 0.25, "b": 0.75}, "topic": 1.0}
    out = mixing.mixed(d, targets, rate=0.4).cache()
    assert out.count() == len(rows) and not python_nodes(out)
    total = out.agg(F.sum("_tokens")).first()[0]
    for col, want in (("_source", targets["source"]), ("_lang", targets["lang"])):
        got = {r[0]: r[1] for r in out.groupBy(col).agg(F.sum(F.col("_value") * F.col("_tokens"))).collect()}
        for k, share in want.items():
            assert got[k] / (0.4 * total) == pytest.approx(share, rel=5e-3)
    kept = mixing.sample_mix(d, targets, rate=0.4)
    assert kept.columns == [*d.columns, "mix_weight"]
    assert sum(r.mix_weight * len((r.text or "").split()) for r in kept.collect()) == pytest.approx(0.4 * total, rel=0.25)


def test_mixing_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mixed(d).count() == 0
    blank = spark.createDataFrame([(1, None, None, None)], d.schema)
    assert mixing.mixed(blank).first()._value == mixing.RATE
