"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust a score.

Base kinds (kept whatever their score): e-mail addresses, IP addresses with parts up to 255, card numbers of 16 to
19 digits that pass Luhn, international phone numbers of 8 to 15 digits. Added kinds: IBANs that pass mod-97, and
local phone numbers when a context word lifts their score to ``ACCEPT``. Matches are leftmost and do not overlap
within a kind; a match that fails its check is dropped and not tried again. Offsets are code points, end exclusive.

A pattern's matches and the gaps between them come from two built-in functions; offsets are running sums over one
document's pieces. Possessive repeats and look-behinds keep the matching linear without changing what is found.

Defined results: NULL text counts as empty and has no spans. Every row is reported on its own (repeated rows each);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens.llm import store
from auditlens.llm.quality_rules import let

ACCEPT = 0.5
#: Characters on either side that are searched for context words.
NEAR = 40
LIFT = 0.25


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    trigger: str  # a text without a match of this has no span of the kind
    score: float
    context: str
    base: bool = True


#: In the order in which spans are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9,
         r"(?i)mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", r"[0-9]\.[0-9]", 0.6, r"(?i)\bip\b|address|host|server|login"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9]", 0.7, r"(?i)card|credit|visa|pay|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"(?i)phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}",
         0.8, r"(?i)iban|account|bank|konto|compte|cuenta", base=False),
    Kind("local_phone", r"(?<![0-9+.-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /-])[0-9]{3,4}[ -]?[0-9]{3,5}(?![0-9.-])", r"[0-9]{3}", 0.3,
         r"(?i)phone|call|\btel|mobile|fax|telefon|teléfono|téléphone", base=False),
)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The digits' Luhn sum is a multiple of ten."""
    signs = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    worth = F.transform(signs, lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 % 10 + F.floor((F.ascii(c) - 48) / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 13616: country and check digits moved to the end, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(iban, " ", "")
    signs = F.filter(F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), ""), lambda c: c != "")
    worth = F.transform(signs, lambda c: F.when(F.ascii(c) < 65, F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(worth, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The checks of a kind, by value."""
    n = F.length(digits(match))
    small = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|0++(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)|0++)"
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{small}(?:\.{small}){{3}}$"),
        "card": F.when(n.between(16, 19), luhn(digits(match))).otherwise(False),
        "phone": n.between(8, 15),
        "iban": F.when(F.length(F.regexp_replace(match, " ", "")).between(15, 34), mod97(match)).otherwise(False),
        "local_phone": n.between(7, 13),
    }[kind]


def _proposed(text: Column, order: int, kind: Kind) -> Column:
    """array<struct<kind, i, gap, match, near>>: every match with the length of the gap before it."""

    def pieces(found: Column, gaps: Column) -> Column:
        return F.transform(found, lambda m, i: F.struct(
            F.lit(order).alias("kind"), i.cast("int").alias("i"), F.length(F.get(gaps, i)).cast("long").alias("gap"), m.alias("match"),
            F.concat(F.right(F.get(gaps, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(NEAR))).alias("near")))

    empty = F.filter(F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("gap"),
                                      F.lit("").alias("match"), F.lit("").alias("near"))), lambda x: F.lit(False))
    full = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
               lambda found: let(F.split(text, kind.pattern, -1), lambda gaps: pieces(found, gaps)))
    return F.when(text.rlike(kind.trigger), full).otherwise(empty)


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(row, doc_id, kind, start, end, score): the confirmed spans, and one row of kind -1 per row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    mark = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("gap"),
                            F.lit("").alias("match"), F.lit("").alias("near")))
    found = rows.select("row", "doc_id", F.inline(F.concat(mark, *(_proposed(F.col("text"), k, kind) for k, kind in enumerate(kinds)))))
    upto = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("row", "kind").orderBy("i"))
    placed = (found.repartition("row").withColumn("end", upto).withColumn("start", F.col("end") - F.length("match")))
    ok, score = F.col("kind") == -1, F.lit(1.0)
    for k, kind in enumerate(kinds):
        here = F.least(F.lit(1.0), F.lit(kind.score) + F.when(F.col("near").rlike(kind.context), LIFT).otherwise(0.0))
        score = F.when(F.col("kind") == k, here).otherwise(score)
        accept = confirmed(kind.name, F.col("match"))
        ok = ok | ((F.col("kind") == k) & (accept if kind.base else accept & (here >= ACCEPT)))
    return placed.filter(ok).select("row", "doc_id", "kind", "start", "end", score.alias("score"))


def personal_data(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores for every row of ``docs``."""
    name = F.array(*(F.lit(k.name) for k in kinds))
    n_base = sum(k.base for k in kinds)
    spans = F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, F.struct("kind", "start", "end", "score"))))
    per_row = find_spans(docs, kinds).groupBy("row").agg(F.first("doc_id").alias("doc_id"), spans.alias("s"))

    def listed(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def counted(k: int) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{kinds[k].name}")

    counts = [counted(k) for k in range(n_base)]
    return per_row.select("doc_id", *counts, F.sha2(listed(F.filter("s", lambda x: x["kind"] < n_base)), 256).alias("base_sha256"),
                          listed(F.col("s")).alias("spans"),
                          F.array_join(F.transform("s", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(store.documents(spark, sf_dir))
