"""Column -> Column text helpers built only from Spark built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlens import constants as K


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: drops Unicode white space at both ends (no regex).

    Kept to ONE expression node on purpose: callers nest it (blank handling,
    score coercion), and a multi-reference fast path would multiply the
    expression tree at every level of nesting.
    """
    return F.trim(_c(c).cast("string"), F.lit(K.PY_WHITESPACE))


def blank_to_null(c, tokens: Sequence[str] = K.NULLS_AUDIT, case_sensitive: bool = False,
                  empty_as: str | None = None) -> Column:
    """Strip, then map a blank token (or NULL) to NULL, or to ``empty_as``.

    ``tokens`` are compared after strip; lower-cased unless ``case_sensitive``.
    """
    s = py_strip(c)
    key = s if case_sensitive else F.lower(s)
    toks = list(tokens) if case_sensitive else sorted({t.lower() for t in tokens})
    blank = s.isNull() | key.isin(toks)
    return F.when(blank, F.lit(empty_as)).otherwise(s)


def _sql_lit(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def blank_to_null_named(name: str, tokens: Sequence[str] = K.NULLS_AUDIT, case_sensitive: bool = False) -> Column:
    """``blank_to_null`` of a column given by NAME, sent to the JVM as one SQL expression
    (the Column-API form costs dozens of JVM round trips per call)."""
    s = f"trim(BOTH {_sql_lit(K.PY_WHITESPACE)} FROM CAST({_sql_name(name)} AS STRING))"
    key = s if case_sensitive else f"lower({s})"
    toks = list(tokens) if case_sensitive else sorted({t.lower() for t in tokens})
    in_list = ", ".join(_sql_lit(t) for t in toks)
    return F.expr(f"CASE WHEN {s} IS NULL OR {key} IN ({in_list}) THEN CAST(NULL AS STRING) ELSE {s} END")


def is_blank(c, tokens: Sequence[str] = K.NULLS_AUDIT, case_sensitive: bool = False) -> Column:
    return blank_to_null(c, tokens, case_sensitive).isNull()


def call_id_before_dot(c) -> Column:
    """Audit-comparison id form: text before the first '.', stripped (``123.0`` -> ``123``)."""
    return py_strip(F.substring_index(_c(c).cast("string"), ".", 1))


def clean_id(c) -> Column:
    """Dataset-build id form: NULL -> '', stripped; '' and 'nan' become NULL (row dropped)."""
    s = py_strip(F.coalesce(_c(c).cast("string"), F.lit("")))
    return F.when(F.lower(s).isin("", "nan"), F.lit(None).cast("string")).otherwise(s)


def rlike_any(c, tokens: Sequence[str]) -> Column:
    """True when any token is a substring (literal byte search, no regex)."""
    out = None
    for t in tokens:
        hit = _c(c).contains(t)
        out = hit if out is None else (out | hit)
    return out


def fixed2(x) -> Column:
    """Two decimals of a double's exact binary value, ties to even (as C and Python print it).

    The integer part is split off; the rest, times 2^52, is a whole number plus an exact remainder, so the
    half-way test is integer arithmetic and never sees the decimal spelling of the double. Sent to the JVM as SQL.
    """
    def fixed(v: Column) -> Column:
        a = F.abs(v)
        whole = F.floor(a)
        scaled = (a - whole.cast("double")) * F.lit(float(1 << 52))
        units = F.floor(scaled)
        left = scaled - units.cast("double")
        cents = F.floor(units.cast("decimal(20,0)") * 100 / F.lit(1 << 52).cast("decimal(20,0)"))
        over = (units.cast("decimal(20,0)") * 100 - cents.cast("decimal(20,0)") * F.lit(1 << 52).cast("decimal(20,0)")).cast("double")
        gap = over - F.lit(float(1 << 51)) + left * 100.0
        up = (gap > 0) | ((gap == 0) & (cents % 2 == 1))
        total = whole.cast("decimal(20,0)") * 100 + cents + F.when(up, 1).otherwise(0)
        sign = F.when((v < 0) & (total > 0), F.lit("-")).otherwise(F.lit(""))
        return F.concat(sign, F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("int").cast("string"), 2, "0"))

    return F.transform(F.array(_c(x).cast("double")), fixed)[0]


def fraction_text(num, den) -> Column:
    """``"a/b | p%"`` with a safe divide (0.00 when b is 0)."""
    pct = F.when(_c(den) > 0, _c(num) / _c(den) * 100.0).otherwise(F.lit(0.0))
    return F.concat(_c(num).cast("string"), F.lit("/"), _c(den).cast("string"),
                    F.lit(" | "), fixed2(pct), F.lit("%"))


def percent_text(ratio) -> Column:
    return F.concat(fixed2(_c(ratio) * 100.0), F.lit("%"))


def regex_group_or(c, pattern: str, default: str | None, strip: bool = True) -> Column:
    """First group of ``pattern`` or ``default`` when the pattern does not match."""
    # no match extracts NULL from the empty array; an empty group stays empty
    g = F.get(F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(1)), F.lit(0))
    if strip:
        g = py_strip(g)
    return F.coalesce(g, F.lit(default))


def truncate(c, n: int = K.ERROR_TEXT_LIMIT) -> Column:
    return F.substring(_c(c), 1, n)
