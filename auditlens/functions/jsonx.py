"""JSON helpers for the dataset build.

Reading is JVM-side: texts become Variants, and the buyer / seller details are path expressions over them. Python
runs in two Arrow ``pandas_udf`` helpers: one turns texts that the JVM parser rejects (Python-literal dicts, repeated
keys, lone surrogates) into strict JSON, and one lays JSON out with Python's two-space indentation.
"""

from __future__ import annotations

import ast
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from auditlens import constants as K
from auditlens.functions.text import _c


def _utf8(text: str) -> str:
    """Half surrogate pairs, which UTF-8 cannot hold, as JSON escapes."""
    return text.encode("utf-8", "backslashreplace").decode("utf-8")


def _each(series: pd.Series, convert) -> pd.Series:
    """``convert`` per non-NULL text; NULL where it raises."""
    def guarded(text):
        try:
            return None if text is None else convert(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
    return series.map(guarded)


def _finite(value):
    """``value`` with NaN and infinities, which strict JSON lacks, as the text that they are written as."""
    if isinstance(value, float) and not math.isfinite(value):
        return json.dumps(value)
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    return [_finite(v) for v in value] if isinstance(value, (list, tuple)) else value


def _strict(text: str) -> str:
    for parse in (json.loads, lambda t: ast.literal_eval(t.strip())):
        try:
            return json.dumps(_finite(parse(text)), allow_nan=False)
        except (ValueError, SyntaxError, TypeError):
            continue
    raise ValueError("neither JSON nor a literal")


@pandas_udf(T.StringType())
def strict_json(text: pd.Series) -> pd.Series:
    """JSON text of a lenient JSON or Python-literal text; NULL when it is neither."""
    return _each(text, _strict)


@pandas_udf(T.StringType())
def _indented(text: pd.Series) -> pd.Series:
    return _each(text, lambda t: _utf8(json.dumps(json.loads(t), indent=2, ensure_ascii=False)))


def pretty_json(c) -> Column:
    """Two-space indented JSON; text that is not JSON passes through."""
    return F.coalesce(_indented(_c(c)), _c(c))


def as_variant(c) -> Column:
    """The text as a Variant: parsed in the JVM, and through Python only where that fails. NULL if unparsable."""
    parsed = F.try_parse_json(_c(c))
    return F.coalesce(parsed, F.try_parse_json(strict_json(F.when(parsed.isNull(), _c(c)))))


#: JSON texts that count as no value.
_FALSY = ['""', "0", "0.0", "-0.0", "false", "null", "[]", "{}"]


def _is(kind: str, v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _first_value(v: Column, *paths: str) -> Column:
    """JSON text of the first path that holds a value (not NULL, empty, zero or false)."""
    texts = [F.to_json(_at(v, p)) for p in paths]
    return F.coalesce(*[F.when(~t.isin(_FALSY), t) for t in texts], F.lit('""'))


def _place(v: Column, path: str, own_key: str) -> Column:
    """A location: a text stands for itself, an object for its city."""
    loc = _at(v, path)
    return (F.when(_is("OBJECT", loc), _first_value(v, f"{path}.{own_key}", f"{path}.city"))
            .when(_is("STRING", loc), F.to_json(loc)).otherwise(F.lit('""')))


def _party_ok(v: Column, path: str) -> Column:
    """A party's details are an object or absent."""
    return _at(v, path).isNull() | _is("OBJECT", _at(v, path))


#: (output key, expression over the parsed call), in output order.
_DETAILS = (
    ("buyer_city", lambda v: _place(v, "$.buyer_details.buyer_location", "buyer_city")),
    ("buyer_name", lambda v: _first_value(v, "$.buyer_details.buyer_name", "$.buyer_details.name")),
    ("buyer_number", lambda v: _first_value(v, "$.buyer_details.buyer_number", "$.buyer_details.buyer_phone", "$.buyer_Number")),
    ("seller_city", lambda v: _place(v, "$.seller_details.seller_location", "seller_city")),
    ("seller_name", lambda v: _first_value(v, "$.seller_details.seller_name", "$.seller_details.name")),
)


def details_problem(v: Column, text: Column) -> Column:
    """Why no details can be inferred: no text, unparsable, not an object, a party that is no object, or empty."""
    values = F.array(*[f(v) for _, f in _DETAILS])
    return (F.when(text.isNull(), F.lit("no call json")).when(v.isNull(), F.lit("unparsable"))
            .when(~_is("OBJECT", v), F.lit("not an object"))
            .when(~(_party_ok(v, "$.buyer_details") & _party_ok(v, "$.seller_details")), F.lit("party is not an object"))
            .when(F.forall(values, lambda x: x.isin(_FALSY)), F.lit("no value found")))


def inferred_details(v: Column, problem: Column) -> Column:
    """Buyer and seller name, city and number of a parsed call as a JSON object; NULL where there is a problem."""
    items = [F.concat(F.lit(f'"{k}": '), f(v)) for k, f in _DETAILS]
    return F.when(problem.isNull(), F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}")))


def compact_json(c) -> Column:
    """JVM-side semantic re-format (compact); text that is not JSON passes through."""
    v = F.try_parse_json(_c(c))
    return F.when(v.isNotNull(), F.to_json(v)).otherwise(_c(c))


def json_path(c, path: str, as_type: str = "string") -> Column:
    """Value at a JSON path, JVM-side (Variant); NULL when the text is not JSON or the path is absent."""
    return F.try_variant_get(F.try_parse_json(_c(c)), path, as_type)


# --- JVM-side builders ---------------------------------------------------------------
def json_string(c) -> Column:
    """A string as a JSON string literal (quotes and control characters escaped)."""
    t = F.to_json(F.array(_c(c).cast("string")))
    return t.substr(F.lit(2), F.length(t) - 2)


def _big_int(d: Column) -> Column:
    """Every digit of a whole double below 2^124 in size."""
    high = F.floor(F.abs(d) / F.lit(2.0 ** 62))
    low = F.floor(F.abs(d) - high.cast("double") * F.lit(2.0 ** 62))
    digits = (high.cast("decimal(38,0)") * F.lit(1 << 62).cast("decimal(19,0)")).cast("decimal(38,0)") + low.cast("decimal(19,0)")
    return F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), digits.cast("decimal(38,0)").cast("string"))


def python_float(d: Column) -> Column:
    """A double that is not whole, as Python prints it: plain from 1e-4 on, otherwise with a two-digit exponent."""
    java = d.cast("string")
    plain = F.regexp_replace(d.cast("string").cast("decimal(38,21)").cast("string"), "0+$", "")
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.lpad(F.substring_index(java, "E-", -1), 2, "0")
    return F.when(F.abs(d) >= 1e-4, plain).otherwise(F.concat(mantissa, F.lit("e-"), exponent))


def score_value(c) -> Column:
    """JSON text of a score: whole number -> int, other number -> float, else the string."""
    def typed(s: Column) -> Column:
        d = F.when(s.rlike(K.NUMBER_PATTERN), s.try_cast("double"))
        return (F.when(d.isNull() | (F.abs(d) >= F.lit(2.0 ** 124)), json_string(s))
                .when(d == F.rint(d), _big_int(d)).otherwise(python_float(d)))

    return F.transform(F.array(_c(c)), typed)[0]


def pretty_object(pairs) -> Column:
    """``json.dumps(dict, indent=2)`` of a flat dict whose values are already JSON text;
    a NULL value leaves its key out, an empty dict prints ``{}``."""
    items = [F.when(v.isNotNull(), F.concat(F.lit(f'  "{k}": '), v)) for k, v in pairs]
    body = F.concat_ws(",\n", *items)
    return F.when(body == "", F.lit("{}")).otherwise(F.concat(F.lit("{\n"), body, F.lit("\n}")))


def metadata_object(call_id) -> Column:
    return F.concat(F.lit('{"call_id": '), json_string(call_id), F.lit("}"))
