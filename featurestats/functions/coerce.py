"""Set-wise coercion of text values to declared types.

Every rule is a built-in expression evaluated inside whole-stage codegen; a
value that does not convert becomes NULL and the row is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH_MS_THRESHOLD = 1_000_000_000_000  # strictly above → milliseconds, else seconds


def to_double(s: Column) -> Column:
    """Numeric text → DOUBLE; 'NaN' and ±Infinity become NULL."""
    v = s.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(v)


def to_float(s: Column) -> Column:
    """Numeric text → FLOAT; NaN is kept (no check for floats)."""
    return s.try_cast("float")


def to_int(s: Column) -> Column:
    """Numbers truncate toward zero (3.7 → 3); out of range or text → NULL."""
    return s.try_cast("double").try_cast("int")


def to_long(s: Column) -> Column:
    """Exact for integral text beyond 2^53; decimals truncate via DOUBLE."""
    return F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"))


def to_boolean(s: Column) -> Column:
    """Only 'true' (any case) is TRUE; every other non-null text — '1' too — is FALSE."""
    return F.when(s.isNull(), F.lit(None).cast("boolean")).otherwise(F.lower(s) == F.lit("true"))


def coerce(s: Column, dtype: T.DataType) -> Column:
    """Text → ``dtype`` with the rules above; STRING keeps the text (JSON text
    for maps and lists)."""
    if isinstance(dtype, T.DoubleType):
        return to_double(s)
    if isinstance(dtype, T.FloatType):
        return to_float(s)
    if isinstance(dtype, (T.IntegerType, T.ShortType, T.ByteType)):
        return to_int(s).cast(dtype)
    if isinstance(dtype, T.LongType):
        return to_long(s)
    if isinstance(dtype, T.BooleanType):
        return to_boolean(s)
    if isinstance(dtype, T.ArrayType):
        return parse_list(s, dtype.elementType)
    return s.cast("string")


def epoch_to_timestamp(v: Column) -> Column:
    """Epoch number (or numeric text) → TIMESTAMP: strictly above 10^12 means
    milliseconds, otherwise seconds (exactly 10^12 is seconds)."""
    x = v.cast("string").try_cast("double")
    ms = F.when(x > F.lit(EPOCH_MS_THRESHOLD), x).otherwise(x * 1000)
    return F.timestamp_millis(ms.try_cast("bigint"))


def int_array(a: Column) -> Column:
    """ARRAY<VARIANT> → ARRAY<INT>: numbers by value, texts parsed as integers; NULLs (and unparsable) dropped."""
    return F.filter(F.transform(a, lambda x: coerce_variant(x, T.IntegerType())), lambda x: x.isNotNull())


def bad_ints(a: Column) -> Column:
    """Whether an element that isn't null is no integer: a list, an object or a text such as 'x' or '3.7'."""
    bad = F.exists(a, lambda x: x.isNotNull() & ~F.is_variant_null(x) & coerce_variant(x, T.IntegerType()).isNull())
    return F.coalesce(bad, F.lit(False))


# Quoted spans, or what stands between them.
_SPANS = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++"""


def parse_list(s: Column, element: T.DataType) -> Column:
    """List-literal text (``[1, 2]``, ``['a', None]``) → typed array; empty,
    ``[]``-less or unparsable text → NULL, as is a list with an element of another type; NULL elements
    dropped (R13).  ``None`` is read as NULL outside quoted text only."""
    spans = F.regexp_extract_all(F.trim(s), F.lit(_SPANS), F.lit(0))
    norm = F.array_join(F.transform(spans, lambda x: F.when(x.substr(1, 1).isin("'", '"'), x).otherwise(
        F.regexp_replace(x, r"\bNone\b", "null"))), "")
    looks_like_list = norm.startswith("[") & norm.endswith("]")
    arr = F.from_json(norm, T.ArrayType(T.StringType()), {"allowSingleQuotes": "true"})
    if isinstance(element, T.StringType):
        return F.when(looks_like_list, F.filter(arr, lambda x: x.isNotNull()))
    typed = F.transform(F.filter(arr, lambda x: x.isNotNull()), lambda x: coerce(x, element))
    return F.when(looks_like_list & ~F.exists(typed, lambda x: x.isNull()), typed)


# ---- typed JSON values (VARIANT) ------------------------------------------------
# With the JSON type kept, one typed extraction per value reproduces the
# stream transform's conversions: a number converts by value (3.7 → 3 for an
# integer), a string is parsed with the target's text syntax (the string
# "3.7" is not an integer → NULL), and a boolean is TRUE only for JSON true or
# the text "true" (the number 1 → FALSE).  Known remaining differences: a
# JSON boolean read as a number gives 1/0 (the reference: NULL) and integer
# text with surrounding blanks parses (the reference: NULL).


def coerce_variant(v: Column, dtype: T.DataType) -> Column:
    """A JSON value (VARIANT) → ``dtype``; NULL when the value does not convert."""
    if isinstance(dtype, T.DoubleType):
        x = F.try_variant_get(v, "$", "double")
        return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)
    if isinstance(dtype, (T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.try_variant_get(v, "$", dtype.simpleString())
    text = F.try_variant_get(v, "$", "string")  # strings unquoted, other values as JSON text
    if isinstance(dtype, T.BooleanType):
        return F.when(text.isNotNull(), F.lower(text) == F.lit("true"))
    return text
