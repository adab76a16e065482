"""Declared-type → Spark type maps.

Two type vocabularies exist: the stream's feature ``return_type`` strings and
the source warehouse's column type strings (``Nullable(Int64)`` ...).  Both are
parsed once on the driver into Spark ``DataType`` objects."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Stream return types that map to a native type; anything else is text.
STREAM_TYPES = {
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "integer": T.IntegerType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
}


def stream_type(return_type: str | None) -> T.DataType:
    """Double/double, Float, Integer/int, Long, Boolean → native; String, List<..>,
    Set<..>, Map, JSON types and NULL → STRING."""
    if return_type is None:
        return T.StringType()
    return STREAM_TYPES.get(return_type.strip().lower(), T.StringType())


# Source scalar types.
SOURCE_SCALARS = {
    "String": T.StringType(),
    "Int8": T.IntegerType(),
    "Int16": T.IntegerType(),
    "Int32": T.IntegerType(),
    "UInt8": T.IntegerType(),
    "UInt16": T.IntegerType(),
    "Int64": T.LongType(),
    "UInt32": T.LongType(),
    "UInt64": T.LongType(),
    "Float32": T.FloatType(),
    "Float64": T.DoubleType(),
    "Bool": T.BooleanType(),
}
_WRAPPERS = re.compile(r"^(Nullable|LowCardinality)\((.*)\)$")
_ARRAY = re.compile(r"^Array\((.*)\)$")
_FIXED = re.compile(r"^FixedString\(\d+\)$")


def source_type(decl: str, bool_as_string: bool = False) -> T.DataType:
    """Source column type string → Spark type.  Wrappers are unwrapped (every
    column is nullable anyway), arrays keep their element type, unknown types
    (Decimal, Date, DateTime, Map, Tuple, ...) fall back to STRING.  The
    column job has no Bool case (``bool_as_string``)."""
    t = decl.strip()
    while True:
        m = _WRAPPERS.match(t)
        if not m:
            break
        t = m.group(2).strip()
    m = _ARRAY.match(t)
    if m:
        return T.ArrayType(source_type(m.group(1), bool_as_string), True)
    if _FIXED.match(t):
        return T.StringType()
    if t == "Bool" and bool_as_string:
        return T.StringType()
    return SOURCE_SCALARS.get(t, T.StringType())
