"""SURVEY 2.2.1: coercion edge cases, one assertion per rule."""

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurestats.functions.coerce import coerce, epoch_to_timestamp, parse_list
from featurestats.functions.types import source_type, stream_type


def _one(spark, expr_fn, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"s {dtype}")
    return [r[0] for r in df.select(expr_fn(F.col("s"))).collect()]


def test_double_rejects_nan_and_infinity(spark):
    out = _one(spark, lambda s: coerce(s, T.DoubleType()), ["6.55", "NaN", "Infinity", "-Infinity", "abc", None, "1e400"])
    assert out == [6.55, None, None, None, None, None, None]


def test_float_keeps_nan(spark):
    out = _one(spark, lambda s: coerce(s, T.FloatType()), ["NaN", "1.5"])
    assert math.isnan(out[0]) and out[1] == 1.5


def test_int_truncates_numbers_and_nulls_text(spark):
    out = _one(spark, lambda s: coerce(s, T.IntegerType()), ["3.7", "-3.7", "42", "abc", "true", "1e20"])
    assert out == [3, -3, 42, None, None, None]


def test_long_exact_beyond_2_pow_53(spark):
    out = _one(spark, lambda s: coerce(s, T.LongType()), ["9007199254740993", "12.9"])
    assert out == [9007199254740993, 12]


def test_boolean_only_true_text_is_true(spark):
    out = _one(spark, lambda s: coerce(s, T.BooleanType()), ["true", "TRUE", "1", "false", "abc", None])
    assert out == [True, True, False, False, False, None]


def test_epoch_threshold_is_strict(spark):
    out = _one(spark, lambda s: F.unix_millis(epoch_to_timestamp(s)),
               [1_000_000_000_000, 1_000_000_000_001, 1_774_597_200, 1_774_597_200_000], dtype="bigint")
    assert out == [1_000_000_000_000_000, 1_000_000_000_001, 1_774_597_200_000, 1_774_597_200_000]


def test_epoch_numeric_text(spark):
    out = _one(spark, lambda s: F.unix_millis(epoch_to_timestamp(s)), ["1774597200000", "1774597200", "x"])
    assert out == [1_774_597_200_000, 1_774_597_200_000, None]


def test_list_literals(spark):
    ints = _one(spark, lambda s: parse_list(s, T.IntegerType()), ["[1237, 5432]", "[1, None, 3]", "[]", "", "not a list", None])
    assert ints == [[1237, 5432], [1, 3], [], None, None, None]
    strs = _one(spark, lambda s: parse_list(s, T.StringType()), ["['a', None]", "['None of them', None]", "['x,y', 'z']"])
    assert strs == [["a"], ["None of them"], ["x,y", "z"]]


def test_type_maps():
    assert stream_type("Double") == T.DoubleType() and stream_type("long") == T.LongType()
    assert stream_type("List<String>") == T.StringType() and stream_type(None) == T.StringType()
    assert source_type("Nullable(Int64)") == T.LongType()
    assert source_type("LowCardinality(Nullable(String))") == T.StringType()
    assert source_type("FixedString(8)") == T.StringType()
    assert source_type("UInt8") == T.IntegerType() and source_type("UInt64") == T.LongType()
    assert source_type("Float32") == T.FloatType() and source_type("Bool") == T.BooleanType()
    assert source_type("Bool", bool_as_string=True) == T.StringType()
    assert source_type("Nullable(Array(String))") == T.ArrayType(T.StringType())
    assert source_type("Array(Int32)") == T.ArrayType(T.IntegerType())
    assert source_type("DateTime") == T.StringType() and source_type("Decimal(10, 2)") == T.StringType()


def test_parse_list_elements_and_blanks(spark):
    ints = _one(spark, lambda s: parse_list(s, T.IntegerType()), ["[1,        None]", "[1, 'x']", "['3', 4]"])
    assert ints == [[1], None, [3, 4]]
    strs = _one(spark, lambda s: parse_list(s, T.StringType()), ["['x, None, y']", "['a', None,    \"None\"]"])
    assert strs == [["x, None, y"], ["a", "None"]]
