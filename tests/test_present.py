"""Output normalisation of registered queries."""

import datetime as dt

from featurestats.present import present


def test_present_normalises_types(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), 1.234567, 7, ["a", None], True, "x")],
        "d date, t timestamp, x double, i int, a array<string>, b boolean, s string",
    )
    row = present(df).first()
    assert row.d == "2024-01-02" and row.t == "2024-01-02 03:04:05"
    assert row.x == 1.2346 and row.i == 7 and row.a == '["a",null]' and row.b is True and row.s == "x"
    types = {f.name: f.dataType.simpleString() for f in present(df).schema.fields}
    assert types == {"d": "string", "t": "string", "x": "double", "i": "bigint", "a": "string", "b": "boolean",
                     "s": "string"}
