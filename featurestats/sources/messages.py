"""Raw event messages and resolver metadata (FIXTURES A1/A2), derived from
the driver's ``events`` table.

Each event becomes one JSON object with integer-keyed ``featureMap`` and
``eventFields``; a fixed share of extra edge lines (not JSON, arrays, bare
scalars, tombstones, wrong field types) is added by rule on ``event_id``, so
the message volume grows with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import BLOCK_EVERY, MISSING_AT, MISSING_EVERY, SECONDS_EVERY, country_col, processing_time_col
from .tables import read_table

# Resolver metadata of the fixture (id, name, return_type, status).
FEATURES = [
    (7, "country", "String", "PUBLISHED"),
    (8, "txn_amount", "Double", "PUBLISHED"),
    (15, "score", "Integer", "PUBLISHED"),
    (16, "score_big", "Long", "PUBLISHED"),
    (17, "amount_f", "Float", "PUBLISHED"),
    (21, "is_even", "Boolean", "PUBLISHED"),
    (22, "tags", "List<String>", "PUBLISHED"),
    (23, "legacy_note", None, "PUBLISHED"),
    (30, "draft_score", "Integer", "DRAFT"),
    (31, "account_id", "Long", "PUBLISHED"),
    (40, "eventType", "String", "PUBLISHED"),
]
# Event attribute metadata (id, name, type).
ATTRIBUTES = [
    (4, "account_id", "String"),
    (18, "txn_ref", "Long"),
]


def feature_meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEATURES, "id int, name string, return_type string, status string")


def attribute_meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ATTRIBUTES, "id int, name string, type string")


def _kv(key: str, json_value: F.Column) -> F.Column:
    """'"key":<json_value>' or NULL when the value is NULL (concat_ws skips it)."""
    return F.concat(F.lit(f'"{key}":'), json_value)


def _q(c: F.Column) -> F.Column:
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``value STRING`` column: a JSON message per event plus edge lines."""
    ev = read_table(spark, sf_dir, "events")
    eid, ts, k = F.col("event_id"), F.col("ts"), F.get_json_object("props", "$.k").cast("int")
    value = F.when(eid % MISSING_EVERY == MISSING_AT, F.lit(None).cast("double")).otherwise(F.col("value"))
    mod100 = eid % 100
    feature_map = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            _kv("8", F.when(mod100 == 11, F.lit('"NaN"')).otherwise(value.cast("string"))),
            _kv("7", _q(country_col(F.col("user_id")))),
            _kv("15", F.when(mod100 == 12, F.lit('"abc"')).otherwise(k.cast("string"))),
            _kv("16", (k.cast("bigint") * 1_000_000_000).cast("string")),
            _kv("17", F.when(mod100 == 14, F.lit('"NaN"')).otherwise(value.cast("string"))),
            _kv("21", F.when(mod100 == 12, F.lit("1")).otherwise(F.when(eid % 2 == 0, "true").otherwise("false"))),
            _kv("22", F.concat(F.lit('["'), F.col("event_type"), F.lit('",null]'))),
            _kv("23", _q(F.col("event_type"))),
            _kv("30", k.cast("string")),
            _kv("31", k.cast("string")),
            _kv("40", F.lit('"override"')),
            _kv("99", F.lit('"x"')),
        ),
        F.lit("}"),
    )
    event_fields = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            _kv("4", F.when(eid % 4 != 0, _q(F.col("user_id")))),
            _kv("18", eid.cast("string")),
        ),
        F.lit("}"),
    )
    epoch = F.when(eid % SECONDS_EVERY == 0, F.unix_seconds(ts)).otherwise(F.unix_millis(ts))
    action = F.when(eid % BLOCK_EVERY == 0, F.lit("block")).otherwise(F.lit("pass"))
    message = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            _kv("eventId", _q(eid)),
            _kv("eventType", _q(F.col("event_type"))),
            _kv("userId", F.col("user_id").cast("string")),
            _kv("time", epoch.cast("string")),
            _kv("processTime", F.unix_millis(processing_time_col(eid, ts)).cast("string")),
            _kv("rules", F.concat(F.lit("["), (eid % 13).cast("string"), F.lit(',null,"'), (eid % 5).cast("string"), F.lit('"]'))),
            _kv("actions", F.concat(F.lit('["'), action, F.lit('",null]'))),
            _kv("trialRules", F.lit("[]")),
            _kv("fromUpdateAPI", F.when(eid % 11 == 0, "true").otherwise("false")),
            _kv("originId", F.when(eid % 2 == 0, (eid % 1000).cast("string"))),
            _kv("featureMap", feature_map),
            _kv("eventFields", event_fields),
        ),
        F.lit("}"),
    )
    good = ev.select(message.alias("value"))
    m1000 = eid % 1000
    edge = ev.where(m1000.between(1, 5)).select(
        F.when(m1000 == 1, F.concat(F.lit("not json "), eid.cast("string")))
        .when(m1000 == 2, F.concat(F.lit("["), eid.cast("string"), F.lit("]")))
        .when(m1000 == 3, eid.cast("string"))
        .when(m1000 == 5, F.concat(F.lit('{"eventId":"x'), eid.cast("string"), F.lit('","rules":"nope"}')))
        .alias("value")  # m1000 == 4 → NULL value: a tombstone
    )
    return good.unionByName(edge)
