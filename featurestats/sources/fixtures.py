"""Inputs of the engine derived from the driver tables (FIXTURES.md part B).

Every rule is plain column arithmetic so that the DuckDB oracle can apply the
same rule (see ``featurestats.oracle``).  Nothing here is sampled or capped: the
derived tables grow with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the fixture rules (FIXTURES.md B).
COUNTRIES = ["US", "CN", "NA", "DE"]  # indexed by user_id % 4
BLOCK_EVERY = 7  # actions = ['block'] when event_id % 7 = 0
MISSING_EVERY, MISSING_AT = 10, 3  # value NULL when event_id % 10 = 3
DUP_EVERY = 50  # event_id % 50 = 0 rows get a second, later version
SECONDS_EVERY = 3  # A1 messages carry `time` in seconds when event_id % 3 = 0

# Feature / attribute ids used in the raw messages.
FEATURE_IDS = {"txn_amount": 8, "country": 7, "score": 15}
UNKNOWN_FEATURE_ID = 99
ATTRIBUTE_IDS = {"account_id": 4, "txn_ref": 18}


def country_col(user_id: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), (user_id % 4 + 1).cast("int"))


def processing_time_col(event_id: F.Column, ts: F.Column) -> F.Column:
    hours = (event_id * 7) % 37 - 1
    return ts + F.make_dt_interval(hours=hours.cast("int"))


def event_table(spark: SparkSession, sf_dir: str, with_duplicates: bool = False) -> DataFrame:
    """The wide ``event_result`` table (fixed columns + typed features).

    With ``with_duplicates`` the rows with ``event_id % 50 = 0`` appear twice; the
    second version has ``value + 1`` and a processing time one hour later, as an
    at-least-once source or a replacing table would deliver them.
    """
    ev = read_table(spark, sf_dir, "events")
    base = ev.select(
        F.col("event_id"),
        F.col("ts"),
        F.col("user_id"),
        F.col("event_type"),
        F.when(F.col("event_id") % MISSING_EVERY == MISSING_AT, F.lit(None).cast("double"))
        .otherwise(F.col("value"))
        .alias("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.lit(0).alias("version"),
    )
    if with_duplicates:
        dup = base.where(F.col("event_id") % DUP_EVERY == 0).withColumn("value", F.col("value") + 1).withColumn(
            "version", F.lit(1)
        )
        base = base.unionByName(dup)
    return base.select(
        F.col("event_id").cast("string").alias("eventId"),
        F.col("event_type").alias("eventType"),
        F.col("user_id").cast("string").alias("userId"),
        F.col("ts").alias("eventTime"),
        (processing_time_col(F.col("event_id"), F.col("ts")) + F.make_dt_interval(hours=F.col("version"))).alias(
            "processingTime"
        ),
        F.array((F.col("event_id") % 13).cast("int")).alias("rules"),
        F.when(F.col("event_id") % BLOCK_EVERY == 0, F.array(F.lit("block")))
        .otherwise(F.array(F.lit("pass")))
        .alias("actions"),
        F.array().cast("array<int>").alias("trialRules"),
        F.array().cast("array<string>").alias("trialActions"),
        F.lit(None).cast("string").alias("reEvaluateEntity"),
        F.lit(None).cast("int").alias("originId"),
        F.lit(None).cast("string").alias("originCategory"),
        (F.col("event_id") % 11 == 0).alias("fromUpdateAPI"),
        F.col("value").alias("txn_amount"),
        country_col(F.col("user_id")).alias("country"),
        F.col("k").alias("score"),
    )
