"""Resolver metadata from the metadata database (production path).

Published features and event attributes are two small tables; a JDBC read
is all it takes.  The driver jar is not in this container, so this adapter
is untested here; tests pass metadata DataFrames directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def metadata_from_jdbc(
    spark: SparkSession, url: str, properties: dict, feature_table: str = "feature",
    attribute_table: str = "event_attribute_info",
) -> tuple[DataFrame, DataFrame]:
    features = spark.read.jdbc(
        url, f"(SELECT id, name, return_type, status FROM {feature_table} WHERE status = 'PUBLISHED') f",
        properties=properties,
    )
    attributes = spark.read.jdbc(url, f"(SELECT id, name, type FROM {attribute_table}) a", properties=properties)
    return features, attributes
