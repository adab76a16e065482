"""Deduplication.

Keep-last by key is a ``groupBy(keys).agg(max_by(struct(rest), struct(version)))``
with map-side partial aggregation, so a key that holds a third of the table
collapses inside each map task before the shuffle.  Spark runs it as a sort
aggregate, as the buffer holds a struct with text.  The version must be a total
order: pass a tie-breaker (file name, row hash) as the last version column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import work_path


def keep_last(df: DataFrame, keys, version_cols) -> DataFrame:
    """One row per key: the row with the greatest ``struct(version_cols)``."""
    keys, version_cols = list(keys), list(version_cols)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    packed = F.struct(*[F.col(f"`{c}`") for c in rest])
    order = F.struct(*[F.col(f"`{c}`") for c in version_cols])
    return (
        df.groupBy(*[F.col(f"`{k}`") for k in keys])
        .agg(F.max_by(packed, order).alias("_row"))
        .select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"_row.`{c}`").alias(c) for c in rest])
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )


def keep_last_two_phase(df: DataFrame, keys, version_cols) -> DataFrame:
    """Variant for very wide rows: find the winning (key, version) on the narrow
    projection first, then join the wide rows to it.  Of rows that share key and
    version the greatest stays (``row_order``), so there is one row per key."""
    keys, version_cols = list(keys), list(version_cols)
    return join_winners(df, winners_of(df, keys, version_cols), keys, version_cols)


def winners_of(versions: DataFrame, keys, version_cols) -> DataFrame:
    """(_k_<key>, _v_<version>, _n) of the last version of each key; _n rows share it."""
    keys, version_cols = list(keys), list(version_cols)
    counted = versions.select(*keys, *version_cols).groupBy(*keys, *version_cols).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.max(F.struct(*version_cols, "_n")).alias("_v")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(f"_v.{c}").alias(f"_v_{c}") for c in version_cols], F.col("_v._n").alias("_n"))


def join_winners(df: DataFrame, winners: DataFrame, keys, version_cols) -> DataFrame:
    """The wide rows of the winners.  These, narrow, are written first, which tells whether any are tied: only then is there
    a second join, of the tied rows alone."""
    spark, seen = df.sparkSession, Observation()
    path = work_path(spark, "winners")
    winners.observe(seen, F.coalesce(F.max("_n"), F.lit(0)).alias("most")).write.parquet(path)
    winners = spark.read.schema(winners.schema).parquet(path)
    cond = [df[k].eqNullSafe(winners[f"_k_{k}"]) for k in keys] + [df[c].eqNullSafe(winners[f"_v_{c}"]) for c in version_cols]
    wide = [df[c] for c in df.columns]
    if seen.get["most"] < 2:
        return df.join(winners, cond).select(*wide)
    tied = df.join(winners.where("_n > 1"), cond).select(*wide)
    tied = keep_last(tied.withColumn("_row", row_order(tied)), keys, ["_row"]).drop("_row")
    return df.join(winners.where("_n = 1"), cond).select(*wide).unionByName(tied)


def row_order(df: DataFrame) -> F.Column:
    """A total order of rows that differ at all, for ties of keys and versions: column by column in the order of their
    names, NULL first.  (Maps and variants, which have no order, go by their JSON.)"""
    ordered = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        ordered.append((F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c).alias(f.name))
    return F.struct(*ordered)


def duplicate_profile(df: DataFrame, keys) -> DataFrame:
    """Total rows, unique keys, duplicate rows (total - unique).

    The distinct count is a two-level aggregation (group by key, then count),
    which Spark partial-aggregates at both levels."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.sum("_n").cast("bigint").alias("total_rows"),
        F.count(F.lit(1)).alias("unique_keys"),
    ).select("total_rows", "unique_keys", (F.col("total_rows") - F.col("unique_keys")).alias("duplicates"))
