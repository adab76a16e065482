"""Reconciliation of two tables by a hash tree.

Both sides are summed once per (day, key bucket): a count and an order-free checksum of the compared values.  Only buckets
that differ are read again, row by row: their rows are matched by key and compared value by value.  A migration of which
a few rows went wrong costs one pass and a few buckets, not a join of two whole tables.

The checksum is a sum of 64-bit hashes as decimals, so that doubled rows do not cancel out as in an exclusive or.  Nulls
are hashed as such.  Values are compared after a cast to the source's types.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256


def row_hash(columns) -> F.Column:
    """Of the values and of which are null."""
    return F.xxhash64(*[x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


@dataclass
class Side:
    """A table to reconcile: its rows with ``_day``, ``_bucket`` and the key and value columns."""

    rows: DataFrame

    def sums(self, columns) -> DataFrame:
        return self.rows.groupBy("_day", "_bucket").agg(
            F.count(F.lit(1)).alias("n"), F.sum(row_hash(columns).cast("decimal(20,0)")).alias("checksum"))


def _side(df: DataFrame, day, keys, values, buckets: int, types: dict[str, str]) -> Side:
    named = [F.col(f"`{c}`").cast(types[c]).alias(c) for c in (*keys, *values)]
    rows = df.select(day.alias("_day"), *named)
    return Side(rows.withColumn("_bucket", F.pmod(row_hash(keys), F.lit(buckets)).cast("int")))


def bucket_sums(source: DataFrame, source_day, target: DataFrame, target_day, keys, values, buckets: int = BUCKETS) -> DataFrame:
    """(day, bucket, source_n, target_n, equal) of every bucket of either side."""
    a, b = _sides(source, source_day, target, target_day, keys, values, buckets)
    return _compare(a, b, [*keys, *values]).select(F.col("_day").alias("day"), F.col("_bucket").alias("bucket"), "source_n", "target_n", "equal")


def _sides(source, source_day, target, target_day, keys, values, buckets) -> tuple[Side, Side]:
    types = dict(source.dtypes)
    return _side(source, source_day, keys, values, buckets, types), _side(target, target_day, keys, values, buckets, types)


def _compare(a: Side, b: Side, columns) -> DataFrame:
    x = a.sums(columns).select("_day", "_bucket", F.col("n").alias("source_n"), F.col("checksum").alias("source_sum"))
    y = b.sums(columns).select(F.col("_day").alias("_d"), F.col("_bucket").alias("_b"), F.col("n").alias("target_n"), F.col("checksum").alias("target_sum"))
    both = x.join(y, x["_day"].eqNullSafe(y["_d"]) & (x["_bucket"] == y["_b"]), "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    same = (zero("source_n") == zero("target_n")) & F.col("source_sum").eqNullSafe(F.col("target_sum"))
    return both.select(
        F.when(F.col("_bucket").isNotNull(), F.col("_day")).otherwise(F.col("_d")).alias("_day"), F.coalesce("_bucket", "_b").alias("_bucket"),
        zero("source_n").alias("source_n"), zero("target_n").alias("target_n"), same.alias("equal"))


def reconcile_values(source: DataFrame, source_day, target: DataFrame, target_day, keys, values, buckets: int = BUCKETS) -> DataFrame:
    """One row for each (day, key) on which the sides differ: how often it stands on each side, ``status`` (``missing`` or
    ``extra`` in the target, ``count``: a different number of rows, ``value``) and the columns whose values differ.

    Rows that share a key are compared as a set.  A row whose day differs is missing on one day and extra on the other."""
    keys, values = list(keys), list(values)
    a, b = _sides(source, source_day, target, target_day, keys, values, buckets)
    # Written, as it decides what is read again; a row for each bucket that differs.
    differ = _compare(a, b, [*keys, *values]).where(~F.col("equal")).select(F.col("_day").alias("_d"), F.col("_bucket").alias("_b")).checkpoint()
    days = [r[0] for r in differ.select("_d").distinct().collect()]  # bounded by the tables' age
    on_days = F.col("_day").isin([d for d in days if d is not None]) | (F.col("_day").isNull() if None in days else F.lit(False))
    per_key = []
    for side, name in ((a, "source"), (b, "target")):
        held = side.rows.where(on_days)  # a partition column prunes the other days
        rows = held.join(differ, held["_day"].eqNullSafe(differ["_d"]) & (held["_bucket"] == differ["_b"]), "left_semi")
        sums = [F.sum(F.xxhash64(F.col(f"`{v}`"), F.col(f"`{v}`").isNull()).cast("decimal(20,0)")).alias(f"_{v}") for v in values]
        per_key.append(rows.groupBy("_day", *keys).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.struct(*sums).alias(f"{name}_sums"))
                       .withColumn("_key", F.to_json(F.struct("_day", *keys))))
    x, y = per_key
    y = y.select("_key", F.col("_day").alias("_td"), *[F.col(f"`{k}`").alias(f"_t_{k}") for k in keys], "target_n", "target_sums")
    both = x.join(y, "_key", "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"source_sums.`_{v}`").eqNullSafe(F.col(f"target_sums.`_{v}`")), F.lit(v)) for v in values]))
    here = F.col("source_n").isNotNull()
    status = (F.when(F.col("target_n").isNull(), "missing").when(~here, "extra").when(F.col("source_n") != F.col("target_n"), "count")
              .when(F.size(changed) > 0, "value"))
    out = both.select(
        F.when(here, F.col("_day")).otherwise(F.col("_td")).alias("day"),
        *[F.when(here, F.col(f"`{k}`")).otherwise(F.col(f"`_t_{k}`")).alias(k) for k in keys],
        F.coalesce("source_n", F.lit(0)).alias("source_n"), F.coalesce("target_n", F.lit(0)).alias("target_n"), status.alias("status"),
        F.when(status == "value", F.array_join(changed, ",")).alias("changed"))
    return out.where("status IS NOT NULL")
