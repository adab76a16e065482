"""Exact distinct counts that merge over days (M8): bitmaps over dictionary codes.

A dictionary kept across days gives each value of a feature a dense number.  A day's state of a segment is the bitmap of
the numbers that occur, cut into buckets of 32,768 bits (4 kB); the distinct values of any window are the bits of the days'
bitmaps or-ed together.  Unlike a sketch this is exact, and unlike a distinct over raw rows it reads states alone.

New values are numbered without a window over all of them: they are written in order, and a row's number is its place in its
file plus the rows of the files before it.  Values are compared as text, as the distinct measure does; NULL is no value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.arrivals import ArrivalIndex, date_in_days
from ..session import hadoop_path, path_exists, work_path
from .cube import Cube
from .rollup import time_in_days

CODES = "feature string, value string, code bigint"


@dataclass
class Dictionary:
    """(feature, value, code): codes of a feature are dense from 0 and never change.  One writer at a time."""

    spark: SparkSession
    path: str

    def read(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], CODES)
        return self.spark.read.schema(CODES).parquet(self.path)

    def learn(self, values: DataFrame) -> DataFrame:
        """Give new (feature, value) pairs their codes; returns the whole dictionary."""
        known = self.read()
        new = values.where("value IS NOT NULL").distinct().join(known, ["feature", "value"], "left_anti")
        staged = work_path(self.spark, "new_values")
        new.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value").write.parquet(staged)
        rows = self.spark.read.schema("feature string, value string").parquet(staged).select(
            "feature", "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        # One row for each file and feature in it; features are few.
        runs = rows.groupBy("_file", "feature").agg(F.min("value").alias("_low"), F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("feature").orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
        base = known.groupBy("feature").agg((F.max("code") + 1).alias("_base"))
        runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(base, "feature", "left")
        code = F.coalesce("_base", F.lit(0)) + F.col("_before") + F.col("_row") - F.col("_first")
        coded = rows.join(runs.select("_file", "feature", "_base", "_before", "_first"), ["_file", "feature"]).select("feature", "value", code.alias("code"))
        coded.write.mode("append").partitionBy("feature").parquet(self.path)
        return self.read()


@dataclass
class BitmapRollup:
    """Daily distinct states of a cube's features: (tenant, stat_date, segment_value, feature, bucket, bits), by day."""

    spark: SparkSession
    cube: Cube
    path: str

    @property
    def dictionary(self) -> Dictionary:
        return Dictionary(self.spark, self.path.rstrip("/") + "__codes")

    def refresh(self, fact: DataFrame, days, arrivals: ArrivalIndex | None = None) -> None:
        """Recompute the states of these event days; idempotent."""
        days = sorted(set(days))
        if not days:
            return
        rows = fact.where(time_in_days(self.cube.time_col, days))
        if arrivals is not None and "processing_day" in fact.columns:
            rows = rows.where(arrivals.holds(days))
        items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in self.cube.features])
        # A value counts once for each day and segment, so a hot one collapses before it is joined.
        seen = rows.select(F.to_date(self.cube.time_col).alias("stat_date"), self.cube.dimension.segment().alias("segment_value"), F.inline(items))
        seen = seen.where("value IS NOT NULL").distinct()
        staged = work_path(self.spark, "seen_values")
        seen.write.parquet(staged)
        seen = self.spark.read.schema(seen.schema).parquet(staged)
        coded = seen.join(self.dictionary.learn(seen.select("feature", "value")), ["feature", "value"])
        states = coded.groupBy("stat_date", "segment_value", "feature", F.bitmap_bucket_number("code").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"))
        (states.withColumn("tenant", F.lit(self.cube.tenant)).hint("rebalance", "tenant", "stat_date").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("tenant", "stat_date").parquet(self.path))
        held = {r[0] for r in seen.select("stat_date").distinct().collect()}
        for day in set(days) - held:  # a day without values has no state left
            fs, target = hadoop_path(self.spark, f"{self.path.rstrip('/')}/tenant={self.cube.tenant}/stat_date={day}")
            fs.delete(target, True)

    def states(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def distinct(self, days) -> DataFrame:
        """(feature, segment_value, distinct_count) over the days, exactly, from states alone."""
        mine = self.states().where((F.col("tenant") == F.lit(self.cube.tenant)) & date_in_days("stat_date", days))
        merged = mine.groupBy("feature", "segment_value", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return merged.groupBy("feature", "segment_value").agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("distinct_count"))
