"""Table profiles and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _hours(later: str, earlier: str) -> F.Column:
    return (F.unix_micros(F.col(later)) - F.unix_micros(F.col(earlier))) / 3.6e9


def arrival_gap_profile(df: DataFrame, event_col: str = "eventTime", proc_col: str = "processingTime") -> DataFrame:
    """Average / max / min of (processing - event) in hours."""
    gap = _hours(proc_col, event_col)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(gap).alias("avg_gap_h"),
        F.max(gap).alias("max_gap_h"),
        F.min(gap).alias("min_gap_h"),
        F.count_if(gap < 0).alias("n_negative"),
    )


def hourly_profile(df: DataFrame, col: str = "eventTime") -> DataFrame:
    """T4: rows per hour of day, with the peak hour flagged (24 rows)."""
    per_hour = df.groupBy(F.hour(F.col(col)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # 24-row table
    return per_hour.select("hour", "n", (F.col("n") == F.max("n").over(w)).alias("is_peak"))


def partition_profile(df: DataFrame, col: str = "processingTime", fmt: str = "yyyy-MM-dd") -> DataFrame:
    """T5: rows per day (or month with ``fmt='yyyyMM'``) partition."""
    return df.groupBy(F.date_format(F.col(col), fmt).alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def reconcile_counts(src: DataFrame, src_day: F.Column, tgt: DataFrame, tgt_day: F.Column) -> DataFrame:
    """Per-day source vs target counts (one union of two small
    per-day tables), with the difference and a match flag."""
    a = src.groupBy(src_day.alias("day")).agg(F.count(F.lit(1)).alias("source_rows"))
    b = tgt.groupBy(tgt_day.alias("day")).agg(F.count(F.lit(1)).alias("target_rows"))
    both = a.withColumn("target_rows", F.lit(0)).unionByName(b.withColumn("source_rows", F.lit(0)))
    j = both.groupBy("day").agg(F.sum("source_rows").alias("source_rows"), F.sum("target_rows").alias("target_rows"))
    s, t = F.col("source_rows"), F.col("target_rows")  # rows without a day are a group too
    return j.select("day", s.alias("source_rows"), t.alias("target_rows"), (t - s).alias("diff"), (s == t).alias("match"))


def reconcile_keys(src: DataFrame, tgt: DataFrame, keys) -> DataFrame:
    """T6 at key level: keys only in the source / only in the target."""
    both = src.select(*keys, F.lit(1).alias("_side")).unionByName(tgt.select(*keys, F.lit(2).alias("_side")))
    seen = both.groupBy(*keys).agg(F.bit_or("_side").alias("_side")).where("_side < 3")  # NULL keys match NULL keys
    return seen.select(F.when(F.col("_side") == 1, "source_only").otherwise("target_only").alias("side"), *keys)


def column_drift(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Per column name: presence and type on each side and the fill rate
    (non-null share) of each side — one aggregation pass per side."""
    spark = src.sparkSession

    def fill(df: DataFrame) -> dict:
        if not df.columns:
            return {}
        aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]
        row = df.agg(*aggs).first().asDict()  # one row
        n = row.pop("__n") or 0
        return {c: (v / n if n else None) for c, v in row.items()}

    st = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    tt = {f.name: f.dataType.simpleString() for f in tgt.schema.fields}
    sf, tf = fill(src), fill(tgt)
    rows = []
    for c in sorted(set(st) | set(tt)):
        status = (
            "missing_in_target" if c not in tt else "missing_in_source" if c not in st
            else "type_differs" if st[c] != tt[c] else "same"
        )
        rows.append((c, st.get(c), tt.get(c), sf.get(c), tf.get(c), status))
    return spark.createDataFrame(
        rows, "column string, source_type string, target_type string, source_fill double, target_fill double, status string"
    )


def file_profile(df: DataFrame) -> DataFrame:
    """File count, average file size and rows per file of a file-based table."""
    per_file = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes")
    )
    return per_file.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("rows").alias("n_rows"),
        F.avg("bytes").alias("avg_file_bytes"),
        F.avg("rows").alias("avg_rows_per_file"),
    )


def non_empty(df: DataFrame) -> DataFrame:
    """End-to-end check after a refresh: ``count > 0``."""
    return df.agg(F.count(F.lit(1)).alias("n")).select("n", (F.col("n") > 0).alias("ok"))
