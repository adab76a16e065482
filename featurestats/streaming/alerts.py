"""Audit analytics on streams: frequency alerts (A6) and actuals beside estimates.

Alerts: each log row counts in the windows of the alerts it may raise.  Counts are kept per (alert, detail, window) as
state, updated with every micro-batch and dropped once the watermark has passed the window.  Rows that come after that
are late: they change no alert, and are counted apart.  A hot window is dealt over ``SALTS`` parts, whose counts the
reader adds up.  The parts of all windows are dealt over ``BUCKETS`` state groups, so that the number of groups, each of
which costs a call of Python, doesn't grow with the windows.  Rows without a time are in no window.

Estimates: an interval join of the two streams with watermarks on both sides; an audit row without an estimate comes out,
with NULLs, once no estimate can come any more.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.audit import estimate_columns

WEEK, DAY = 7 * 86_400_000, 86_400_000
SALTS = 16
BUCKETS = 256
GROUP = ("alert", "detail", "window_ms", "end_ms", "salt")
END = GROUP.index("end_ms")
ARRIVED = "_arrived"
COUNTS = "alert string, detail string, window_ms bigint, salt int, n bigint, late bigint"


def alert_rows(log: DataFrame, path: str = "ADHOC_HEAVY") -> DataFrame:
    """(alert, detail, window_ms, end_ms, salt): the windows that each log row counts in."""
    at = F.unix_millis("created_at")
    start = lambda length: at - F.pmod(at, F.lit(length))  # noqa: E731  tumbling from 1970-01-01, as F.window
    kind = lambda name, detail, length: F.struct(
        F.lit(name).alias("alert"), detail.alias("detail"), start(length).alias("window_ms"), (start(length) + length).alias("end_ms"))
    retry = F.when(F.col("is_retry"), kind("retry", F.col("retry_reason"), WEEK))
    upgrade = F.when(F.col("routing_path") == path, kind("upgrade", F.lit(path), DAY))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    return log.where("created_at IS NOT NULL").select(*[c for c in log.columns if c == ARRIVED], salt, F.inline(F.array_compact(F.array(retry, upgrade))))


def _count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts of a bucket's windows.  Its state holds those that are open, as JSON rows of GROUP and n."""
    closed = state.getCurrentWatermarkMs()
    held = {tuple(row[:-1]): row[-1] for row in json.loads(state.get[0])} if state.exists else {}
    new = Counter()
    if not state.hasTimedOut:
        for p in parts:
            new.update(zip(*(p[c].tolist() for c in GROUP)))
    out = []
    for group, n in new.items():
        if group[END] <= closed:
            out.append((*group, held.get(group, 0), n))
        else:
            held[group] = held.get(group, 0) + n
            out.append((*group, held[group], 0))
    held = {group: n for group, n in held.items() if group[END] > closed}
    if held:
        state.update((json.dumps([[*group, n] for group, n in held.items()]),))
        state.setTimeoutTimestamp(min(group[END] for group in held))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=[*GROUP, "n", "late"]).drop(columns="end_ms")


def start_alerts(log: DataFrame, path: str, checkpoint: str, delay: str = "1 day", trigger: dict | None = None):
    """Count a stream of log rows into ``path``.  A batch's counts go to a folder of its own, so a replay replaces them."""
    # Late rows must reach the state function, which counts them.  So the column whose old rows Spark drops is the time of
    # arrival, which never lags; the watermark, the lesser of both, is still that of the rows' own time.
    rows = alert_rows(log.withWatermark("created_at", delay).withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, "0 seconds"))
    bucket = F.pmod(F.xxhash64(*GROUP), F.lit(BUCKETS)).cast("int")
    counts = rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        _count, COUNTS, "held string", "update", GroupStateTimeout.EventTimeTimeout)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    # Two watermarks in one branch are refused where several stateful operators may follow each other; here is one.
    spark, key = log.sparkSession, "spark.sql.streaming.statefulOperator.allowMultiple"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()
    finally:
        spark.conf.set(key, before)


def read_alerts(spark: SparkSession, path: str, per_week: int = 2, per_day: int = 5) -> DataFrame:
    """(alert, window_start, detail, n) above the thresholds, as of the last batch."""
    counts = spark.read.schema(COUNTS + ", batch int").parquet(path)
    last = counts.groupBy("alert", "detail", "window_ms", "salt").agg(F.max("n").alias("n"))  # counts only grow
    total = last.groupBy("alert", "detail", "window_ms").agg(F.sum("n").alias("n"))
    over = F.when(F.col("alert") == "retry", F.col("n") > per_week).otherwise(F.col("n") > per_day)
    return total.where(over).select("alert", F.timestamp_millis("window_ms").alias("window_start"), "detail", "n")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """(alert, n_late): rows that came after their window was closed."""
    return spark.read.schema(COUNTS + ", batch int").parquet(path).groupBy("alert").agg(F.sum("late").alias("n_late")).where("n_late > 0")


def join_estimates(audit: DataFrame, log: DataFrame, within: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """A7 on streams: audit rows and the estimates logged within an interval of them, by query id (left outer)."""
    a = audit.withWatermark("timestamp", delay).select(F.col("queryId").alias("query_id"), "timestamp", "scanBytes")
    e = log.withWatermark("created_at", delay).select(
        F.col("query_id").alias("_id"), "created_at", "l1_estimate_bytes", "query_type")
    near = F.expr(f"created_at BETWEEN timestamp - INTERVAL {within} AND timestamp + INTERVAL {within}")
    return estimate_columns(a.join(e, (a["query_id"] == e["_id"]) & near, "left_outer"))


def start_estimates(audit: DataFrame, log: DataFrame, path: str, checkpoint: str, within: str = "1 hour", delay: str = "1 hour", trigger: dict | None = None):
    """Append the joined rows to ``path``; an audit row without estimate is written when its interval has closed."""
    writer = join_estimates(audit, log, within, delay).writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()
