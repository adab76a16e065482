"""Query-audit analytics (A1-A9) over the audit table and the execution log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import exact_percentiles, peak_running_sum, runs


def _resource_cols() -> list[F.Column]:
    return [
        F.col("queryTime").alias("wall_ms"),
        F.col("scanBytes").alias("scan_bytes"),
        F.col("scanRows").alias("scan_rows"),
        F.round(F.col("cpuCostNs") / 1e6, 2).alias("cpu_ms"),
        F.round(F.col("memCostBytes") / 1024 / 1024, 2).alias("mem_mb"),
        F.left(F.col("stmt"), F.lit(80)).alias("query"),
    ]


def _catalog_queries(audit: DataFrame, catalog: str) -> DataFrame:
    return audit.where((F.col("isQuery") == 1) & (F.col("catalog") == catalog))


def recent_queries(audit: DataFrame, catalog: str = "lake_catalog", n: int = 20) -> DataFrame:
    """A1: newest ``n`` queries on the catalog with resource use (top-k, ties by queryId)."""
    return (
        _catalog_queries(audit, catalog)
        .orderBy(F.desc("timestamp"), F.desc("queryId"))
        .limit(n)
        .select("queryId", F.date_format("timestamp", "HH:mm:ss").alias("time"), *_resource_cols())
    )


def top_cpu(audit: DataFrame, catalog: str = "lake_catalog", n: int = 10) -> DataFrame:
    """A2: top ``n`` queries by CPU cost."""
    return (
        _catalog_queries(audit, catalog)
        .orderBy(F.desc("cpuCostNs"), F.desc("queryId"))
        .limit(n)
        .select("queryId", *_resource_cols())
    )


def failed_queries(audit: DataFrame, n: int = 10) -> DataFrame:
    """A3: newest ``n`` queries whose state is not EOF."""
    return (
        audit.where(F.col("state") != "EOF")
        .orderBy(F.desc("timestamp"), F.desc("queryId"))
        .limit(n)
        .select("queryId", F.date_format("timestamp", "HH:mm:ss").alias("time"), "state", "errorCode",
                F.left(F.col("stmt"), F.lit(80)).alias("query"))
    )


def calibration(log: DataFrame, days: int = 30) -> DataFrame:
    """A4: per query type over the last ``days`` (relative to the newest log
    row): avg(peak memory / actual scan) and avg(actual scan / L2 estimate)."""
    newest = log.select(F.max("created_at")).scalar()
    recent = log.where(F.col("created_at") > newest - F.make_dt_interval(days=F.lit(days)))
    return recent.groupBy("query_type").agg(
        F.avg(F.try_divide(F.col("peak_memory_bytes").cast("double"), F.col("actual_scan_bytes"))).alias("memory_ratio"),
        F.avg(F.try_divide(F.col("actual_scan_bytes").cast("double"), F.col("l2_estimate_bytes"))).alias("compression_ratio"),
        F.count(F.lit(1)).alias("n"),
    )


def deviation_streaks(log: DataFrame, ratio: float = 3.0, min_runs: int = 5, by=("tenant",)) -> DataFrame:
    """A5: runs of ``min_runs``+ consecutive queries (per tenant, by time) whose
    L1 estimate is off by more than ``ratio`` x the actual scan.  Exact
    gaps-and-islands without gathering a tenant into one task."""
    dev = F.coalesce(
        F.abs(F.col("l1_estimate_bytes") - F.col("actual_scan_bytes")) / F.col("actual_scan_bytes") > F.lit(ratio),
        F.lit(False),
    )
    r = runs(log, list(by), ["created_at", "id"], dev, min_len=min_runs)
    return r.select(*by, F.col("run_start.created_at").alias("first_at"), F.col("run_start.id").alias("first_id"),
                    F.col("run_end.id").alias("last_id"), "run_len")


def retry_alerts(log: DataFrame, per_week: int = 2) -> DataFrame:
    """Retries per reason in tumbling 7-day windows above ``per_week``."""
    return (
        log.where(F.col("is_retry"))
        .groupBy(F.window("created_at", "7 days").alias("w"), "retry_reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > per_week)
        .select(F.col("w.start").alias("window_start"), "retry_reason", "n")
    )


def upgrade_alerts(log: DataFrame, per_day: int = 5, path: str = "ADHOC_HEAVY") -> DataFrame:
    """Adaptive upgrades (routes to the heavy path) per day above ``per_day``."""
    return (
        log.where(F.col("routing_path") == path)
        .groupBy(F.window("created_at", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > per_day)
        .select(F.col("w.start").alias("window_start"), "n")
    )


def estimate_join(audit: DataFrame, log: DataFrame) -> DataFrame:
    """Audit actuals beside the logged estimates (left join on query id)."""
    a = audit.select(F.col("queryId").alias("query_id"), "scanBytes", "cpuCostNs", "memCostBytes")
    return estimate_columns(a.join(log.select("query_id", "l1_estimate_bytes", "l2_estimate_bytes", "query_type"), "query_id", "left"))


def estimate_columns(joined: DataFrame) -> DataFrame:
    return joined.select(
        "query_id", "query_type", "scanBytes", "l1_estimate_bytes",
        F.try_divide(F.col("l1_estimate_bytes").cast("double"), F.col("scanBytes")).alias("l1_over_actual"),
    )


def peak_concurrency(log: DataFrame, by=("tenant",)) -> DataFrame:
    """The most queries that ran at one time, per group: +1 at a start, -1 at an end (ends first on ties; a query
    takes a millisecond at least)."""
    start = F.unix_millis("created_at")
    end = start + F.greatest(F.coalesce(F.col("actual_duration_ms"), F.lit(1)), F.lit(1))
    steps = log.select(*by, F.inline(F.array(F.struct(start.alias("at"), F.lit(1).alias("step")), F.struct(end.alias("at"), F.lit(-1).alias("step")))))
    return peak_running_sum(steps, by, ["at", "step"], "step").withColumnRenamed("peak", "peak_queries")


def tenant_graduation(log: DataFrame, events: DataFrame, rollups: DataFrame, max_events_per_s: float = 2000.0, max_queries: int = 15,
                      max_p99_ms: float = 3000.0, max_rollups: int = 50, heavy_scan_bytes: int = 50 * 10**9, heavy_share: float = 0.1) -> DataFrame:
    """Per-tenant signals against thresholds: event rate of the busiest minute (``events``: tenant, eventTime), queries
    at one time, exact p99 duration, number of rollups (``rollups``: tenant, rollup), and the share of queries
    that scan more than ``heavy_scan_bytes`` ("regularly": ``heavy_share`` of them).  A signal without data is NULL."""
    per = log.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg((F.col("actual_scan_bytes") > heavy_scan_bytes).cast("int")).alias("heavy_scan_share"),
    )
    minutes = events.groupBy("tenant", F.window("eventTime", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    signals = [
        minutes.groupBy("tenant").agg((F.max("n") / 60.0).alias("peak_events_per_s")),
        peak_concurrency(log),
        exact_percentiles(log, ["tenant"], "actual_duration_ms", {"p99_ms": 0.99}).drop("n"),
        rollups.groupBy("tenant").agg(F.count_distinct("rollup").alias("n_rollups")),
    ]
    for s in signals:  # one row per tenant each
        s = s.withColumnRenamed("tenant", "_t")
        per = per.join(s, per["tenant"].eqNullSafe(s["_t"]), "left").drop("_t")
    over = [F.col("peak_events_per_s") > max_events_per_s, F.col("peak_queries") > max_queries, F.col("p99_ms") > max_p99_ms,
            F.col("n_rollups") > max_rollups, F.col("heavy_scan_share") >= heavy_share]
    return per.select("*", F.exists(F.array(*[F.coalesce(o, F.lit(False)) for o in over]), lambda x: x).alias("graduate"))


def rollup_hit_rate(audit: DataFrame) -> DataFrame:
    """Share of queries per day answered from a rollup."""
    return audit.where(F.col("isQuery") == 1).groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.coalesce(F.col("hitMvs"), F.lit("")) != "").cast("int")).alias("hit_rate"),
        F.avg((F.coalesce(F.col("candidateMVs"), F.lit("")) != "").cast("int")).alias("candidate_rate"),
    )
