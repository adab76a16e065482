"""Query audit (A7) and query-execution log (A8) tables, one row per order.

Values are modulo rules on ``o_orderkey`` (FIXTURES B); timestamps are the
order date plus ``o_orderkey % 86400`` seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def _pick(k: F.Column, values) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _stamp(o: DataFrame) -> F.Column:
    return F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("int"))


def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    state = F.when(k % 23 == 0, "ERR").when(k % 31 == 0, "TIMEOUT").otherwise("EOF")
    return o.select(
        F.concat(F.lit("q"), k.cast("string")).alias("queryId"),
        _stamp(o).alias("timestamp"),
        _pick(k, ["select", "insert", "refresh"]).alias("queryType"),
        F.concat(F.lit("10.0.0."), (k % 250).cast("string")).alias("clientIp"),
        F.concat(F.lit("user_"), (F.col("o_custkey") % 10).cast("string")).alias("user"),
        F.concat(F.lit("user_"), (F.col("o_custkey") % 10).cast("string")).alias("authorizedUser"),
        F.lit("default_wg").alias("resourceGroup"),
        F.when(k % 4 == 0, "default_catalog").otherwise("lake_catalog").alias("catalog"),
        F.lit("tenant_db").alias("db"),
        state.alias("state"),
        F.when(state != "EOF", F.concat(F.lit("E"), (k % 5).cast("string"))).otherwise("").alias("errorCode"),
        ((k * 37) % 5000).alias("queryTime"),
        (F.col("o_totalprice") * 1000).cast("bigint").alias("scanBytes"),
        (k % 100000).alias("scanRows"),
        (k % 100).alias("returnRows"),
        ((k * 7919) % 1_000_000_000).alias("cpuCostNs"),
        ((k * 104729) % 4_294_967_296).alias("memCostBytes"),
        (k % 1000).cast("int").alias("stmtId"),
        F.when(k % 5 == 0, 0).otherwise(1).cast("tinyint").alias("isQuery"),
        F.lit("10.0.1.1").alias("feIp"),
        F.concat(
            F.lit("SELECT eventType, count(*) FROM event_result WHERE priority = '"), F.col("o_orderpriority"),
            F.lit("' AND amount > "), F.col("o_totalprice").cast("string"), F.lit(" GROUP BY eventType /* "),
            F.col("o_custkey").cast("string"), F.lit(" */"),
        ).alias("stmt"),
        F.sha2(F.col("o_orderpriority"), 256).alias("digest"),
        ((k % 97) * 1.5).alias("planCpuCosts"),
        ((k % 89) * 2.5).alias("planMemCosts"),
        (k % 300).alias("pendingTimeMs"),
        F.when(k % 2 == 0, "mv_action_daily").otherwise("").alias("candidateMVs"),
        F.when(k % 3 == 0, "mv_action_daily").otherwise("").alias("hitMvs"),
        F.lit("default_warehouse").alias("warehouse"),
    )


def execution_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    actual = (F.col("o_totalprice") * 1000).cast("bigint") + 1
    # estimates are 5x off for runs of consecutive order keys (k / 8 % 3 = 0), else 1.5x
    factor = F.when(F.floor(k / 8) % 3 == 0, F.lit(5.0)).otherwise(F.lit(1.5))
    retry = k % 13 == 0
    return o.select(
        k.alias("id"),
        F.concat(F.lit("q"), k.cast("string")).alias("query_id"),
        (k % 100).cast("int").alias("task_id"),
        F.concat(F.lit("tenant_"), (F.col("o_custkey") % 7).cast("string")).alias("tenant"),
        _pick(k, ["DAILY_MV_REFRESH", "DAILY_WINDOW_MERGE", "ADHOC_QUERY"]).alias("query_type"),
        _pick(k, ["DAILY_WH", "ADHOC_WH", "DAILY_HEAVY", "ADHOC_HEAVY"]).alias("routing_path"),
        F.lit("wh_main").alias("warehouse_name"),
        (actual * factor).cast("bigint").alias("l1_estimate_bytes"),
        (actual * 2).alias("l2_estimate_bytes"),
        (k % 4).cast("int").alias("cn_count"),
        actual.alias("actual_scan_bytes"),
        ((k * 13) % 60000).alias("actual_duration_ms"),
        (actual * (k % 4 + 1)).alias("peak_memory_bytes"),
        retry.alias("is_retry"),
        F.when(retry, _pick(k, ["SPOT_RECLAIMED", "OOM", "TIMEOUT"])).alias("retry_reason"),
        _stamp(o).alias("created_at"),
    )
