"""Audit analytics and profiles on hand-written rows."""

import datetime as dt
import random

from featurestats.operators.audit import deviation_streaks, failed_queries, peak_concurrency, retry_alerts, tenant_graduation, top_cpu
from featurestats.operators.profile import arrival_gap_profile, column_drift, hourly_profile, reconcile_counts
from featurestats.operators.prune import event_partition_values, with_event_partition_bounds

from pyspark.sql import functions as F

T0 = dt.datetime(2024, 3, 1)


def _log(spark, devs, tenant="t1", start=0):
    rows = []
    for i, dev in enumerate(devs):
        actual = 100
        rows.append((start + i, tenant, T0 + dt.timedelta(minutes=start + i), actual * (5 if dev else 1), actual,
                     (i * 37) % 1000, i % 13 == 0, "OOM" if i % 13 == 0 else None))
    return spark.createDataFrame(rows, "id long, tenant string, created_at timestamp, l1_estimate_bytes long, "
                                       "actual_scan_bytes long, actual_duration_ms long, is_retry boolean, retry_reason string")


def test_deviation_streaks(spark):
    devs = [True] * 6 + [False] + [True] * 4 + [False] + [True] * 5
    log = _log(spark, devs).unionByName(_log(spark, [True] * 5, tenant="t2", start=100))
    got = sorted((r.tenant, r.first_id, r.last_id, r.run_len) for r in deviation_streaks(log).collect())
    assert got == [("t1", 0, 5, 6), ("t1", 12, 16, 5), ("t2", 100, 104, 5)]


def test_retry_alerts_and_graduation(spark):
    log = _log(spark, [False] * 60)
    alerts = retry_alerts(log, per_week=2).collect()
    assert [(a.retry_reason, a.n) for a in alerts] == [("OOM", 5)]
    events = spark.createDataFrame([("t1", T0 + dt.timedelta(seconds=i)) for i in range(90)], "tenant string, eventTime timestamp")
    rollups = spark.createDataFrame([("t1", f"mv_{i}") for i in range(3)], "tenant string, rollup string")
    g = tenant_graduation(log, events, rollups).first()
    assert g.n_queries == 60 and g.n_rollups == 3 and g.peak_events_per_s == 1.0
    assert g.graduate is bool(g.peak_queries > 15 or g.p99_ms > 3000)
    assert tenant_graduation(log, events, rollups, max_rollups=2).first().graduate is True


def test_peak_concurrency_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), T0 + dt.timedelta(seconds=rnd.randint(0, 40)), rnd.choice([0, 500, 4000, 9000, None])) for _ in range(200)]
    log = spark.createDataFrame(rows, "tenant string, created_at timestamp, actual_duration_ms long")
    want = {}
    for tenant in ("a", "b", None):
        spans = [(int(t.timestamp() * 1000), int(t.timestamp() * 1000) + max(1 if d is None else d, 1)) for n, t, d in rows if n == tenant]
        want[tenant] = max(sum(a <= at < b for a, b in spans) for at, _ in spans)
    assert {r.tenant: r.peak_queries for r in peak_concurrency(log).collect()} == want


def test_top_and_failed(spark):
    rows = [(f"q{i}", T0 + dt.timedelta(seconds=i), 1, "lake_catalog", "EOF" if i % 3 else "ERR", "E1",
             i * 10, i, i, i * 1_000_000, i * 1048576, "SELECT " + "x" * 100) for i in range(30)]
    audit = spark.createDataFrame(rows, "queryId string, timestamp timestamp, isQuery int, catalog string, state string, "
                                        "errorCode string, queryTime long, scanBytes long, scanRows long, cpuCostNs long, "
                                        "memCostBytes long, stmt string")
    top = top_cpu(audit, n=3).collect()
    assert [r.queryId for r in top] == ["q29", "q28", "q27"] and top[0].cpu_ms == 29.0 and len(top[0].query) == 80
    failed = failed_queries(audit, n=2).collect()
    assert [r.queryId for r in failed] == ["q27", "q24"]


def test_profiles(spark):
    rows = [(T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=h + g)) for h, g in [(0, 1), (1, -1), (1, 35), (5, 2)]]
    df = spark.createDataFrame(rows, "eventTime timestamp, processingTime timestamp")
    p = arrival_gap_profile(df).first()
    assert (p.n, p.max_gap_h, p.min_gap_h, p.n_negative) == (4, 35.0, -1.0, 1)
    peak = [r.hour for r in hourly_profile(df).collect() if r.is_peak]
    assert peak == [1]
    rc = {r.day: (r.source_rows, r.target_rows, r.match) for r in
          reconcile_counts(df, F.to_date("eventTime"), df.limit(3), F.to_date("eventTime")).collect()}
    assert rc[dt.date(2024, 3, 1)][0] == 4


def test_column_drift(spark):
    a = spark.createDataFrame([(1, "x", None)], "a long, b string, c double")
    b = spark.createDataFrame([(1, 2)], "a int, d long")
    got = {r.column: (r.status, r.source_fill, r.target_fill) for r in column_drift(a, b).collect()}
    assert got == {"a": ("type_differs", 1.0, 1.0), "b": ("missing_in_target", 1.0, None),
                   "c": ("missing_in_target", 0.0, None), "d": ("missing_in_source", None, 1.0)}


def test_partition_bounds_month_and_day(spark):
    assert event_partition_values("2024-03-02", "2024-03-03", slack_days=7) == ["202402", "202403"]
    assert event_partition_values("2024-03-10", "2024-03-11", slack_days=1, period="day") == [
        "20240309", "20240310", "20240311", "20240312"]
    df = spark.createDataFrame([("202402", T0), ("202401", T0)], "event_month string, processingTime timestamp")
    assert with_event_partition_bounds(df, "2024-03-01", "2024-03-02").count() == 1
