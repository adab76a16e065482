"""Alerts and estimates on streams equal their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from featurestats.operators.audit import estimate_join, retry_alerts, upgrade_alerts
from featurestats.session import work_path
from featurestats.streaming.alerts import late_rows, read_alerts, start_alerts, start_estimates

LOG = ("id long, query_id string, query_type string, routing_path string, l1_estimate_bytes long, l2_estimate_bytes long, "
       "is_retry boolean, retry_reason string, created_at timestamp")
AUDIT = "queryId string, timestamp timestamp, scanBytes long, cpuCostNs long, memCostBytes long"
NOW = {"availableNow": True}


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def entry(i, at, reason=None, path="ADHOC_WH"):
    return (i, f"q{i}", "ADHOC_QUERY", path, 10 * i, 20 * i, reason is not None, reason, at)


def as_stream(spark, path, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)


def batch_alerts(log):
    r = retry_alerts(log).select(F.lit("retry").alias("alert"), "window_start", F.col("retry_reason").alias("detail"), "n")
    return r.unionByName(upgrade_alerts(log).select(F.lit("upgrade").alias("alert"), "window_start", F.lit("ADHOC_HEAVY").alias("detail"), "n"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_alerts_with_late_rows_and_a_second_run(spark):
    first = [entry(k, day(3, k % 20), "OOM") for k in range(40)] + [entry(100 + k, day(4, k), None, "ADHOC_HEAVY") for k in range(9)]
    first += [entry(200, day(4), None), entry(201, day(4), "TIMEOUT"), entry(202, day(20), "TIMEOUT")]
    # Out of order within the delay, on time; a week and more behind the watermark: late.
    second = [entry(300, day(19, 6), "TIMEOUT"), entry(301, day(20), "TIMEOUT"), entry(302, day(19, 12), "TIMEOUT")]
    late = [entry(400, day(3), "OOM"), entry(401, day(4), None, "ADHOC_HEAVY"), entry(402, day(4), None, "ADHOC_HEAVY")]
    src, path, ckpt = (work_path(spark, n) for n in ("t_log", "t_alerts", "t_alerts_ckpt"))
    start_alerts(as_stream(spark, src, LOG, first, second + late), path, ckpt, trigger=NOW).awaitTermination()
    log = spark.createDataFrame(first + second, LOG)
    want = rows_of(batch_alerts(log))
    assert rows_of(read_alerts(spark, path)) == want and len(want) == 3
    assert {r.alert: r.n_late for r in late_rows(spark, path).collect()} == {"retry": 1, "upgrade": 2}
    # The query goes on from its checkpoint; state of the open window is still there.
    third = [entry(500, day(21), "TIMEOUT")]
    start_alerts(as_stream(spark, src, LOG, third), path, ckpt, trigger=NOW).awaitTermination()
    assert rows_of(read_alerts(spark, path)) == rows_of(batch_alerts(log.unionByName(spark.createDataFrame(third, LOG))))


def test_estimates_join_and_outer_rows_come_once(spark):
    audits = [(f"q{k}", day(1, k), 100 + k, 1, 1) for k in range(8)] + [(None, day(1), 5, 1, 1)]
    logs = [entry(k, day(1, k)) for k in range(8) if k not in (3, 5)]
    logs += [entry(5, day(2, 12))]  # hours away from its query: no estimate of it
    # What moves the watermarks on, so that the intervals close.
    beat_audit, beat_log = [("beat", day(30), 1, 1, 1)], [entry(999, day(30))]
    a, e = as_stream(spark, work_path(spark, "t_a"), AUDIT, audits, beat_audit), as_stream(spark, work_path(spark, "t_e"), LOG, logs, beat_log)
    path = work_path(spark, "t_est")
    start_estimates(a, e, path, work_path(spark, "t_est_ckpt"), trigger=NOW).awaitTermination()
    got = spark.read.parquet(path).where("query_id IS NULL OR query_id <> 'beat'")
    want = estimate_join(spark.createDataFrame(audits, AUDIT), spark.createDataFrame([x for x in logs if x[0] != 5], LOG))
    assert rows_of(got) == rows_of(want) and got.count() == 9
    assert rows_of(got.where("l1_estimate_bytes IS NULL").select("scanBytes")) == [(103,), (105,), (5,)]


def test_alert_state_groups_do_not_grow_with_the_windows(spark):
    from featurestats.streaming.alerts import BUCKETS

    rows = [entry(k, day(k // 6), None, "ADHOC_HEAVY") for k in range(6 * 400)] + [entry(9000, None, "OOM", "ADHOC_HEAVY")]
    src, path, ckpt = (work_path(spark, n) for n in ("t_many", "t_many_alerts", "t_many_ckpt"))
    query = start_alerts(as_stream(spark, src, LOG, rows), path, ckpt, trigger=NOW)
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= BUCKETS
    assert rows_of(read_alerts(spark, path)) == rows_of(batch_alerts(spark.createDataFrame(rows, LOG))) and not late_rows(spark, path).collect()


def test_halves_part_at_the_median(spark):
    from featurestats.registry import _halves

    rows = [(k, day(k * k % 37, k % 24)) for k in range(30)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, at timestamp")
    middle = df.agg(F.percentile(F.unix_millis("at"), F.lit(0.5)).cast("bigint")).first()[0]
    old, new = _halves(df, "at")
    assert rows_of(old) == rows_of(df.where(F.unix_millis("at") < middle)) and rows_of(new) == rows_of(df.where(F.unix_millis("at") >= middle))
