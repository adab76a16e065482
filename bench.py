"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

fragmented table vs after compaction vs from the daily action rollup; 30-day
window stats from the rollup vs from raw rows; keep-last dedup at 10 / 100 /
200 / 500 columns; Q1 over 1,500 more columns; pruned vs full count; JSON event resolution.  Reads are medians of three runs.
Ratios are
reported beside the absolute times (compare ratios, not seconds)."""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from featurestats.operators.arrivals import ArrivalIndex  # noqa: E402
from featurestats.operators.backfill import BackfillSpec, day_rows  # noqa: E402
from featurestats.operators.layout import compact, read_events  # noqa: E402
from featurestats.operators.prune import with_event_partition_bounds  # noqa: E402
from featurestats.operators.resolve import parse_messages, plan_from_meta, resolve  # noqa: E402
from featurestats.plans.cube import Cube  # noqa: E402
from featurestats.plans.rollup import RollupTable  # noqa: E402
from featurestats.plans.stats import window_stats  # noqa: E402
from featurestats.registry import ACTIVITY, AS_OF, JAN  # noqa: E402
from featurestats.session import local_session, work_path  # noqa: E402
from featurestats.sources.fixtures import event_table  # noqa: E402
from featurestats.sources.messages import attribute_meta, feature_meta, raw_messages  # noqa: E402
from featurestats.sources.snapshots import source_table  # noqa: E402

ALL = ("count", "sum", "min", "max", "mean", "std", "p50", "p90", "p99", "distinct_count", "missing_count")


def timed(fn, runs: int = 1):
    """(median seconds of so many runs, last result)."""
    took = []
    for _ in range(runs):
        t0 = time.perf_counter()
        out = fn()
        took.append(time.perf_counter() - t0)
    return statistics.median(took), out


#: Reads are run so often; writes change what they read and run once.
READS = 3


def q1(df):
    blocked = F.exists("actions", lambda a: a == "block")
    return df.groupBy("eventType").agg(F.avg(blocked.cast("double")).alias("block_rate")).collect()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    q, extra = {}, {}

    fact = event_table(spark, sf_dir)
    fact.select(F.count(F.lit(1))).collect()  # warm up the JVM and the file cache

    # Q1 on a fragmented table (many small appends), then after compaction
    frag = work_path(spark, "bench_events")
    staged = fact.withColumn("processing_day", F.to_date("processingTime")).checkpoint(eager=True)
    # about 600 small files, like the reference's 619-file table before compaction
    for part in range(4):
        (staged.where(F.abs(F.xxhash64("eventId")) % 4 == part).coalesce(1).write.mode("append")
         .partitionBy("processing_day", "eventType").parquet(frag))
    # cold = fresh DataFrame (file listing + footers); warm = same DataFrame again
    t_frag = read_events(spark, frag)
    files_before = len(t_frag.inputFiles())
    q["q1_fragmented"], _ = timed(lambda: q1(read_events(spark, frag)), READS)
    q["q1_fragmented_warm"], _ = timed(lambda: q1(t_frag), READS)
    q["compaction"], rep = timed(lambda: compact(spark, frag).first())
    q["q1_compacted"], _ = timed(lambda: q1(read_events(spark, frag)), READS)
    t_comp = read_events(spark, frag)
    q1(t_comp)
    q["q1_compacted_warm"], _ = timed(lambda: q1(t_comp), READS)
    extra["files_before_after"] = [files_before, rep["files_after"]]

    # Q1 over a table as wide as production's: the columns it doesn't ask for are not read
    wide = work_path(spark, "bench_wide")
    more = [F.pmod(F.xxhash64("eventId", F.lit(k)), F.lit(1000)).cast("int").alias(f"w_{k:04d}") for k in range(1500)]
    staged.select("*", *more).repartition(int(cpus)).write.parquet(wide)
    q["q1_wide_1500_cols"], _ = timed(lambda: q1(spark.read.parquet(wide)), READS)

    # Q1 from the daily action rollup
    action_path = work_path(spark, "bench_action_daily")
    blocked = F.exists("actions", lambda a: a == "block")
    q["action_rollup_build"], _ = timed(lambda: read_events(spark, frag).groupBy(
        F.to_date("eventTime").alias("stat_date"), "eventType").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(blocked).alias("n_blocked")).write.parquet(action_path))
    q["q1_via_rollup"], _ = timed(lambda: spark.read.parquet(action_path).groupBy("eventType").agg(
        (F.sum("n_blocked") / F.sum("n")).alias("block_rate")).collect(), READS)
    t_roll = spark.read.parquet(action_path)
    q["q1_via_rollup_warm"], _ = timed(lambda: t_roll.groupBy("eventType").agg(
        (F.sum("n_blocked") / F.sum("n")).alias("block_rate")).collect(), READS)

    # cube: rollup build, 30-day stats from rollup vs raw
    cube = Cube("bench", ACTIVITY, ("txn_amount", "score"), ALL, tenant="acme")
    table = RollupTable(spark, cube, work_path(spark, "bench_rollup"))
    events = read_events(spark, frag)
    q["cube_rollup_build"], _ = timed(lambda: table.refresh(events, JAN))
    index = ArrivalIndex(spark, frag)
    index.build(events)
    days = table.active_days()
    q["cube_stats_rollup"], _ = timed(lambda: window_stats(events, cube, AS_OF, 30, rollup=table.states(), rollup_days=days).collect(), READS)
    q["cube_stats_raw"], _ = timed(lambda: window_stats(events, cube, AS_OF, 30).collect(), READS)
    q["cube_stats_raw_pruned"], _ = timed(lambda: window_stats(events, cube, AS_OF, 30, arrivals=index).collect(), READS)
    q["cube_stats_hybrid"], _ = timed(lambda: window_stats(events, cube, AS_OF, 30, rollup=table.states(), rollup_days=days[:20]).collect(), READS)

    # lineitem cube: 4 features, ~2,500 daily partitions; 180-day stats from rollup vs raw
    from featurestats.registry import SHIP_AS_OF, SHIPPING_CUBE
    from featurestats.sources.tables import read_table

    li_path = work_path(spark, "bench_lineitem")
    read_table(spark, sf_dir, "lineitem").write.parquet(li_path)
    li = spark.read.parquet(li_path)
    ship_days = [r[0] for r in li.select(F.to_date("l_shipdate")).distinct().collect()]
    ship = RollupTable(spark, SHIPPING_CUBE, work_path(spark, "bench_ship_rollup"))
    q["lineitem_rollup_build"], _ = timed(lambda: ship.refresh(li, ship_days))
    sdays = ship.active_days()
    q["lineitem_180d_rollup"], _ = timed(lambda: window_stats(li, SHIPPING_CUBE, SHIP_AS_OF, 180, rollup=ship.states(),
                                                              rollup_days=sdays).collect(), READS)
    q["lineitem_180d_raw"], _ = timed(lambda: window_stats(li, SHIPPING_CUBE, SHIP_AS_OF, 180).collect(), READS)
    q["lineitem_all_days_rollup"], _ = timed(lambda: window_stats(li, SHIPPING_CUBE, SHIP_AS_OF, 2500, rollup=ship.states(),
                                                                  rollup_days=sdays).collect(), READS)
    q["lineitem_all_days_raw"], _ = timed(lambda: window_stats(li, SHIPPING_CUBE, SHIP_AS_OF, 2500).collect(), READS)

    # keep-last dedup at 10 / 100 / 200 feature columns, one day exported (dedup before filter)
    src_path = work_path(spark, "bench_source")
    source_table(spark, sf_dir, n_wide=500).repartition(int(cpus) * 2).write.partitionBy("event_day").parquet(src_path)
    src = spark.read.parquet(src_path)
    keys = ["pk", "eventId", "time", "eventType"]
    for n in (10, 100, 200, 500):
        cols = keys + ["timeInserted"] + [f"f_{i:03d}" for i in range(n)]
        q[f"dedup_{n}_cols"], _ = timed(lambda cols=cols: day_rows(src.select(*cols), ["2024-01-10"], BackfillSpec())
                                       .select(F.count(F.lit(1)), *[F.sum(c) for c in cols[5:]]).collect(), READS)
        q[f"read_{n}_cols_no_dedup"], _ = timed(lambda cols=cols: src.select(*cols).where(
            (F.col("timeInserted") >= 1704844800000) & (F.col("timeInserted") < 1704931200000))
            .select(F.count(F.lit(1)), *[F.sum(c) for c in cols[5:]]).collect(), READS)

    # pruned vs full count of one insert day
    lo, hi = "2024-01-10", "2024-01-11"
    q["count_pruned"], c1 = timed(lambda: with_event_partition_bounds(
        src, lo, hi, proc_col="timeInserted", event_part_col="event_day", slack_days=2, period="day",
        proc_is_epoch_ms=True).count(), READS)
    q["count_full"], c2 = timed(lambda: src.where((F.col("timeInserted") >= 1704844800000)
                                                 & (F.col("timeInserted") < 1704931200000)).count(), READS)
    extra["pruning_parity"] = c1 == c2

    # event resolution from JSON
    plan = plan_from_meta(feature_meta(spark), attribute_meta(spark))
    msg_path = work_path(spark, "bench_messages")  # messages land as text, as from a topic dump
    raw_messages(spark, sf_dir).where(F.col("value").isNotNull()).write.text(msg_path)
    q["resolve_json"], _ = timed(lambda: resolve(parse_messages(spark.read.text(msg_path), plan=plan), plan)
                                 .write.format("noop").mode("overwrite").save(), READS)

    ratios = {
        "q1_fragmented_over_compacted": q["q1_fragmented"] / max(q["q1_compacted"], 1e-9),
        "q1_fragmented_over_compacted_warm": q["q1_fragmented_warm"] / max(q["q1_compacted_warm"], 1e-9),
        "q1_fragmented_over_rollup": q["q1_fragmented"] / max(q["q1_via_rollup"], 1e-9),
        "stats_raw_over_rollup": q["cube_stats_raw"] / max(q["cube_stats_rollup"], 1e-9),
        "lineitem_180d_raw_over_rollup": q["lineitem_180d_raw"] / max(q["lineitem_180d_rollup"], 1e-9),
        "lineitem_all_days_raw_over_rollup": q["lineitem_all_days_raw"] / max(q["lineitem_all_days_rollup"], 1e-9),
        "dedup_500_over_10": q["dedup_500_cols"] / max(q["dedup_10_cols"], 1e-9),
        "q1_wide_over_compacted": q["q1_wide_1500_cols"] / max(q["q1_compacted"], 1e-9),
        "dedup_200_over_10": q["dedup_200_cols"] / max(q["dedup_10_cols"], 1e-9),
        "count_full_over_pruned": q["count_full"] / max(q["count_pruned"], 1e-9),
    }
    out = {
        "metric": "total_headline_sec",
        "value": round(sum(q.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in q.items()},
        "ratios": {k: round(v, 2) for k, v in ratios.items()},
        "extra": extra,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        "generated": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
