"""Dedup, day/file backfill idempotence and resume, slice stitching."""

import random

from pyspark.sql import functions as F

from featurestats.operators.backfill import (
    append_ledger, backfill_days, backfill_files, read_ledger, stitch_slices,
)
from featurestats.operators.dedup import duplicate_profile, keep_last, keep_last_two_phase
from featurestats.operators.prune import latest_state
from featurestats.session import hadoop_path, work_path
from featurestats.sources.snapshots import SNAPSHOT_TYPES, source_table, write_snapshots

from paths import SF_SMALL


def _sorted(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_keep_last_variants_agree_with_hot_key(spark):
    rnd = random.Random(3)
    rows = [("hot", i, rnd.random()) for i in range(3000)]  # one key holds most rows
    rows += [("k%d" % (i % 50), i, rnd.random()) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, ver long, x double")
    expect = {}
    for k, v, x in rows:
        if k not in expect or v > expect[k][0]:
            expect[k] = (v, x)
    a = {r.k: (r.ver, r.x) for r in keep_last(df, ["k"], ["ver"]).collect()}
    b = {r.k: (r.ver, r.x) for r in keep_last_two_phase(df, ["k"], ["ver"]).collect()}
    assert a == expect == b
    prof = duplicate_profile(df, ["k"]).first()
    assert (prof.total_rows, prof.unique_keys, prof.duplicates) == (4000, 51, 3949)


def test_day_backfill_idempotent_and_dry_run(spark):
    src = source_table(spark, SF_SMALL)
    days = ["2024-01-05", "2024-01-06"]
    target, ledger = work_path(spark, "t_bf"), work_path(spark, "t_bf_ledger")
    dry = backfill_days(spark, src, days, target, ledger, dry_run=True)
    assert read_ledger(spark, ledger).count() == 0
    first = backfill_days(spark, src, days, target, ledger)
    assert _sorted(first, ["unit", "rows"]) == _sorted(dry, ["unit", "rows"])
    snap = _sorted(spark.read.parquet(target), ["eventId", "txn_amount"])
    again = backfill_days(spark, src, days, target, ledger)  # all DONE → nothing to do
    assert again.count() == 0
    # force a retry of one day: the rewrite replaces that day only
    append_ledger(spark, ledger, spark.createDataFrame([("2024-01-05", "FAILED", 0)], "unit string, state string, rows long")
                  .withColumn("updated_at", F.current_timestamp()))
    backfill_days(spark, src, days, target, ledger)
    assert _sorted(spark.read.parquet(target), ["eventId", "txn_amount"]) == snap
    states = {r.unit: r.state for r in latest_state(read_ledger(spark, ledger)).collect()}
    assert states == {"2024-01-05": "DONE", "2024-01-06": "DONE"}


def test_file_backfill_resume_has_no_loss_or_duplicates(spark):
    root = write_snapshots(spark, SF_SMALL, work_path(spark, "t_snap"))
    target, ledger = work_path(spark, "t_bff"), work_path(spark, "t_bff_ledger")
    full = backfill_files(spark, root, dict(SNAPSHOT_TYPES), work_path(spark, "t_bff_ref"), work_path(spark, "t_l2"))
    expected_rows = sum(r.rows for r in full.collect())
    # first run: pretend half of the exports were done by marking the others FAILED afterwards
    backfill_files(spark, root, dict(SNAPSHOT_TYPES), target, ledger)
    units = sorted(r.unit for r in read_ledger(spark, ledger).collect())
    redo = units[::2]
    append_ledger(spark, ledger, spark.createDataFrame([(u, "FAILED", 0) for u in redo], "unit string, state string, rows long")
                  .withColumn("updated_at", F.current_timestamp()))
    backfill_files(spark, root, dict(SNAPSHOT_TYPES), target, ledger)
    t = spark.read.parquet(target)
    assert t.count() == expected_rows
    assert t.select("eventId", "processingTime").distinct().count() == expected_rows


def test_stitch_slices_equals_wide(spark):
    wide = keep_last(source_table(spark, SF_SMALL, n_wide=6), ["pk", "eventId", "time", "eventType"], ["timeInserted"])
    keys = ["pk", "eventId", "time", "eventType"]
    slices = [wide.select(*keys, "f_000", "f_001"), wide.select(*keys, "f_002", "txn_amount"),
              wide.select(*keys, "f_003", "f_004", "f_005")]
    st = stitch_slices(slices, keys)
    cols = keys + ["f_000", "f_001", "f_002", "txn_amount", "f_003", "f_004", "f_005"]
    assert _sorted(st, cols) == _sorted(wide, cols)


def test_stitching_gets_more_tasks_with_more_cells(spark, monkeypatch):
    from featurestats.operators import backfill

    rows = [(None if k == 7 else f"k{k}", k) for k in range(200)]
    slices = [spark.createDataFrame([(k, v + c) for k, v in rows], f"k string, c{c} long").repartition(2) for c in range(3)]
    want = sorted([(k or "", v, v + 1, v + 2) for k, v in rows])
    for cells, least in ((8_000_000, 4), (100, 18)):
        monkeypatch.setattr(backfill, "STITCH_CELLS", cells)
        out = stitch_slices(slices, ["k"])
        assert out.rdd.getNumPartitions() == least
        assert sorted((r[0] or "", *r[1:]) for r in out.collect()) == want


def _backfilled(spark, src, parts, index=None):
    from featurestats.operators.backfill import BackfillSpec, backfill_days
    from featurestats.operators.layout import read_events

    table, ledger = work_path(spark, "t_bf"), work_path(spark, "t_bf_ledger")
    for days in parts:
        backfill_days(spark, src, days, table, ledger, BackfillSpec(), index=index)
    t = read_events(spark, table)
    return sorted((tuple(r) for r in t.select(*sorted(t.columns)).collect()), key=repr)


def _days_of(src):
    return sorted(r[0] for r in src.select(F.date_format(F.timestamp_millis("timeInserted"), "yyyy-MM-dd")).distinct().collect())


def test_key_index_equals_a_backfill_from_scratch(spark):
    """Days in any split, NULL keys, versions on later days, tied rows, a compaction in between, a day added twice."""
    from featurestats.operators.key_index import KeyIndex

    src = source_table(spark, SF_SMALL)
    src = src.withColumn("pk", F.when(F.col("eventId").cast("int") % 9 != 0, F.col("pk")))
    src = src.unionByName(src.where("eventId = '7'").withColumn("score", F.lit(999)))
    path = work_path(spark, "t_index_src")
    src.write.parquet(path)
    src = spark.read.parquet(path)
    days = _days_of(src)
    scratch = _backfilled(spark, src, [days])
    for parts in ([days[:-2], days[-2:-1], days[-1:]], [days[10:], days[:10]]):
        index = KeyIndex(spark, work_path(spark, "t_index"), buckets=4)
        assert _backfilled(spark, src, parts[:1], index) != scratch
        index.compact()
        index._append(index.rows().limit(5), index._generation())  # as a run that died before its ledger row
        assert _backfilled(spark, src, parts, KeyIndex(spark, index.path, buckets=4)) == scratch


def test_key_index_side_is_not_shuffled(spark):
    from featurestats.operators.key_index import KEY, KeyIndex

    src = source_table(spark, SF_SMALL)
    index = KeyIndex(spark, work_path(spark, "t_plan"), buckets=4)
    days = _days_of(src)
    assert index.add(src, days[:10]) == days[:10] and index.add(src, days[:12]) == days[10:12]
    winners = index.winners(days[11:12])
    plan = winners._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    own = src.where("timeInserted > 0").selectExpr("to_json(struct(pk, eventId, time, eventType)) AS " + KEY)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = own.join(winners, KEY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count("Exchange hashpartitioning") == 1  # the day's side


def test_key_index_over_several_sessions(spark):
    """The catalog entry belongs to a session, the files and the ledger do not."""
    from featurestats.operators.key_index import KeyIndex

    src = source_table(spark, SF_SMALL)
    index = KeyIndex(spark, work_path(spark, "t_sessions"), buckets=4)
    assert index.rows() is None and index.days() == set()
    days = _days_of(src)
    index.add(src, days[:3])
    spark.sql(f"DROP TABLE {index._table(0)}")
    again = KeyIndex(spark, index.path, buckets=4)
    n = again.rows().count()
    assert again.add(src, days[:4]) == [days[3]] and again.rows().count() > n and again.days() == set(days[:4])


def test_ties_go_to_the_greatest_row(spark):
    from featurestats.operators.dedup import keep_last_two_phase

    rows = [(1, 5, "a", None), (1, 5, "b", 1), (1, 4, "z", 9), (2, 5, "x", 1), (None, 1, "p", 1), (None, 1, "p", 2), (3, None, "q", 1)]
    df = spark.createDataFrame(rows, "k int, v int, a string, b int")
    assert sorted(map(tuple, keep_last_two_phase(df, ["k"], ["v"]).collect()), key=repr) == sorted(
        [(1, 5, "b", 1), (2, 5, "x", 1), (None, 1, "p", 2), (3, None, "q", 1)], key=repr)
    plain = df.where("k = 2 OR k = 3")
    plan = keep_last_two_phase(plain, ["k"], ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # nothing is tied: one wide join
    assert keep_last_two_phase(df.limit(0), ["k"], ["v"]).count() == 0


def test_headers_with_quoted_line_breaks(spark, tmp_path):
    import gzip

    from featurestats.operators.backfill import read_snapshots

    for k, header in enumerate(('id,"two\nlines",x', 'id,"a ""b""",x', "id,two,x")):
        with gzip.open(tmp_path / f"e{k}.csv.gz", "wt") as f:
            f.write(f'{header}\n{k},"p\nq",r\n')
    df = read_snapshots(spark, {f"e{k}": [f"file://{tmp_path}/e{k}.csv.gz"] for k in range(3)})
    assert set(df.columns) == {"id", "two\nlines", 'a "b"', "two", "x", "_export"}
    assert sorted((r["id"], r["x"], r["_export"]) for r in df.collect()) == [(str(k), "r", f"e{k}") for k in range(3)]


def test_event_days_of_an_insert_range_by_the_index(spark):
    from featurestats.operators.arrivals import ArrivalIndex
    from featurestats.operators.prune import with_event_partition_bounds

    rows = [(1, "2024-01-05", 1), (2, "2023-11-01", 1), (3, None, 1), (4, "2024-01-05", 2)]
    df = spark.createDataFrame(rows, "id int, d string, p int").select(
        "id", F.to_timestamp("d").alias("eventTime"), F.regexp_replace("d", "-", "").alias("event_day"),
        F.expr("timestampadd(DAY, p, TIMESTAMP '2024-01-04 12:00:00')").alias("processingTime"))
    index = ArrivalIndex(spark, work_path(spark, "t_events_between"))
    index.build(df.withColumn("processing_day", F.to_date("processingTime")))
    got = with_event_partition_bounds(df, "2024-01-05", "2024-01-06", period="day", event_part_col="event_day", arrivals=index)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]
    assert sorted(r.id for r in with_event_partition_bounds(df, "2024-01-06", "2024-01-07", period="day", event_part_col="event_day", arrivals=index).collect()) == [4]


def test_an_unreadable_export_is_read_twice_at_most(spark, monkeypatch):
    import gzip

    from featurestats.operators import backfill
    from featurestats.operators.layout import read_events

    root = work_path(spark, "t_exports")
    fs, folder = hadoop_path(spark, root)
    fs.mkdirs(folder)
    body = "eventId,eventType,time,timeInserted,score\n" + "".join(f"{k},t{k % 3},1704067200000,1704067200000,{k}\n" for k in range(5000))
    for n in range(8):
        data = gzip.compress(body.encode())
        stream = fs.create(hadoop_path(spark, f"{root}/raw__ch-exporter-event_result-{n}-x.csv.gz")[1], True)
        stream.write(bytearray(data[:len(data) * 2 // 3] if n == 5 else data))
        stream.close()
    reads, whole = [], backfill.read_snapshots
    monkeypatch.setattr(backfill, "read_snapshots", lambda spark, files: (reads.extend(files), whole(spark, files))[1])
    table, ledger = work_path(spark, "t_export_table"), work_path(spark, "t_export_ledger")
    declared = {"eventId": "String", "eventType": "String", "time": "UInt64", "timeInserted": "UInt64", "score": "Int32"}
    backfill.backfill_files(spark, root, declared, table, ledger)
    assert max(reads.count(name) for name in reads) == 2
    state = {r.unit: (r.state, r.rows) for r in backfill.read_ledger(spark, ledger).collect()}
    assert len(state) == 8 and [(u, v) for u, v in state.items() if v != ("DONE", 5000)] == [("raw__ch-exporter-event_result-5-x", ("FAILED", 0))]
    assert read_events(spark, table).count() == 7 * 5000


def test_an_export_is_truncated_outside_the_driver_python(spark, tmp_path):
    import os
    import tracemalloc

    from featurestats.sources.snapshots import truncate_export

    exports = {f"raw__ch-exporter-event_result-{n}-part{n}.csv.gz": os.urandom(6_000_001) for n in range(3)}
    for name, data in exports.items():
        (tmp_path / name).write_bytes(data)
    tracemalloc.start()
    try:
        truncate_export(spark, str(tmp_path), "part1")
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held < 1_000_000
    # what is left is the beginning, nothing lies beside it but checksums, and the other exports are whole
    exports["raw__ch-exporter-event_result-1-part1.csv.gz"] = exports["raw__ch-exporter-event_result-1-part1.csv.gz"][:4_000_000]
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir() if not p.name.endswith(".crc")} == exports
