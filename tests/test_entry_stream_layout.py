"""Driver contract, stream = batch, layout and maintenance."""

import datetime as dt

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as E
from featurestats.operators.layout import compact, expired_partitions, read_events, write_events
from featurestats.operators.resolve import parse_messages, plan_from_meta, resolve
from featurestats.operators.schema_log import align, evolve
from featurestats.session import path_exists, work_path
from featurestats.sources.fixtures import event_table
from featurestats.sources.messages import attribute_meta, feature_meta, raw_messages
from featurestats.streaming.stream import MetadataCache, quarantine_path, start_ingest

from paths import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "coverage" in df.columns


def test_every_query_has_oracle_or_reason():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
    for name, fn in q.items():
        assert fn.__doc__, name


def test_stream_equals_batch(spark):
    src = work_path(spark, "t_stream_src")
    raw_messages(spark, SF_SMALL).where(F.col("value").isNotNull()).repartition(3).write.text(src)
    table, ckpt = work_path(spark, "t_stream"), work_path(spark, "t_stream_ckpt")
    calls = {"n": 0}

    def loader():
        calls["n"] += 1
        if calls["n"] == 2:
            raise RuntimeError("metadata store down")  # the last good metadata is kept
        return feature_meta(spark), attribute_meta(spark)

    meta = MetadataCache(loader)
    q = start_ingest(spark, src, table, ckpt, meta, trigger={"availableNow": True})
    q.awaitTermination()
    streamed = spark.read.parquet(table).select("eventId", "txn_amount", "account_id")
    plan = plan_from_meta(feature_meta(spark), attribute_meta(spark))
    batch = resolve(parse_messages(raw_messages(spark, SF_SMALL), plan=plan), plan).select("eventId", "txn_amount", "account_id")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_parses_each_message_once(spark, monkeypatch):
    """Rows, rejected messages and counts of a batch come of one reading of its messages."""
    from featurestats.operators.resolve import quarantine
    from featurestats.streaming import stream

    texts = [f'{{"eventId":"{k}","eventType":"a","time":1704067200000,"processTime":1704067200000,"rules":[1]}}' for k in range(20)]
    texts += ["", "{}", "[1]", "no json", "null", '{"eventId":"b","time":"x"}', '{"eventId":"c","originId":"q"}', '{"eventId":"d","rules":["z"]}', '{"eventId":"e","rules":"nope"}']
    src = work_path(spark, "t_once_src")
    messages = spark.createDataFrame([(t,) for t in texts], "value string")
    messages.repartition(3).write.text(src)
    parsed_rows = spark.sparkContext.accumulator(0)

    def counted(batch, plan):
        def run(batches):
            for b in batches:
                parsed_rows.add(len(b))
                yield b

        return parse_messages(batch.mapInArrow(run, batch.schema), plan=plan)

    monkeypatch.setattr(stream, "parse_messages", counted)
    table = work_path(spark, "t_once")
    meta = MetadataCache(lambda: (feature_meta(spark), attribute_meta(spark)))
    start_ingest(spark, src, table, work_path(spark, "t_once_ckpt"), meta, trigger={"availableNow": True}).awaitTermination()
    assert parsed_rows.value == len(texts)
    plan = plan_from_meta(feature_meta(spark), attribute_meta(spark))
    parsed = parse_messages(messages, plan=plan)
    key = lambda r: repr(tuple(r))
    cols = resolve(parsed, plan).columns
    assert sorted(read_events(spark, table).select(*cols).collect(), key=key) == sorted(resolve(parsed, plan).collect(), key=key)
    assert sorted(spark.read.parquet(quarantine_path(table)).select("raw_value", "reason").collect()) == sorted(quarantine(parsed).collect())


def test_evolve_align():
    a = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.StringType())])
    b = T.StructType([T.StructField("y", T.StringType()), T.StructField("z", T.DoubleType())])
    target, added = evolve(a, b)
    assert [f.name for f in target.fields] == ["x", "y", "z"] and added == ["z"]


def test_align_fills_missing(spark):
    target = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    out = align(spark.createDataFrame([("1",)], "a string"), target).collect()
    assert out[0].a == 1 and out[0].b is None


def test_compaction_keeps_rows_and_retention(spark):
    fact = event_table(spark, SF_SMALL)
    path = work_path(spark, "t_compact")
    for part in range(3):
        write_events(fact.where(F.abs(F.xxhash64("eventId")) % 3 == part), path, mode="append")
    before = sorted(map(tuple, read_events(spark, path).select("eventId", "txn_amount").collect()))
    rep = compact(spark, path).first()
    after = sorted(map(tuple, read_events(spark, path).select("eventId", "txn_amount").collect()))
    assert before == after and rep.rows_match and rep.files_after < rep.files_before
    exp = expired_partitions(read_events(spark, path), dt.date(2024, 1, 31), 20).collect()
    assert all(r.processing_day < dt.date(2024, 1, 11) for r in exp) and sum(r.n_rows for r in exp) > 0


def test_stream_replay_after_crash_does_not_duplicate(spark, monkeypatch):
    """Batch 0 was committed to the table but its ledger row was lost: the
    replayed batch 0 must not be written twice."""
    from featurestats.streaming import stream

    src = work_path(spark, "t_replay_src")
    raw_messages(spark, SF_SMALL).where(F.col("value").isNotNull()).coalesce(1).write.text(src)
    table, ckpt = work_path(spark, "t_replay"), work_path(spark, "t_replay_ckpt")
    meta = MetadataCache(lambda: (feature_meta(spark), attribute_meta(spark)))
    path_of, crashes = stream.affected_path, []

    def crash_once(p):
        if not crashes:
            crashes.append(p)
            raise RuntimeError("crash after the data commit")
        return path_of(p)

    monkeypatch.setattr(stream, "affected_path", crash_once)
    with pytest.raises(Exception, match="crash after"):
        start_ingest(spark, src, table, ckpt, meta, trigger={"availableNow": True}).awaitTermination()
    n = spark.read.parquet(table).count()
    assert n > 0
    start_ingest(spark, src, table, ckpt, meta, trigger={"availableNow": True}).awaitTermination()
    assert spark.read.parquet(table).count() == n
    assert spark.read.parquet(quarantine_path(table)).groupBy("raw_value").count().where("count > 1").isEmpty()
    t = spark.read.parquet(table)
    assert t.count() == t.select("eventId").distinct().count() > 0


def test_stream_feeds_pending_rollup_refresh(spark):
    """The ingest logs the event days each batch touched; refresh_pending
    recomputes exactly those; stats then equal the direct aggregate."""
    from featurestats.plans.cube import Cube, Dimension
    from featurestats.plans.rollup import RollupTable
    from featurestats.streaming.stream import affected_path

    src = work_path(spark, "t_pend_src")
    raw_messages(spark, SF_SMALL).where(F.col("value").isNotNull()).repartition(2).write.text(src)
    table, ckpt = work_path(spark, "t_pend"), work_path(spark, "t_pend_ckpt")
    meta = MetadataCache(lambda: (feature_meta(spark), attribute_meta(spark)))
    start_ingest(spark, src, table, ckpt, meta, trigger={"availableNow": True}).awaitTermination()
    events = spark.read.parquet(table)
    cube = Cube("c", Dimension("t", "eventType", type="column"), ("txn_amount",), ("count", "sum"))
    rollup = RollupTable(spark, cube, work_path(spark, "t_pend_rollup"))
    affected = spark.read.parquet(affected_path(table))
    days = rollup.refresh_pending(events, affected)
    assert len(days) == 30
    assert rollup.pending_days(affected) == []  # nothing new arrived
    got = {r.segment_value: (r["count"], round(r["sum"], 6)) for r in rollup.stats(events, dt.date(2024, 1, 31), 30).collect()}
    direct = events.where("eventTime IS NOT NULL").groupBy("eventType").agg(F.count("txn_amount"), F.sum("txn_amount")).collect()
    assert got == {r[0]: (r[1], round(r[2], 6)) for r in direct}


def test_compaction_of_one_partition_only(spark):
    fact = event_table(spark, SF_SMALL)
    path = work_path(spark, "t_compact_one")
    for part in range(3):
        write_events(fact.where(F.abs(F.xxhash64("eventId")) % 3 == part), path, mode="append")
    day = "2024-01-05"
    other_before = sorted(f for f in read_events(spark, path).inputFiles() if f"processing_day={day}" not in f)
    rep = compact(spark, path, partition_filter=f"processing_day = '{day}'").first()
    other_after = sorted(f for f in read_events(spark, path).inputFiles() if f"processing_day={day}" not in f)
    assert rep.rows_match and rep.files_after < rep.files_before
    assert other_before == other_after  # other partitions untouched


def test_apply_retention_drops_only_expired_days(spark):
    from featurestats.operators.layout import apply_retention

    fact = event_table(spark, SF_SMALL)
    path = work_path(spark, "t_retention")
    write_events(fact, path)
    listed = apply_retention(spark, path, "2024-01-31", 20)  # dry run
    listed_days = [dt.date.fromisoformat(p.rsplit("processing_day=", 1)[1]) for p in listed]
    assert listed_days and all(d < dt.date(2024, 1, 11) for d in listed_days)
    before = read_events(spark, path).count()
    expired_rows = sum(r.n_rows for r in expired_partitions(read_events(spark, path), dt.date(2024, 1, 31), 20).collect())
    assert read_events(spark, path).count() == before  # dry run removed nothing
    apply_retention(spark, path, "2024-01-31", 20, dry_run=False)
    after = read_events(spark, path)
    assert after.count() == before - expired_rows
    assert after.where(F.col("processing_day") < F.lit(dt.date(2024, 1, 11))).count() == 0


def test_compaction_keeps_concurrent_appends_and_leaves_nothing(spark, monkeypatch):
    import glob

    from featurestats.operators import layout

    fact = event_table(spark, SF_SMALL)
    path = work_path(spark, "t_compact_append").removeprefix("file:")
    for part in range(2):
        write_events(fact.where(F.abs(F.xxhash64("eventId")) % 3 == part), path, mode="append")
    finish = layout.finish_compaction

    def append_between(spark_, path_):
        if path_exists(spark_, path_ + "__compaction"):  # staged, not yet swapped
            write_events(fact.where(F.abs(F.xxhash64("eventId")) % 3 == 2), path_, mode="append")
        return finish(spark_, path_)

    monkeypatch.setattr(layout, "finish_compaction", append_between)
    assert layout.compact(spark, path).first().rows_match
    assert read_events(spark, path).count() == fact.count()
    assert not glob.glob(path + "__compact*")
    footer = pq.ParquetFile(glob.glob(path + "/*/*/*.parquet")[0]).metadata.row_group(0)
    ids = next(footer.column(i) for i in range(footer.num_columns) if footer.column(i).path_in_schema == "eventId")
    assert ids.compression == "ZSTD"


def test_correlated_pruning_reaches_the_scan(spark):
    from featurestats.operators.arrivals import ArrivalIndex
    from featurestats.plans.cube import Cube, Dimension
    from featurestats.plans.rollup import RollupTable

    path = work_path(spark, "t_prune")
    write_events(event_table(spark, SF_SMALL), path)
    index = ArrivalIndex(spark, path)
    index.build(read_events(spark, path))
    cube = Cube("c", Dimension("t", "eventType", type="column"), ("txn_amount",), ("count", "sum"))
    rollup = RollupTable(spark, cube, work_path(spark, "t_prune_rollup"), index)
    plan = rollup.stats(read_events(spark, path), dt.date(2024, 1, 31), 7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(processing_day" in plan
    with pytest.raises(ValueError, match="score"):
        RollupTable(spark, Cube("c", cube.dimension, ("score",), ("count",)), work_path(spark, "t_bad"), index).refresh(
            read_events(spark, path).drop("score"), [dt.date(2024, 1, 10)])
    rollup.refresh(read_events(spark, path), [dt.date(2024, 1, 10)])
    rollup.drop()
    assert rollup.ledger().isEmpty()


def _ids(spark, path):
    return sorted(map(tuple, read_events(spark, path).select("eventId", "txn_amount").collect()))


def test_compaction_packs_by_size_and_then_has_nothing_to_do(spark):
    from featurestats.operators.layout import table_files

    fact, path = event_table(spark, SF_SMALL), work_path(spark, "t_bins")
    for part in range(3):
        write_events(fact.where(F.abs(F.xxhash64("eventId")) % 3 == part), path, mode="append")
    before, rows = {r.path: r.length for r in table_files(spark, path).collect()}, _ids(spark, path)
    target = sorted(before.values())[len(before) // 2]
    rep = compact(spark, path, target_file_bytes=target).first()
    after = {r.path for r in table_files(spark, path).collect()}
    assert {p for p, n in before.items() if n >= target} <= after  # files of the target size are not touched
    assert rep.rows_match and rep.files_before > rep.files_after and rep.files_before <= sum(n < target for n in before.values())
    assert _ids(spark, path) == rows
    compact(spark, path)  # all of a directory fits one file now
    assert tuple(compact(spark, path).first()) == (0, 0, 0, 0, True) and _ids(spark, path) == rows


def test_pack_files_first_fit_decreasing(spark):
    from featurestats.operators.layout import pack_files

    sizes = [("a", "a/%d" % k, n) for k, n in enumerate([90, 80, 70, 60, 50, 40, 30, 100, 300])] + [("b", "b/0", 5)]
    bins = {}
    for r in pack_files(spark.createDataFrame(sizes, "directory string, path string, length long"), 100).collect():
        bins.setdefault(r.bin, []).append(r.length)
    # Bins of up to 200; the files of 100 and more stay, and so does the one that is alone.
    assert sorted(sorted(b) for b in bins.values()) == [[30, 80, 90], [50, 60, 70]] or sorted(x for b in bins.values() for x in b) == [
        30, 40, 50, 60, 70, 80, 90] and all(sum(b) <= 200 for b in bins.values())


def test_compaction_crash_costs_one_bin(spark, monkeypatch):
    """The swap dies after some bins: what is journaled is finished by the next call, each row stands once."""
    from featurestats.operators import layout

    fact, path = event_table(spark, SF_SMALL), work_path(spark, "t_bins_crash")
    for part in range(2):
        write_events(fact.where(F.abs(F.xxhash64("eventId")) % 2 == part), path, mode="append")
    rows, text, calls = _ids(spark, path), layout._text, []

    def dies(spark_, file):
        calls.append(file)
        if len(calls) == 4:
            raise RuntimeError("lost driver")
        return text(spark_, file)

    monkeypatch.setattr(layout, "_text", dies)
    monkeypatch.setattr(layout, "CALLS", 1)
    with pytest.raises(RuntimeError, match="lost driver"):
        compact(spark, path)
    monkeypatch.setattr(layout, "_text", text)
    assert layout.finish_compaction(spark, path) > 0
    assert _ids(spark, path) == rows and layout.finish_compaction(spark, path) == 0
