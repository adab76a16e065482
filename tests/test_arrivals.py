"""The arrival index: exact pruning, stale days, crashes, and the rollups that use it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from featurestats.operators.arrivals import ArrivalIndex
from featurestats.operators.layout import read_events
from featurestats.operators.store import append_live, replace_units
from featurestats.plans.cube import Cube, Dimension
from featurestats.plans.rollup import RollupTable
from featurestats.plans.stats import window_stats
from featurestats.session import work_path
from featurestats.sources.fixtures import event_table
from paths import SF_SMALL

CUBE = Cube("c", Dimension("t", "eventType", type="column"), ("txn_amount",), ("count", "sum", "min"))
AS_OF = dt.date(2024, 1, 31)


def rows_of(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.fixture
def late(spark):
    """A table one of whose rows came 60 days late, and one without an event time or processing time."""
    fact = event_table(spark, SF_SMALL)
    path = work_path(spark, "t_late")
    one = fact.where("eventId = '0'").limit(1)
    append_live(fact, path)
    append_live(one.withColumn("processingTime", F.col("processingTime") + F.expr("INTERVAL 60 DAYS")), path)
    append_live(one.withColumn("eventTime", F.lit(None).cast("timestamp")).withColumn("processingTime", F.lit(None).cast("timestamp")), path)
    return path


def test_lists_exactly_the_partitions_that_hold_the_days(spark, late):
    events, index = read_events(spark, late), ArrivalIndex(spark, late)
    day = events.where("eventId = '0' AND eventTime IS NOT NULL").select(F.to_date("eventTime")).first()[0]
    for days in ([day], [dt.date(2024, 1, 5), dt.date(2024, 1, 20)], [dt.date(2030, 1, 1)]):
        want = {r[0] for r in events.where(F.to_date("eventTime").isin(days)).select("processing_day").distinct().collect()}
        assert set(index.processing_days(days)) == want
        read = events.where(index.holds(days)).select("_metadata.file_path").distinct().collect()
        assert {r[0].split("processing_day=")[1].split("/")[0] for r in read} == {str(d) for d in want}
    assert index.event_days() == sorted(r[0] for r in events.select(F.to_date("eventTime")).distinct().collect() if r[0])
    assert day in index.event_days(dt.date(2024, 2, 1))
    stats = window_stats(events, CUBE, AS_OF, 30, arrivals=index)
    filters = stats._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "processing_day" in filters and "2023-12-31" in filters and ") OR (" in filters  # (the plan cuts the rest off)
    assert rows_of(stats) == rows_of(window_stats(events, CUBE, AS_OF, 30))


def test_rows_without_times_prune_too(spark):
    """Rows with an event time but no processing day are found in the partition that has none."""
    fact, path = event_table(spark, SF_SMALL), work_path(spark, "t_nulls")
    append_live(fact.withColumn("processingTime", F.when(F.col("eventId").cast("int") % 7 != 0, F.col("processingTime"))), path)
    events, index = read_events(spark, path), ArrivalIndex(spark, path)
    assert None in index.processing_days([dt.date(2024, 1, 9)])
    assert rows_of(window_stats(events, CUBE, AS_OF, 7, arrivals=index)) == rows_of(window_stats(events, CUBE, AS_OF, 7))


def test_a_write_under_way_hides_nothing(spark, late):
    index, day = ArrivalIndex(spark, late), dt.date(2024, 1, 9)
    before = index.day_tokens()
    assert before[day] is not None
    # A live batch: its days are known, its data not marked.
    index.record("crashed", spark.createDataFrame([("live", dt.date(2024, 3, 1), day, 1)], "load_unit string, processing_day date, event_day date, n_rows long"))
    assert dt.date(2024, 3, 1) in index.processing_days([day]) and index.day_tokens()[day] is None
    assert {d for d, t in index.day_tokens().items() if t is None} == {day}
    index.mark("crashed", ["live"])
    index.mark("crashed", ["live"])  # twice: a replay
    assert index.day_tokens()[day] not in (None, before[day])
    # A replaced unit: nothing is known of it but its processing day.
    index.announce("unit", ["day-x"], [dt.date(2024, 4, 1)])
    assert dt.date(2024, 4, 1) in index.processing_days([day]) and set(index.day_tokens().values()) == {None}
    index.announce("all", ["file-y"])
    assert index.processing_days([day]) is None
    assert index.holds([day])._jc.toString() == "true"
    # Later entries of the units end both.
    for unit in ("day-x", "file-y"):
        index.mark("again-" + unit, [unit])
    assert dt.date(2024, 4, 1) not in index.processing_days([day]) and None not in index.day_tokens().values()


def test_replaced_units_supersede(spark):
    fact, path = event_table(spark, SF_SMALL), work_path(spark, "t_units")
    index = ArrivalIndex(spark, path)
    append_live(fact, path)
    day = fact.where("to_date(processingTime) = DATE '2024-01-10'").withColumn("_load_unit", F.lit("day-2024-01-10"))
    n = day.count()
    for part, want in ((day, n), (day.where("eventType = 'click'"), day.where("eventType = 'click'").count()), (day.limit(0), 0)):
        replace_units(part, path, ["day-2024-01-10"], [dt.date(2024, 1, 10)])
        mine = index.entries().where("load_unit = 'day-2024-01-10'")
        assert (mine.agg(F.sum("n_rows")).first()[0] or 0) == want
        assert read_events(spark, path).where("_load_unit = 'day-2024-01-10'").count() == want
        assert mine.where("open").isEmpty()
    tokens = index.day_tokens()
    index.tidy()
    assert index.day_tokens() == tokens and len(spark.read.parquet(index.rows_path).inputFiles()) == 1


def test_build_indexes_a_table_without_index(spark, late):
    from featurestats.operators.layout import write_events

    fact, path = event_table(spark, SF_SMALL), work_path(spark, "t_build")
    write_events(fact, path)
    index = ArrivalIndex(spark, path)
    assert not index.exists()
    index.build(read_events(spark, path))
    assert sum(r.n_rows for r in index.tokens().collect()) == fact.count()


def test_stale_days_are_never_complete_without_their_rows(spark):
    fact, path = event_table(spark, SF_SMALL), work_path(spark, "t_stale")
    day = dt.date(2024, 1, 9)
    append_live(fact, path)
    events = read_events(spark, path)
    rollup = RollupTable(spark, CUBE, work_path(spark, "t_stale_rollup"), ArrivalIndex(spark, path))
    assert len(rollup.refresh_stale(events)) == 30 and rollup.stale_days() == set()
    append_live(fact.where(F.to_date("eventTime") == F.lit(day)).limit(3), path)
    assert rollup.stale_days() == {day}
    events = read_events(spark, path)
    got = rollup.stats(events, AS_OF, 30)
    assert rows_of(got.drop("source")) == rows_of(window_stats(events, CUBE, AS_OF, 30).drop("source"))
    alone = rollup.stats(None, AS_OF, 30).collect()
    assert {(r.actual_days, r.coverage_status) for r in alone} == {(29, "PARTIAL")}
    assert rollup.refresh_stale(events) == [day] and rollup.refresh_stale(events) == []
    assert {r.coverage_status for r in rollup.stats(None, AS_OF, 30).collect()} == {"COMPLETE"}


def test_days_pending_by_the_stream_log_are_raw_days(spark):
    """Without an index the stream's log of affected days says what is stale."""
    fact = event_table(spark, SF_SMALL)
    rollup = RollupTable(spark, CUBE, work_path(spark, "t_affected"))
    rollup.refresh(fact, [dt.date(2024, 1, d) for d in range(1, 31)])
    log = spark.createDataFrame([(dt.date(2024, 1, 9), dt.datetime(2100, 1, 1))], "stat_date date, arrived_at timestamp")
    more = fact.unionByName(fact.where("to_date(eventTime) = DATE '2024-01-09'"))
    assert rows_of(rollup.stats(more, AS_OF, 30, affected=log).drop("source")) == rows_of(window_stats(more, CUBE, AS_OF, 30).drop("source"))


def test_added_feature_sees_the_rows_of_stale_days(spark):
    fact, path = event_table(spark, SF_SMALL), work_path(spark, "t_added")
    append_live(fact, path)
    rollup = RollupTable(spark, CUBE, work_path(spark, "t_added_rollup"), ArrivalIndex(spark, path))
    rollup.refresh_stale(read_events(spark, path))
    append_live(fact.limit(5), path)
    events = read_events(spark, path)
    wider = Cube("c", CUBE.dimension, ("txn_amount", "score"), CUBE.measures)
    fresh = rollup.rebuild(events, wider)
    assert rows_of(fresh.stats(None, AS_OF, 30)) == rows_of(window_stats(events, wider, AS_OF, 30).withColumn("source", F.lit("rollup")))


def test_rebuild_with_null_event_times(spark):
    fact = event_table(spark, SF_SMALL).withColumn("eventTime", F.when(F.col("eventId") != "3", F.col("eventTime")))
    rollup = RollupTable(spark, CUBE, work_path(spark, "t_null_time"))
    rollup.refresh(fact, [r[0] for r in fact.select(F.to_date("eventTime")).distinct().collect()])
    fresh = rollup.rebuild(fact, Cube("c", Dimension("all", "'x'"), CUBE.features, CUBE.measures))
    assert sum(r.n_rows for r in fresh.states().collect()) == fact.count() - 1


def test_an_index_by_another_time_is_refused(spark, late):
    events = read_events(spark, late)
    by_arrival = Cube("c", CUBE.dimension, ("txn_amount",), ("count",), time_col="processingTime")
    with pytest.raises(ValueError, match="arrival index is by eventTime"):
        window_stats(events, by_arrival, AS_OF, 7, arrivals=ArrivalIndex(spark, late))
