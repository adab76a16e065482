"""The dyadic tree of day blocks, and dimensions derived from stored states."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from featurestats.operators.arrivals import ArrivalIndex
from featurestats.operators.layout import read_events
from featurestats.operators.store import append_live
from featurestats.plans.cube import Cube, Dimension
from featurestats.plans.dyadic import DyadicRollup, cover, day_number, days_of
from featurestats.plans.rollup import RollupTable
from featurestats.plans.stats import window_stats
from featurestats.session import work_path
from featurestats.sources.fixtures import event_table
from paths import SF_SMALL

FIRST, LAST = dt.date(2022, 1, 1), dt.date(2024, 1, 31)
CUBE = Cube("long", Dimension("seg", "CASE WHEN g < 2 THEN concat('s', g) END"), ("x",), ("count", "sum", "min", "max", "mean", "p50", "distinct_count"))


def rows_of(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def fact(spark):
    """Two years with two segments and NULL; some days have no rows of a segment."""
    n = (LAST - FIRST).days
    path = work_path(spark, "t_two_years")
    day = F.expr("timestampadd(DAY, CAST(id % {n} AS INT), TIMESTAMP '2022-01-01 01:00:00')".format(n=n))
    spark.range(6 * n).select(day.alias("eventTime"), ((F.col("id") * 7919) % 3).alias("g"), ((F.col("id") * 31) % 101).cast("double").alias("x")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def table(spark, fact):
    t = DyadicRollup(spark, CUBE, work_path(spark, "t_dyadic"))
    t.refresh(fact, [FIRST + dt.timedelta(days=k) for k in range((LAST - FIRST).days)])
    return t


def test_cover_is_a_partition_with_few_blocks():
    draw = random.Random(5)
    every = {(k, b) for k in range(1, 9) for b in range(day_number(FIRST) >> k, (day_number(LAST) >> k) + 1)}
    for _ in range(200):
        a = FIRST + dt.timedelta(days=draw.randrange(700))
        days = [a + dt.timedelta(days=k) for k in range(draw.randrange(1, 760)) if a + dt.timedelta(days=k) < LAST]
        usable = every if draw.random() < 0.5 else {x for x in every if draw.random() < 0.7}
        blocks, left = cover(days, usable)
        assert sorted([d for k, b in blocks for d in days_of(k, b)] + left) == days
        if usable is every:
            assert len(blocks) + len(left) <= 2 * 9 + len(days) // 256


@pytest.mark.parametrize("n", [1, 7, 30, 180, 730])
def test_windows_equal_the_merge_of_all_days(table, fact, n):
    exact = ["feature", "segment_value", "count", "sum", "min", "max", "mean", "distinct_count", "active_days", "actual_days", "coverage_status", "source"]
    flat = RollupTable(table.spark, CUBE, table.path).stats(None, LAST, n)
    assert rows_of(table.stats(None, LAST, n).select(exact)) == rows_of(flat.select(exact))


def test_long_windows_read_few_states(table):
    for n in (180, 730):
        blocks, days, raw = table.plan(LAST, n)
        assert raw == [] and len(blocks) + len(days) <= 2 * n.bit_length()
        assert table.window_states(blocks, days).count() <= 3 * 2 * n.bit_length()


def test_a_refresh_renews_its_ancestors_only(spark, fact):
    t = DyadicRollup(spark, CUBE, work_path(spark, "t_ancestors"), levels=5)
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=k) for k in range(64)]
    t.refresh(fact, days)
    before = t.usable_blocks()
    ledger = lambda: {(r.level, r.block): r.at for r in spark.read.parquet(t.block_ledger_path).groupBy("level", "block").agg(F.max("at").alias("at")).collect()}
    old = ledger()
    more = fact.unionByName(fact.where(F.to_date("eventTime") == F.lit(days[20])))
    t.refresh(more, [days[20]])
    new = ledger()
    mine = {(k, day_number(days[20]) >> k) for k in range(1, 6)}
    assert {x for x in new if new[x] != old.get(x)} <= mine and t.usable_blocks() == before
    end = days[-1] + dt.timedelta(days=1)
    assert rows_of(t.stats(None, end, 64)) == rows_of(window_stats(more, CUBE, end, 64).withColumn("source", F.lit("rollup")))
    # The days are refreshed, the run dies before the blocks: they do not serve.
    RollupTable.refresh(t, fact, [days[20]])
    assert t.usable_blocks() == before - mine
    got = t.stats(None, end, 64).select("segment_value", "count", "sum")
    assert rows_of(got) == rows_of(window_stats(fact, CUBE, end, 64).select("segment_value", "count", "sum"))


def test_missing_and_stale_days_are_not_covered_by_blocks(spark):
    base, path = event_table(spark, SF_SMALL), work_path(spark, "t_dyadic_late")
    append_live(base, path)
    cube = Cube("c", Dimension("t", "eventType", type="column"), ("txn_amount",), ("count", "sum"))
    t = DyadicRollup(spark, cube, work_path(spark, "t_dyadic_stale"), ArrivalIndex(spark, path), levels=4)
    t.refresh_stale(read_events(spark, path))
    day = dt.date(2024, 1, 10)
    append_live(base.where(F.to_date("eventTime") == F.lit(day)).limit(2), path)
    blocks, days, raw = t.plan(dt.date(2024, 1, 31), 30)
    assert raw == [day] and all(day not in days_of(k, b) for k, b in blocks)
    events = read_events(spark, path)
    assert rows_of(t.stats(events, dt.date(2024, 1, 31), 30).drop("source")) == rows_of(window_stats(events, cube, dt.date(2024, 1, 31), 30).drop("source"))
    assert {r.coverage_status for r in t.stats(None, dt.date(2024, 1, 31), 30).collect()} == {"PARTIAL"}


def _by_type(spark, fact, name, measures=("count", "sum", "min", "p50")):
    cube = Cube("c", Dimension("t", "eventType", type="column"), ("txn_amount", "score"), measures)
    t = RollupTable(spark, cube, work_path(spark, name))
    t.refresh(fact, [r[0] for r in fact.select(F.to_date("eventTime")).distinct().collect()])
    return t


def test_coarser_dimension_is_merged_without_the_fact_table(spark):
    fact = event_table(spark, SF_SMALL)
    t = _by_type(spark, fact, "t_coarse")
    new = Cube("c", Dimension("g", "CASE WHEN eventType IN ('click', 'view') THEN 'look' WHEN eventType <> 'error' THEN 'act' END"),
               ("txn_amount",), ("count", "sum", "min"))
    mapping = t.coarser(fact, new)
    assert mapping is not None and "events" not in mapping._jdf.queryExecution().executedPlan().toString()
    fresh = t.rebuild(fact, new)
    assert "__coarser-" in fresh.path
    assert rows_of(fresh.stats(None, dt.date(2024, 1, 31), 30)) == rows_of(
        window_stats(fact, new, dt.date(2024, 1, 31), 30).withColumn("source", F.lit("rollup")))


def test_a_dimension_that_is_no_function_is_recomputed(spark):
    fact = event_table(spark, SF_SMALL)
    t = _by_type(spark, fact, "t_no_function")
    for segment, measures in (("country", ("count", "sum")), ("eventType", ("count", "max")), ("CASE WHEN score > 2 THEN eventType END", ("count",))):
        new = Cube("c", Dimension("g", segment), ("txn_amount",), measures)
        assert t.coarser(fact, new) is None
    fresh = t.rebuild(fact, Cube("c", Dimension("g", "country"), ("txn_amount",), ("count", "sum")))
    assert "__full-" in fresh.path and sum(r.n_rows for r in fresh.states().collect()) == fact.count()


def test_coarser_adds_the_days_that_were_not_stored(spark):
    fact = event_table(spark, SF_SMALL)
    t = RollupTable(spark, Cube("c", Dimension("t", "eventType", type="column"), ("txn_amount",), ("count", "sum")), work_path(spark, "t_some_days"))
    t.refresh(fact, [dt.date(2024, 1, d) for d in range(1, 11)])
    fresh = t.rebuild(fact, Cube("c", Dimension("all", "'x'"), ("txn_amount",), ("count", "sum")))
    assert len(fresh.active_days()) == 30 and sum(r.n_rows for r in fresh.states().collect()) == fact.count()
