"""Cube measures, rollups and window statistics."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from featurestats.plans.cube import Cube, Dimension, validate
from featurestats.plans.rollup import RollupTable, build_states, day_ranges, rollup_status
from featurestats.plans.stats import plan_days, window_stats
from featurestats.session import work_path
from featurestats.sources.fixtures import event_table

from paths import SF_SMALL

DIM = Dimension("kind", "CASE WHEN eventType = 'purchase' THEN 'buy' ELSE 'other' END")
EXACT = ("count", "sum", "min", "max", "mean", "std", "missing_count")
CUBE = Cube("c", DIM, ("txn_amount", "score"), EXACT)
AS_OF = dt.date(2024, 1, 31)
JAN = [dt.date(2024, 1, d) for d in range(1, 31)]


def _rows(df):
    out = {}
    for r in df.collect():
        out[(r.feature, r.segment_value)] = tuple(
            round(v, 6) if isinstance(v, float) else v for v in (r["count"], r["sum"], r["min"], r["max"], r["mean"], r["std"], r["missing_count"])
        )
    return out


def _direct(fact):
    rows = {}
    for f in ("txn_amount", "score"):
        agg = fact.where(F.col("eventTime") < F.lit(dt.datetime(2024, 1, 31))).groupBy(DIM.segment().alias("s")).agg(
            F.count(f), F.sum(F.col(f).cast("double")), F.min(F.col(f).cast("double")), F.max(F.col(f).cast("double")),
            F.avg(f), F.stddev_pop(f), F.count_if(F.col(f).isNull()))
        for r in agg.collect():
            rows[(f, r[0])] = tuple(round(v, 6) if isinstance(v, float) else v for v in r[1:])
    return rows


def test_day_ranges():
    d = [dt.date(2024, 1, x) for x in (1, 2, 3, 7, 9, 10)]
    assert day_ranges(d) == [(dt.date(2024, 1, 1), dt.date(2024, 1, 4)), (dt.date(2024, 1, 7), dt.date(2024, 1, 8)),
                             (dt.date(2024, 1, 9), dt.date(2024, 1, 11))]


def test_plan_days_window_and_clamp():
    w, r, raw = plan_days(AS_OF, 30, JAN[:10], max_raw_days=5)
    assert len(w) == 30 and w[0] == dt.date(2024, 1, 1) and w[-1] == dt.date(2024, 1, 30)
    assert r == JAN[:10] and raw == JAN[-5:]
    w, _, _ = plan_days(AS_OF, 30, reference_mode=True)
    assert len(w) == 31  # inclusive BETWEEN of the reference


@settings(max_examples=5, deadline=None)
@given(st.sets(st.integers(min_value=0, max_value=29)))
def test_any_split_of_days_gives_direct_answer(spark, rollup_idx):
    fact = event_table(spark, SF_SMALL)
    rollup_days = [JAN[i] for i in sorted(rollup_idx)]
    rollup = build_states(fact, CUBE, rollup_days) if rollup_days else None
    got = window_stats(fact, CUBE, AS_OF, 30, rollup=rollup, rollup_days=rollup_days)
    meta = got.select("actual_days", "coverage", "coverage_status").distinct().collect()
    assert [tuple(m) for m in meta] == [(30, 1.0, "COMPLETE")]
    g, d = _rows(got), _direct(fact)
    assert g.keys() == d.keys()
    for k in g:
        for a, b in zip(g[k], d[k]):
            assert (a is None and b is None) or abs(a - b) < 1e-6, (k, g[k], d[k])


def test_refresh_idempotent_and_status(spark):
    fact = event_table(spark, SF_SMALL)
    t = RollupTable(spark, CUBE, work_path(spark, "t_rollup"))
    t.refresh(fact, JAN[:5])
    first = sorted(tuple(r) for r in t.states().select("stat_date", "segment_value", "n_rows").collect())
    t.refresh(fact, JAN[2:5])
    again = sorted(tuple(r) for r in t.states().select("stat_date", "segment_value", "n_rows").collect())
    assert first == again
    s = rollup_status(t.ledger(), JAN[:7]).first()
    assert (s.expected_days, s.active_days, s.missing_days, s.status) == (7, 5, 2, "CREATING")


def test_sketch_measures_close_to_exact(spark):
    fact = event_table(spark, SF_SMALL)
    cube = Cube("s", DIM, ("txn_amount",), ("count", "p50", "distinct_count"))
    got = {r.segment_value: r for r in window_stats(fact, cube, AS_OF, 30).collect()}
    exact = fact.groupBy(DIM.segment().alias("s")).agg(
        F.percentile("txn_amount", 0.5).alias("p50"), F.count_distinct("txn_amount").alias("d"))
    for r in exact.collect():
        assert abs(got[r.s].distinct_count - r.d) <= max(2, 0.05 * r.d)
        assert abs(got[r.s].p50 - r.p50) <= 0.1 * abs(r.p50) + 1


def test_validate(spark):
    fact = event_table(spark, SF_SMALL)
    ok = validate(Cube("v", DIM, ("txn_amount",), ("count", "mean")), fact)
    assert ok.ok
    bad = validate(Cube("v", Dimension("d", "no_such_col + 1"), ("country", "missing"), ("mean", "bogus")), fact)
    assert not bad.ok and len(bad.errors) == 4


def test_rollup_table_serves_before_and_after_refresh(spark):
    fact = event_table(spark, SF_SMALL)
    t = RollupTable(spark, CUBE, work_path(spark, "t_serve"))
    before = t.stats(fact, AS_OF, 30)  # no rollup yet → raw
    assert {r.source for r in before.collect()} == {"raw"}
    t.refresh(fact, JAN[:10])
    after = t.stats(fact, AS_OF, 30)
    assert {r.source for r in after.collect()} == {"hybrid"}
    assert _rows(before) == _rows(after)


def test_rollup_days_without_rollup_are_raw(spark):
    fact = event_table(spark, SF_SMALL)
    a = window_stats(fact, CUBE, AS_OF, 30, rollup=None, rollup_days=JAN)
    assert {r.source for r in a.collect()} == {"raw"}
    assert _rows(a) == _direct(fact)


def test_refresh_keeps_other_tenants(spark):
    fact = event_table(spark, SF_SMALL)
    path = work_path(spark, "t_tenants")
    a = RollupTable(spark, Cube("c", DIM, ("txn_amount",), ("count",), tenant="a"), path)
    b = RollupTable(spark, Cube("c", DIM, ("txn_amount",), ("count",), tenant="b"), path)
    a.refresh(fact, JAN[:3])
    b.refresh(fact, JAN[:3])
    a.refresh(fact, JAN[1:2])  # a re-refresh of tenant a must not drop tenant b's rows
    per = {r.tenant: r["count"] for r in a.states().groupBy("tenant").count().collect()}
    assert per["a"] == per["b"] > 0


def test_ledger_per_tenant(spark):
    fact = event_table(spark, SF_SMALL)
    path = work_path(spark, "t_ledger_tenants")
    a = RollupTable(spark, Cube("c", DIM, ("txn_amount",), ("count",), tenant="a"), path)
    b = RollupTable(spark, Cube("c", DIM, ("txn_amount",), ("count",), tenant="b"), path)
    a.refresh(fact, JAN[:3])
    b.refresh(fact, JAN[:1])
    assert a.active_days() == JAN[:3] and b.active_days() == JAN[:1]
