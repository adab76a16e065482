"""Balanced order-dependent operators vs brute force, with many slices so
that groups and runs cross slice borders."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from featurestats.operators.ordered import exact_percentiles, runs


def test_exact_percentiles_skewed_groups(spark):
    rnd = random.Random(7)
    rows = [("hot", float(rnd.randint(0, 500))) for _ in range(3000)]  # one group holds most rows
    rows += [("g%d" % (i % 5), rnd.random() * 100) for i in range(600)]
    rows += [("g0", None), ("lonely", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p0": 0.0, "p100": 1.0}
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", qs, n_slices=13).collect()}
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert set(got) == set(by)
    for g, vals in by.items():
        assert got[g].n == len(vals)
        for name, q in qs.items():
            assert abs(getattr(got[g], name) - float(np.percentile(vals, q * 100))) < 1e-9, (g, name)


def _brute_runs(rows, min_len):
    out = []
    by = {}
    for g, t, f in sorted(rows):
        by.setdefault(g, []).append((t, f))
    for g, seq in by.items():
        cur = []
        for t, f in seq + [(None, False)]:
            if f:
                cur.append(t)
            else:
                if len(cur) >= min_len:
                    out.append((g, cur[0], cur[-1], len(cur)))
                cur = []
    return sorted(out)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.booleans()), min_size=1, max_size=300),
       st.integers(min_value=1, max_value=17), st.integers(min_value=1, max_value=4))
def test_runs_match_brute_force(spark, flags, n_slices, min_len):
    rows = [(g, i, f) for i, (g, f) in enumerate(flags)]
    df = spark.createDataFrame(rows, "g string, t long, f boolean")
    from pyspark.sql import functions as F

    got = sorted(
        (r.g, r.run_start.t, r.run_end.t, r.run_len)
        for r in runs(df, ["g"], ["t"], F.col("f"), min_len=min_len, n_slices=n_slices).collect()
    )
    assert got == _brute_runs(rows, min_len)


def test_runs_long_streak_over_many_slices(spark):
    from pyspark.sql import functions as F

    rows = [("x", i, 100 <= i < 900) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, t long, f boolean")
    got = [(r.run_start.t, r.run_end.t, r.run_len) for r in runs(df, ["g"], ["t"], F.col("f"), 5, n_slices=20).collect()]
    assert got == [(100, 899, 800)]
