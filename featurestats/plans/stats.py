"""Window statistics with an explicit serve planner (C8-C12, C16, 2.5.1).

``window_stats`` answers a cube over the ``N`` days before ``as_of``:

* days that a rollup has refreshed are read from the stored daily states;
* the remaining days are aggregated from the raw fact table into states of
  the *same* shape (fallback, optionally clamped to the most recent
  ``max_raw_days``);
* both parts are unioned and merged in one ``groupBy(segment_value)``.

So "rollup", "raw" and "hybrid" answers are the same plan shape and give
identical results for the exact measures.  Coverage counts the days that
are actually covered (refreshed or scanned) within ``[as_of - N, as_of)``;
``active_days`` is the per-segment count of days with events.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import final_exprs, merge_exprs, states_for
from ..operators.arrivals import ArrivalIndex, date_in_days
from .cube import Cube
from .rollup import build_states

LONG_TYPES = {
    "count": "bigint",
    "sum": "double",
    "min": "double",
    "max": "double",
    "mean": "double",
    "std": "double",
    "p50": "double",
    "p90": "double",
    "p95": "double",
    "p99": "double",
    "distinct_count": "bigint",
    "missing_count": "bigint",
}


def _as_date(d) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, str):
        return dt.date.fromisoformat(d)
    return d


def plan_days(as_of, window_days: int, rollup_days=(), max_raw_days=None, reference_mode=False):
    """Driver-side plan over day lists (bounded by the window length).

    Returns (window, rollup_part, raw_part)."""
    as_of = _as_date(as_of)
    first = as_of - dt.timedelta(days=window_days)
    last = as_of if reference_mode else as_of - dt.timedelta(days=1)  # reference: BETWEEN, inclusive
    window = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    have = set(_as_date(d) for d in rollup_days)
    rollup_part = [d for d in window if d in have]
    raw_part = [d for d in window if d not in have]
    if max_raw_days is not None and len(raw_part) > max_raw_days:
        raw_part = raw_part[len(raw_part) - max_raw_days :]  # clamp to the most recent days (C12)
    return window, rollup_part, raw_part


def window_stats(
    fact: DataFrame | None,
    cube: Cube,
    as_of,
    window_days: int = 30,
    rollup: DataFrame | None = None,
    rollup_days=(),
    max_raw_days: int | None = None,
    reference_mode: bool = False,
    long_form: bool = True,
    arrivals: ArrivalIndex | None = None,
) -> DataFrame:
    """See the module; ``arrivals``, the event table's arrival index, prunes raw days to the partitions that hold them."""
    if rollup is None:
        rollup_days = ()  # nothing stored to read: every day of the window is raw
    window, rollup_part, raw_part = plan_days(as_of, window_days, rollup_days, max_raw_days, reference_mode)
    parts = []
    if rollup is not None and rollup_part:
        # a rollup table may hold several tenants; partition filter on stat_date
        pred = (F.col("tenant") == F.lit(cube.tenant)) & date_in_days("stat_date", rollup_part)
        if "stat_month" in rollup.columns:  # partition pruning on the stored layout
            pred = pred & F.col("stat_month").isin(sorted({d.strftime("%Y-%m") for d in rollup_part}))
        parts.append(rollup.where(pred).drop("stat_month"))
    if raw_part:
        if fact is None:
            raise ValueError("raw days requested but no fact table given")
        parts.append(raw_states(fact, cube, raw_part, arrivals))
    if not parts:
        raise ValueError("empty window")
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    source = "hybrid" if (rollup_part and raw_part) else ("rollup" if rollup_part else "raw")
    # states hold one row per (stat_date, segment) and the rollup and raw parts cover
    # disjoint days, so counting rows counts active days — a single aggregation
    # instead of a distinct-count (which adds an Expand and a second shuffle)
    states = states.withColumn("active_days", F.lit(1))
    return finish_states(states, cube, window_days, None if reference_mode else len(rollup_part) + len(raw_part), source, long_form)


def raw_states(fact: DataFrame, cube: Cube, days, arrivals: ArrivalIndex | None) -> DataFrame:
    """States of raw days (C11)."""
    return build_states(fact, cube, days, arrivals)


def finish_states(states: DataFrame, cube: Cube, window_days: int, covered: int | None, source: str, long_form: bool = True) -> DataFrame:
    """Merge states (with ``active_days`` each) by segment and finalise them.  ``covered``: days covered for all segments;
    None: each segment's active days (the reference's rule)."""
    st_names = states_for(cube.measures)
    aggs = [F.sum("active_days").alias("active_days")]
    for f in cube.features:
        aggs += merge_exprs(f, st_names)
    merged = states.groupBy("segment_value").agg(*aggs)

    actual = F.col("active_days") if covered is None else F.lit(covered)
    meta = [
        F.col("active_days").cast("bigint").alias("active_days"),
        actual.cast("bigint").alias("actual_days"),
        F.lit(window_days).cast("bigint").alias("window_days"),
        (actual.cast("double") / F.lit(float(window_days))).alias("coverage"),
        F.when(actual >= F.lit(window_days), "COMPLETE").otherwise("PARTIAL").alias("coverage_status"),
        F.lit(source).alias("source"),
    ]
    if not long_form:
        cols = []
        for f in cube.features:
            cols += final_exprs(f, cube.measures, prefix=f"{f}__")
        return merged.select("segment_value", *cols, *meta)
    per_feature = [
        F.struct(
            F.lit(f).alias("feature"),
            *[e.cast(LONG_TYPES[m]).alias(m) for m, e in zip(cube.measures, final_exprs(f, cube.measures))],
        )
        for f in cube.features
    ]
    return merged.select("segment_value", F.inline(F.array(*per_feature)), *meta).select(
        "feature", "segment_value", *cube.measures, "active_days", "actual_days", "window_days", "coverage",
        "coverage_status", "source"
    )
