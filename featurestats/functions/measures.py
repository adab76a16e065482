"""Cube measures M1-M9 as mergeable states.

Each measure is stored as one or more *state* columns per
``(stat_date, segment_value)`` (partial aggregate), merged over a window of
days, then finalised.  All three steps are built-in aggregate expressions, so
Spark runs them as partial + final hash aggregation (map-side combine) and a
hot segment never concentrates raw rows in one task.

State column names in a rollup are ``<feature>__<state>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEASURES = (
    "count",
    "sum",
    "min",
    "max",
    "mean",
    "std",
    "p50",
    "p90",
    "p95",
    "p99",
    "distinct_count",
    "missing_count",
)
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
NUMERIC_MEASURES = {"sum", "mean", "std", "p50", "p90", "p95", "p99"}

# state columns each measure needs
NEEDS = {
    "count": ("cnt",),
    "sum": ("sum_val",),
    "min": ("min_val",),
    "max": ("max_val",),
    "mean": ("sum_val", "cnt"),
    "std": ("sum_val", "sum_sq", "cnt"),
    "p50": ("pct_state", "cnt"),
    "p90": ("pct_state", "cnt"),
    "p95": ("pct_state", "cnt"),
    "p99": ("pct_state", "cnt"),
    "distinct_count": ("hll_state",),
    "missing_count": ("missing_cnt",),
}
STATE_ORDER = ("cnt", "sum_val", "min_val", "max_val", "sum_sq", "missing_cnt", "pct_state", "hll_state")
HLL_LG_K = 12  # one value for stored and on-the-fly states, so unions are legal


def states_for(measures) -> list[str]:
    unknown = set(measures) - set(MEASURES)
    if unknown:
        raise ValueError(f"unknown measures: {sorted(unknown)}")
    need = {s for m in measures for s in NEEDS[m]}
    return [s for s in STATE_ORDER if s in need]


def state_name(feature: str, state: str) -> str:
    return f"{feature}__{state}"


def state_exprs(feature: str, value: Column, states) -> list[Column]:
    """Partial-aggregate expressions for one feature (rollup build, C3)."""
    x = value.cast("double")
    out = []
    for s in states:
        if s == "cnt":
            e = F.count(value)
        elif s == "sum_val":
            e = F.sum(x)
        elif s == "min_val":
            e = F.min(value)
        elif s == "max_val":
            e = F.max(value)
        elif s == "sum_sq":
            e = F.sum(x * x)  # cast before squaring: integer overflow raises under ANSI
        elif s == "missing_cnt":
            e = F.count_if(value.isNull())
        elif s == "pct_state":
            e = F.kll_sketch_agg_double(x)
        elif s == "hll_state":
            e = F.hll_sketch_agg(value.cast("string"), HLL_LG_K)
        else:  # pragma: no cover
            raise ValueError(s)
        out.append(e.alias(state_name(feature, s)))
    return out


def merge_exprs(feature: str, states) -> list[Column]:
    """Merge daily states over a window."""
    out = []
    for s in states:
        c = F.col(state_name(feature, s))
        if s in ("cnt", "sum_val", "sum_sq", "missing_cnt"):
            e = F.sum(c)
        elif s == "min_val":
            e = F.min(c)
        elif s == "max_val":
            e = F.max(c)
        elif s == "pct_state":
            e = F.kll_merge_agg_double(c)
        elif s == "hll_state":
            e = F.hll_union_agg(c)
        else:  # pragma: no cover
            raise ValueError(s)
        out.append(e.alias(state_name(feature, s)))
    return out


def final_exprs(feature: str, measures, prefix: str = "") -> list[Column]:
    """Finalise merged states into measure values (names ``<prefix><measure>``)."""

    def st(s):
        return F.col(state_name(feature, s))

    out = []
    for m in measures:
        if m == "count":
            e = F.coalesce(st("cnt"), F.lit(0)).cast("bigint")
        elif m == "sum":
            e = st("sum_val")
        elif m == "min":
            e = st("min_val")
        elif m == "max":
            e = st("max_val")
        elif m == "mean":
            e = F.try_divide(st("sum_val"), st("cnt").cast("double"))
        elif m == "std":
            mean = F.try_divide(st("sum_val"), st("cnt").cast("double"))
            var = F.try_divide(st("sum_sq"), st("cnt").cast("double")) - mean * mean
            e = F.sqrt(F.greatest(var, F.lit(0.0)))
        elif m in PERCENTILES:
            e = F.when(
                st("cnt") > 0, F.kll_sketch_get_quantile_double(st("pct_state"), F.lit(PERCENTILES[m]))
            )
        elif m == "distinct_count":
            e = F.coalesce(F.hll_sketch_estimate(st("hll_state")), F.lit(0)).cast("bigint")
        elif m == "missing_count":
            e = F.coalesce(st("missing_cnt"), F.lit(0)).cast("bigint")
        else:  # pragma: no cover
            raise ValueError(m)
        out.append(e.alias(f"{prefix}{m}"))
    return out
