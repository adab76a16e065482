"""Filters and partition pruning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrivals import ArrivalIndex


def _ts(d) -> dt.datetime:
    if isinstance(d, dt.datetime):
        return d
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return dt.datetime.combine(d, dt.time())


def day_slice(col: str, day) -> Column:
    """half-open ``[day, day + 1)`` on a timestamp column (pushable)."""
    lo = _ts(day)
    return (F.col(col) >= F.lit(lo)) & (F.col(col) < F.lit(lo + dt.timedelta(days=1)))


def time_range(col: str, lo, hi) -> Column:
    return (F.col(col) >= F.lit(_ts(lo))) & (F.col(col) < F.lit(_ts(hi)))


def event_partition_values(lo, hi, slack_days: int = 7, period: str = "month") -> list[str]:
    """Event partitions (``yyyyMM`` or ``yyyyMMdd``) that can hold rows processed
    in ``[lo, hi)`` when event time is within ``slack_days`` of processing time."""
    first = (_ts(lo) - dt.timedelta(days=slack_days)).date()
    last = (_ts(hi) + dt.timedelta(days=slack_days)).date()
    out, d = [], first
    while d <= last:
        out.append(d.strftime("%Y%m%d" if period == "day" else "%Y%m"))
        d += dt.timedelta(days=1)
    return sorted(set(out))


def with_event_partition_bounds(
    df: DataFrame,
    lo,
    hi,
    proc_col: str = "processingTime",
    event_part_col: str = "event_month",
    slack_days: int = 7,
    period: str = "month",
    proc_is_epoch_ms: bool = False,
    arrivals: ArrivalIndex | None = None,
) -> DataFrame:
    """filter on processing time, plus a predicate on the *event* partition
    column derived from the processing range widened by ``slack_days``.  Event
    time trails processing time by a bounded gap, so no matching row lives
    outside those partitions and Spark prunes the others (``PartitionFilters``
    in the plan).  ``slack_days`` must cover the measured arrival gap
    (``arrival_gap_profile``); with ``arrivals``, an arrival index of the rows, the event days are exactly those that the
    range holds, and no gap is assumed."""
    if arrivals is None:
        parts, part = event_partition_values(lo, hi, slack_days, period), F.col(event_part_col).cast("string")
        held = part.isin(parts)
    else:
        days, undated = arrivals.events_between(_ts(lo).date(), (_ts(hi) - dt.timedelta(microseconds=1)).date() + dt.timedelta(days=1))
        form = "%Y%m%d" if period == "day" else "%Y%m"
        held = F.col(event_part_col).cast("string").isin(sorted({d.strftime(form) for d in days}))
        held = held | F.col(event_part_col).isNull() if undated else held
    if proc_is_epoch_ms:
        lo_ms = int(_ts(lo).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        hi_ms = int(_ts(hi).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        proc_pred = (F.col(proc_col) >= lo_ms) & (F.col(proc_col) < hi_ms)
    else:
        proc_pred = time_range(proc_col, lo, hi)
    return df.where(held & proc_pred)


def distinct_periods(df: DataFrame, col: str, fmt: str = "yyyyMM") -> DataFrame:
    """distinct periods (default year-month) of a timestamp column."""
    return df.select(F.date_format(F.col(col), fmt).alias("period")).distinct()


def pruning_parity(pruned: DataFrame, full: DataFrame) -> DataFrame:
    """counts with and without the derived partition predicate; equal when
    the slack is wide enough."""
    a = pruned.agg(F.count(F.lit(1)).alias("pruned_count"))
    b = full.agg(F.count(F.lit(1)).alias("full_count"))
    return a.select(
        "pruned_count", b.select("full_count").scalar().alias("full_count")
    ).select("pruned_count", "full_count", (F.col("pruned_count") == F.col("full_count")).alias("parity"))


def parity_by_day(df: DataFrame, proc_day: Column, event_day: Column, slack_days: int) -> DataFrame:
    """F3 for every day in one pass: rows whose event partition is within ``slack_days`` of the processing day (those a
    pruned read finds) against all rows of the day."""
    near = event_day.between(F.date_sub(proc_day, slack_days), F.date_add(proc_day, slack_days))
    days = df.groupBy(proc_day.alias("day")).agg(F.count_if(near).alias("pruned_count"), F.count(F.lit(1)).alias("full_count"))
    return days.select("day", "pruned_count", "full_count", (F.col("pruned_count") == F.col("full_count")).alias("parity"))


def skip_done(units: DataFrame, ledger: DataFrame, unit_col: str = "unit") -> DataFrame:
    """units without a DONE entry in the ledger (latest state wins)."""
    done = latest_state(ledger, unit_col).where(F.col("state") == "DONE").select(unit_col)
    return units.join(done, unit_col, "left_anti")


def latest_state(ledger: DataFrame, unit_col: str = "unit") -> DataFrame:
    """Latest ``state`` per unit by ``updated_at`` (append-only ledger)."""
    return ledger.groupBy(unit_col).agg(
        F.max_by("state", F.struct("updated_at", "state")).alias("state"),
        F.max_by("rows", F.struct("updated_at", "state")).alias("rows"),
        F.max("updated_at").alias("updated_at"),
    )
