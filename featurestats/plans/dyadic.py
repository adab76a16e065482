"""Rollups with a dyadic tree of days (C8): long windows from few states.

Beside its daily states the table holds states merged over aligned blocks of 2, 4, 8 ... days (level k: days d with the same
``d >> k``, counted from 1970-01-01).  A window of N days is cut into at most about 2 log2 N blocks, so 180 days read
some ten states for each segment instead of 180.  Refreshing a day recomputes the blocks above it, one for each level, from
their two halves.

A block counts only if all its days are refreshed, and none since it was made (its ledger row keeps the newest refresh it has
seen); otherwise its halves, and in the end the days, serve.  So a crash between the days and their blocks costs
speed, not truth.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import merge_exprs, states_for
from ..operators.arrivals import date_in_days
from ..session import path_exists
from .rollup import RollupTable
from .stats import finish_states, plan_days, raw_states

EPOCH = dt.date(1970, 1, 1)
BLOCK_LEDGER = "rollup string, level int, block long, seen timestamp, at timestamp"
#: Blocks of a level that share a folder: what a refresh of one of them rewrites.
CHUNK = 32


def day_number(day: dt.date) -> int:
    return (day - EPOCH).days


def days_of(level: int, block: int) -> list[dt.date]:
    first = block << level
    return [EPOCH + dt.timedelta(days=first + k) for k in range(1 << level)]


def cover(days, usable: set[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[dt.date]]:
    """The largest usable (level, block)s within a set of days, and the days that none of them covers."""
    left, blocks = {day_number(d) for d in days}, []
    for level, block in sorted(usable, reverse=True):
        span = range(block << level, (block + 1) << level)
        if span.start in left and all(d in left for d in span):
            blocks.append((level, block))
            left.difference_update(span)
    return sorted(blocks), sorted(EPOCH + dt.timedelta(days=d) for d in left)


@dataclass
class DyadicRollup(RollupTable):
    """A ``RollupTable`` whose windows are served from blocks of days too."""

    levels: int = 8

    @property
    def blocks_path(self) -> str:
        return self.path.rstrip("/") + "__blocks"

    @property
    def block_ledger_path(self) -> str:
        return self.path.rstrip("/") + "__blocks_status"

    def refresh(self, fact: DataFrame, days) -> None:
        super().refresh(fact, days)
        self.refresh_blocks(days)

    def _refreshed(self) -> dict[int, dt.datetime]:
        """day number -> its last refresh, of ACTIVE days that aren't stale (one entry for each day of the table)."""
        stale = self.stale_days()
        rows = self.ledger().where(F.col("status") == "ACTIVE").select("stat_date", "refreshed_at").collect()
        return {day_number(r.stat_date): r.refreshed_at for r in rows if r.stat_date not in stale}

    def _seen(self, level: int, block: int, refreshed: dict[int, dt.datetime]) -> dt.datetime | None:
        """The newest refresh of the block's days, or None if one is missing."""
        span = range(block << level, (block + 1) << level)
        return max(refreshed[d] for d in span) if all(d in refreshed for d in span) else None

    def refresh_blocks(self, days) -> None:
        """Make the complete blocks above these days anew, level by level, each from the states below it."""
        refreshed = self._refreshed()
        for level in range(1, self.levels + 1):
            touched = {day_number(d) >> level for d in days if d is not None}
            todo = {b: seen for b in touched if (seen := self._seen(level, b, refreshed))}
            if todo:
                self._write_blocks(level, todo)

    def _write_blocks(self, level: int, todo: dict[int, dt.datetime]) -> None:
        names, mine = states_for(self.cube.measures), F.col("tenant") == F.lit(self.cube.tenant)
        if level == 1:
            day = F.datediff(F.col("stat_date"), F.lit(EPOCH))
            days = [d for b in todo for d in days_of(1, b)]
            months = sorted({d.strftime("%Y-%m") for d in days})
            below = self.states().where(mine & date_in_days("stat_date", days) & F.col("stat_month").isin(months))
            below = below.withColumn("block", F.shiftright(day, 1).cast("bigint")).withColumn("active_days", F.lit(1).cast("bigint"))
        else:
            halves = [h for b in todo for h in (2 * b, 2 * b + 1)]
            below = self._blocks(level - 1, halves).withColumn("block", F.shiftright("block", 1))
        merged = below.groupBy("tenant", "block", "segment_value").agg(
            F.sum("n_rows").alias("n_rows"), F.sum("active_days").alias("active_days"), *[e for f in self.cube.features for e in merge_exprs(f, names)])
        merged = merged.withColumn("level", F.lit(level)).withColumn("chunk", F.floor(F.col("block") / CHUNK))
        chunks = sorted({b // CHUNK for b in todo})
        if path_exists(self.spark, self.blocks_path):
            old = self.spark.read.parquet(self.blocks_path).where((F.col("level") == level) & F.col("chunk").isin(chunks))
            merged = merged.unionByName(old.where(~(mine & F.col("block").isin(list(todo)))), allowMissingColumns=True)
        # cut lineage: the overwrite replaces files this plan would read
        staged = merged.checkpoint(eager=True)
        (staged.hint("rebalance", "level", "chunk").sortWithinPartitions("block").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("level", "chunk").parquet(self.blocks_path))
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        rows = [(self.ledger_key, level, b, seen, now) for b, seen in sorted(todo.items())]
        self.spark.createDataFrame(rows, BLOCK_LEDGER).coalesce(1).write.mode("append").parquet(self.block_ledger_path)

    def _blocks(self, level: int, blocks) -> DataFrame:
        chunks = sorted({b // CHUNK for b in blocks})
        return self.spark.read.parquet(self.blocks_path).where(
            (F.col("level") == level) & F.col("chunk").isin(chunks) & F.col("block").isin(list(blocks))
            & (F.col("tenant") == F.lit(self.cube.tenant))).drop("level", "chunk")

    def usable_blocks(self) -> set[tuple[int, int]]:
        """(level, block) of blocks that hold what the days hold now."""
        if not path_exists(self.spark, self.block_ledger_path):
            return set()
        refreshed = self._refreshed()
        made = self.spark.read.schema(BLOCK_LEDGER).parquet(self.block_ledger_path).where(F.col("rollup") == self.ledger_key)
        last = made.groupBy("level", "block").agg(F.max_by("seen", "at").alias("seen")).collect()
        return {(r.level, r.block) for r in last if self._seen(r.level, r.block, refreshed) == r.seen}

    def plan(self, as_of, window_days: int) -> tuple[list[tuple[int, int]], list[dt.date], list[dt.date]]:
        """(blocks, stored days, raw days) that a window is served from."""
        stale = self.stale_days()
        active = [d for d in self.active_days() if d not in stale]
        _, stored, raw = plan_days(as_of, window_days, active)
        blocks, days = cover(stored, self.usable_blocks())
        return blocks, days, raw

    def window_states(self, blocks, days) -> DataFrame | None:
        """The stored states of these blocks and days, in one shape."""
        parts = []
        if days:
            daily = self.states().where((F.col("tenant") == F.lit(self.cube.tenant)) & date_in_days("stat_date", days))
            months = sorted({d.strftime("%Y-%m") for d in days})
            parts.append(daily.where(F.col("stat_month").isin(months)).drop("stat_month", "stat_date").withColumn("active_days", F.lit(1).cast("bigint")))
        by_level: dict[int, list[int]] = {}
        for level, block in blocks:
            by_level.setdefault(level, []).append(block)
        parts += [self._blocks(level, bs).drop("block") for level, bs in by_level.items()]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def stats(self, fact: DataFrame | None, as_of, window_days: int = 30, max_raw_days: int | None = None, long_form: bool = True) -> DataFrame:
        """C8/C10 over blocks, stored days and raw days; equal to the merge of all days."""
        blocks, days, raw = self.plan(as_of, window_days)
        if fact is None:
            raw = []
        elif max_raw_days is not None:
            raw = raw[max(0, len(raw) - max_raw_days):]
        covered = sum(1 << level for level, _ in blocks) + len(days) + len(raw)
        states = self.window_states(blocks, days)
        if raw:
            more = raw_states(fact, self.cube, raw, self.arrivals).drop("stat_date").withColumn("active_days", F.lit(1).cast("bigint"))
            states = more if states is None else states.unionByName(more)
        if states is None:
            raise ValueError("empty window")
        source = "hybrid" if raw and (blocks or days) else "raw" if raw else "rollup"
        return finish_states(states, self.cube, window_days, covered, source, long_form)
