"""One event table for live and backfilled rows.

Every writer tags its rows with ``_load_unit`` (``live``, ``day-<day>``, ``file-<export>``), the last level of the table's
partitioning.  A unit is replaced by a dynamic overwrite of its own directories, so rows of other writers in the same day
are never read, rewritten or lost, and directories that the unit no longer fills are removed.

``schema_log.fit`` brings rows to the table's types first: fixed columns have fixed types; another column keeps the type it
has in the table.  Values of a type that doesn't fit that one without loss go to a side column ``<name>__<type>``, which
``read_table`` merges back, so that a changed feature type never makes the table unreadable.

Every write is entered in the arrival index (``arrivals``): announced or counted before, marked after.
"""

from __future__ import annotations

import datetime as dt
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_path, path_exists
from .arrivals import LIVE, ArrivalIndex, count_arrivals
from .layout import read_events, with_layout_columns, write_events
from .schema_log import LOAD_UNIT, PARTITION_COLS, SIDE, fits

def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table with its side columns merged: a column takes the widest type seen, text if none holds all."""
    df = read_events(spark, path)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    sides: dict[str, list[str]] = {}
    for name in types:
        base, _, kind = name.rpartition(SIDE)
        if base in types and types[name] == kind:
            sides.setdefault(base, []).append(name)
    if not sides:
        return df
    out = []
    for name in df.columns:
        if any(name in own for own in sides.values()):
            continue
        parts = [name, *sides.get(name, [])]
        wide = next((types[w] for w in parts if all(fits(types[p], types[w]) for p in parts)), "string")
        cols = [F.col(f"`{p}`") if types[p] == wide else F.col(f"`{p}`").cast(wide) for p in parts]
        out.append((F.coalesce(*cols) if len(cols) > 1 else cols[0]).alias(name))
    return df.select(*out)


def append_live(rows: DataFrame, path: str, entry: str | None = None, counts: DataFrame | None = None) -> None:
    """Append streamed rows (unit ``live``).  ``entry`` names the write in the arrival index (a batch that is replayed
    keeps its name); ``counts``: its (processing_day, event_day, n_rows) where they are known."""
    spark = rows.sparkSession
    rows = with_layout_columns(rows) if PARTITION_COLS[0] not in rows.columns else rows
    rows = rows.withColumn(LOAD_UNIT, F.lit(LIVE))
    entry = entry or f"append-{uuid.uuid4().hex}"
    index = ArrivalIndex(spark, path)
    index.record(entry, count_arrivals(rows) if counts is None else counts.withColumn("load_unit", F.lit(LIVE)))
    write_events(rows, path, mode="append")
    index.mark(entry, [LIVE])


def unit_directories(spark: SparkSession, path: str, units, days=None) -> dict[str, frozenset[str]]:
    """directory -> file names of the directories that hold ``units``, of the whole table or of some processing days."""
    names = ["*"] if days is None else ["__HIVE_DEFAULT_PARTITION__" if d is None else str(d) for d in days]
    wanted, found = set(units), {}
    tail = quote(next(iter(wanted)), safe="-_.") if len(wanted) == 1 else "*"
    for day in names:
        fs, root = hadoop_path(spark, f"{path.rstrip('/')}/{PARTITION_COLS[0]}={day}/{PARTITION_COLS[1]}=*/{LOAD_UNIT}={tail}")
        for status in fs.globStatus(root) or []:
            name = unquote(status.getPath().getName().partition("=")[2])
            if name in wanted:
                found[status.getPath().toString()] = frozenset(s.getPath().getName() for s in fs.listStatus(status.getPath()))
    return found


def unit_days(spark: SparkSession, path: str, units) -> list[dt.date | None]:
    """The processing days in which the index has ``units`` (written, or announced by a run that did not end)."""
    mine = ArrivalIndex(spark, path).entries().where(F.col("load_unit").isin(list(units)))
    return [r[0] for r in mine.select("processing_day").distinct().collect()]


def replace_units(rows: DataFrame, path: str, units, processing_days=None) -> None:
    """Make ``rows`` (tagged with ``_load_unit``) all that the table holds of ``units``.

    ``processing_days``: those that the rows may have, where the caller knows.  Only the days that hold the units now or
    may hold them then are listed.  New directories are committed first; a directory whose files are the same as before was
    not written and is removed.  The arrival index is told before, and gets the counts, read from the new directories, after.
    A crash in between leaves the unit undone in the ledger, and the next run ends the work."""
    spark, units = rows.sparkSession, sorted(units)
    index, entry = ArrivalIndex(spark, path), f"replace-{uuid.uuid4().hex}"
    listed = None if processing_days is None else sorted({*processing_days, *unit_days(spark, path, units)}, key=str)
    before = unit_directories(spark, path, units, listed) if path_exists(spark, path) else {}
    index.announce(entry, units, listed)
    rows = with_layout_columns(rows) if PARTITION_COLS[0] not in rows.columns else rows
    write_events(rows, path, mode="overwrite")
    after = unit_directories(spark, path, units, listed) if path_exists(spark, path) else {}
    for directory, files in before.items():
        if after.get(directory) == files:
            fs, target = hadoop_path(spark, directory)
            fs.delete(target, True)
    if path_exists(spark, path):
        held = read_events(spark, path).where(F.col(LOAD_UNIT).isin(units))
        if listed is not None:
            known = [d for d in listed if d is not None]
            held = held.where(F.col(PARTITION_COLS[0]).isin(known) | (F.col(PARTITION_COLS[0]).isNull() if len(known) < len(listed) else F.lit(False)))
        index.record(entry, count_arrivals(held))
    index.mark(entry, units)
