"""The arrival index of an event table: which processing days hold which event days.

Every writer of the table (``store.append_live``, ``store.replace_units``) keeps ``<table>__arrivals``: one row for each load
unit, processing day and event day with its number of rows.  From it follow, exactly and without a scan,

* the processing-day partitions that hold given event days, however late their rows came;
* which stored days of a rollup are stale: a day's token is a hash over its index rows, so any write changes it.

Order of events: an entry's rows are written before the data, and a mark after it.  Rows without a mark are open: they
widen what a reader looks at and make their days stale, so neither a crash nor a write under way hides rows.  A replaced unit
says what it may touch beforehand and counts its rows afterwards; its last marked entry supersedes the earlier ones.
Rows and marks may be written twice (a replayed batch): the index is a set.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_path, path_exists
from .schema_log import LOAD_UNIT

LIVE = "live"
#: ``known`` false: the entry may touch this processing day (NULL: any), event days and counts are not known yet.
ROWS = "entry string, load_unit string, known boolean, processing_day date, event_day date, n_rows bigint, at timestamp"
MARKS = "entry string, load_unit string, at timestamp"
DETAIL = ["entry", "load_unit", "known", "processing_day", "event_day", "n_rows"]


def day_ranges(days) -> list[tuple[dt.date, dt.date]]:
    """Collapse a set of dates into half-open [lo, hi) ranges of consecutive days."""
    out: list[list[dt.date]] = []
    for d in sorted(set(days)):
        if out and out[-1][1] == d:
            out[-1][1] = d + dt.timedelta(days=1)
        else:
            out.append([d, d + dt.timedelta(days=1)])
    return [(a, b) for a, b in out]


def date_in_days(col: str, days) -> F.Column:
    """Range predicate(s) on a DATE column for a set of days (pushable)."""
    pred = None
    for lo, hi in day_ranges(days):
        p = (F.col(col) >= F.lit(lo)) & (F.col(col) < F.lit(hi))
        pred = p if pred is None else (pred | p)
    return pred if pred is not None else F.lit(False)


def count_arrivals(rows: DataFrame, time_col: str = "eventTime") -> DataFrame:
    """(load_unit, processing_day, event_day, n_rows) of rows with the layout columns."""
    unit = F.col(LOAD_UNIT) if LOAD_UNIT in rows.columns else F.lit(LIVE)
    return rows.groupBy(unit.alias("load_unit"), "processing_day", F.to_date(time_col).alias("event_day")).agg(F.count(F.lit(1)).alias("n_rows"))


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass
class ArrivalIndex:
    spark: SparkSession
    table: str
    time_col: str = "eventTime"

    @property
    def rows_path(self) -> str:
        return self.table.rstrip("/") + "__arrivals/rows"

    @property
    def marks_path(self) -> str:
        return self.table.rstrip("/") + "__arrivals/marks"

    def exists(self) -> bool:
        return path_exists(self.spark, self.marks_path)

    # ---- writers -----------------------------------------------------------
    def record(self, entry: str, counts: DataFrame) -> None:
        """Rows of an entry: (load_unit, processing_day, event_day, n_rows)."""
        counts.select(F.lit(entry).alias("entry"), "load_unit", F.lit(True).alias("known"), "processing_day", "event_day",
                      F.col("n_rows").cast("bigint").alias("n_rows"), F.lit(_now()).alias("at")).coalesce(1).write.mode("append").parquet(self.rows_path)

    def announce(self, entry: str, units, processing_days=None) -> None:
        """What an entry may touch, before its rows can be counted; no ``processing_days``: any day."""
        days = [None] if processing_days is None else list(processing_days)
        stamp = _now()
        rows = [(entry, u, False, d, None, 0, stamp) for u in units for d in days]
        self.spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(self.rows_path)

    def mark(self, entry: str, units) -> None:
        """The entry's data is in the table."""
        stamp = _now()
        self.spark.createDataFrame([(entry, u, stamp) for u in units], MARKS).coalesce(1).write.mode("append").parquet(self.marks_path)

    def build(self, rows: DataFrame) -> None:
        """Index a table whose writers kept none, by one narrow scan."""
        entry = f"scan-{uuid.uuid4().hex}"
        counts = count_arrivals(rows, self.time_col).withColumn("load_unit", F.lit(LIVE))
        self.record(entry, counts.groupBy("load_unit", "processing_day", "event_day").agg(F.sum("n_rows").alias("n_rows")))
        self.mark(entry, [LIVE])

    # ---- readers -----------------------------------------------------------
    def entries(self) -> DataFrame:
        """The index rows that count, with ``open``: not yet marked as written."""
        if not path_exists(self.spark, self.rows_path):
            return self.spark.createDataFrame([], ROWS).withColumn("open", F.lit(False)).drop("at")
        rows = self.spark.read.schema(ROWS).parquet(self.rows_path).groupBy(*DETAIL).agg(F.min("at").alias("at"))
        if self.exists():
            marks = self.spark.read.schema(MARKS).parquet(self.marks_path)
        else:
            marks = self.spark.createDataFrame([], MARKS)
        marks = marks.groupBy("entry", "load_unit").agg(F.max("at").alias("marked"))
        last = marks.groupBy(F.col("load_unit").alias("unit")).agg(F.max_by("entry", F.struct("marked", "entry")).alias("last_entry"), F.max("marked").alias("last_at"))
        held = rows.join(marks, ["entry", "load_unit"], "left").join(last, F.col("load_unit") == F.col("unit"), "left")
        replaced = F.col("load_unit") != LIVE
        # A live entry counts for ever; a unit's entries until another one is marked.
        counts = F.when(F.col("marked").isNotNull(), F.col("known") & (~replaced | (F.col("entry") == F.col("last_entry")))).otherwise(
            ~replaced | F.col("last_at").isNull() | (F.col("at") > F.col("last_at")))
        return held.where(counts).select(*DETAIL, F.col("marked").isNull().alias("open"))

    def processing_days(self, event_days) -> list[dt.date | None] | None:
        """The processing days that hold rows of these event days (bounded by the table's age; None among them: the partition
        of rows without one), or None if a write under way may touch any day."""
        mine = date_in_days("event_day", event_days) | ~F.col("known")
        found = self.entries().where(mine).select("known", "processing_day").distinct().collect()
        if any(not r.known and r.processing_day is None for r in found):
            return None
        return sorted({r.processing_day for r in found}, key=lambda d: (d is not None, d or dt.date.min))

    def holds(self, event_days, col: str = "processing_day") -> F.Column:
        """Partition predicate: exactly the processing days that hold these event days."""
        days = self.processing_days(event_days)
        if days is None:
            return F.lit(True)
        pred = date_in_days(col, [d for d in days if d is not None])
        return pred | F.col(col).isNull() if None in days else pred

    def event_days(self, processing_lo=None, processing_hi=None) -> list[dt.date]:
        """Event days of rows that arrived on processing days [lo, hi) (C6; without bounds: all event days)."""
        rows = self.entries().where("event_day IS NOT NULL")
        if processing_lo is not None:
            rows = rows.where(F.col("processing_day") >= F.lit(processing_lo))
        if processing_hi is not None:
            rows = rows.where(F.col("processing_day") < F.lit(processing_hi))
        return sorted(r[0] for r in rows.select("event_day").distinct().collect())

    def events_between(self, processing_lo, processing_hi) -> tuple[list[dt.date], bool]:
        """The event days of rows that arrived on processing days [lo, hi), and whether some have none.  A write under way
        whose rows are not counted yet is refused: its event days are unknown."""
        e = self.entries().where(F.col("processing_day").isNull() | (F.col("processing_day") >= F.lit(processing_lo)) & (F.col("processing_day") < F.lit(processing_hi)))
        found = e.select("known", "processing_day", "event_day").distinct().collect()
        if any(not r.known for r in found):
            raise ValueError("a write under way may add rows to these processing days")
        mine = [r.event_day for r in found if r.processing_day is not None]
        return sorted({d for d in mine if d is not None}), None in mine

    def tokens(self) -> DataFrame:
        """(event_day, token, n_rows): a day's token changes with every write of its rows; NULL while one is under way."""
        e = self.entries()
        unsettled = e.where(~F.col("known")).limit(1).count() > 0
        hashed = F.xxhash64("entry", "load_unit", "processing_day", "event_day", "n_rows")
        token = F.when(F.bool_or("open") | F.lit(unsettled), F.lit(None)).otherwise(F.bit_xor(hashed))
        return e.where("known AND event_day IS NOT NULL").groupBy("event_day").agg(token.cast("bigint").alias("token"), F.sum("n_rows").alias("n_rows"))

    def day_tokens(self) -> dict[dt.date, int | None]:
        """One number for each event day of the table."""
        return {r.event_day: r.token for r in self.tokens().collect()}

    # ---- maintenance ---------------------------------------------------------
    def tidy(self) -> None:
        """Put the index's many small files together.  The new files are added before the old ones go, and rows that
        stand twice meanwhile count once; a reader that had listed the old files has to read again."""
        if not self.exists():
            return
        old = [f for path in (self.rows_path, self.marks_path) for f in self.spark.read.parquet(path).inputFiles()]
        kept = self.entries().select("entry", "load_unit").distinct()
        rows = self.spark.read.schema(ROWS).parquet(self.rows_path).join(kept, ["entry", "load_unit"], "left_semi")
        marks = self.spark.read.schema(MARKS).parquet(self.marks_path)
        last = marks.groupBy("load_unit").agg(F.max_by("entry", F.struct("at", "entry")).alias("entry"))
        marks = marks.join(kept.unionByName(last.select("entry", "load_unit")).distinct(), ["entry", "load_unit"], "left_semi")
        for df, ddl, path in ((rows, ROWS, self.rows_path), (marks, MARKS, self.marks_path)):
            columns = [c.split()[0] for c in ddl.split(", ")]
            keys = [c for c in columns if c != "at"]
            at = F.min("at") if path == self.rows_path else F.max("at")
            df.groupBy(*keys).agg(at.alias("at")).select(*columns).coalesce(1).write.mode("append").parquet(path)
        for f in old:
            fs, file = hadoop_path(self.spark, f)
            fs.delete(file, False)
