"""A persistent index of a backfill source's keys, bucketed by key.

A nightly backfill needs the last version of its day's keys.  Instead of scanning and shuffling the history each night, the
index keeps (key, version, insert day) of all days given to it, in a table bucketed by the key: a run reads and shuffles
the narrow columns of its own day, appends them, and joins and groups the index without an exchange on its side.

``_key`` is the JSON of the key columns: one text that is never null and differs where any key column does, so NULL keys
match as with ``<=>`` and Spark finds the bucketing.  A day added twice (a crash before its ledger row) changes nothing.
``compact`` keeps each key's last version alone.

A version inserted on a day that the index does not have yet counts when that day is added: a day backfilled before is then
among ``superseded``, so that after the last day the table is the one a backfill from scratch makes.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hadoop_path, path_exists
from .arrivals import day_ranges

KEY = "_key"
DAYS = "insert_day string"


def insert_days(days, proc_col: str) -> F.Column:
    """Range predicate on an epoch-millisecond column for whole days (text or dates)."""
    start = lambda d: int(dt.datetime.combine(d, dt.time(), dt.timezone.utc).timestamp() * 1000)
    pred = None
    for lo, hi in day_ranges(dt.date.fromisoformat(str(d)) for d in days):
        p = (F.col(proc_col) >= start(lo)) & (F.col(proc_col) < start(hi))
        pred = p if pred is None else pred | p
    return pred if pred is not None else F.lit(False)


def insert_day(proc_col: str) -> F.Column:
    return F.date_format(F.timestamp_millis(proc_col), "yyyy-MM-dd")


def key_of(keys) -> F.Column:
    return F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]))


@dataclass
class KeyIndex:
    spark: SparkSession
    path: str
    keys: tuple[str, ...] = ("pk", "eventId", "time", "eventType")
    version_cols: tuple[str, ...] = ("timeInserted",)
    proc_col: str = "timeInserted"
    buckets: int = 64

    # ---- storage: generations of a bucketed table, the last one marked by a file -----
    def _generation(self) -> int:
        fs, root = hadoop_path(self.spark, self.path)
        if not fs.exists(root):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return max((int(n[7:]) for n in names if n.startswith("is-gen-")), default=0)

    def _folder(self, generation: int) -> str:
        return f"{self.path.rstrip('/')}/gen-{generation}-b{self.buckets}"

    def _table(self, generation: int, version: T.DataType | None = None) -> str:
        """The catalog's name of a generation; its files are the truth, the entry is made anew in each session."""
        folder = self._folder(generation)
        name = "key_index_" + hashlib.md5(folder.encode()).hexdigest()[:20]
        if not self.spark.catalog.tableExists(name):
            if version is None:
                version = self.spark.read.parquet(folder).schema["_v"].dataType
            self.spark.sql(
                f"CREATE TABLE {name} ({KEY} STRING, _v {version.simpleString()}, {DAYS}) USING parquet "
                f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return name

    def _append(self, rows: DataFrame, generation: int) -> None:
        name = self._table(generation, rows.schema["_v"].dataType)
        rows.select(KEY, "_v", "insert_day").repartition(self.buckets, KEY).sortWithinPartitions(KEY).write.insertInto(name)
        self.spark.catalog.refreshTable(name)

    def rows(self) -> DataFrame | None:
        """(_key, _v, insert_day), bucketed by _key; None before the first day."""
        generation = self._generation()
        if not path_exists(self.spark, self._folder(generation)):
            return None
        return self.spark.table(self._table(generation))

    @property
    def _ledger(self) -> str:
        return f"{self.path.rstrip('/')}/days"

    def days(self) -> set[str]:
        if not path_exists(self.spark, self._ledger):
            return set()
        return {r[0] for r in self.spark.read.schema(DAYS).parquet(self._ledger).distinct().collect()}

    # ---- use ---------------------------------------------------------------------------
    def add(self, src: DataFrame, days) -> list[str]:
        """Index the days not indexed yet: their narrow columns are read, and shuffled to the buckets."""
        new = sorted({str(d) for d in days} - self.days())
        if not new:
            return []
        order = F.struct(*[F.col(f"`{c}`") for c in self.version_cols]).alias("_v")
        rows = src.where(insert_days(new, self.proc_col)).select(key_of(self.keys).alias(KEY), order, insert_day(self.proc_col).alias("insert_day"))
        self._append(rows.distinct(), self._generation())
        self.spark.createDataFrame([(d,) for d in new], DAYS).coalesce(1).write.mode("append").parquet(self._ledger)
        return new

    def _with_last(self, days) -> DataFrame:
        """(_key, _last: the version and insert day of its last row, _days) of keys with a row on ``days``.  No exchange."""
        mine = F.col("insert_day").isin([str(d) for d in days])
        found = self.rows().groupBy(KEY).agg(
            F.max(F.struct("_v", "insert_day")).alias("_last"), F.bool_or(mine).alias("_mine"), F.collect_set("insert_day").alias("_days"))
        return found.where("_mine").drop("_mine")

    def winners(self, days) -> DataFrame:
        """(_key, _v) of keys whose last version was inserted on ``days``."""
        return self._with_last(days).where(F.col("_last.insert_day").isin([str(d) for d in days])).select(KEY, F.col("_last._v").alias("_v"))

    def superseded(self, days) -> DataFrame:
        """(unit) other insert days that hold an earlier version of a key of ``days``: their row is not the last now."""
        found = self._with_last(days).select(F.explode("_days").alias("unit"), F.col("_last.insert_day").alias("last"))
        return found.where((F.col("unit") < F.col("last")) & ~F.col("unit").isin([str(d) for d in days])).select("unit").distinct()

    def compact(self) -> None:
        """A new generation with each key's last version, in one file for each bucket; then the old one goes."""
        rows, old = self.rows(), self._generation()
        if rows is None:
            return
        last = rows.groupBy(KEY).agg(F.max(F.struct("_v", "insert_day")).alias("_last"))
        self._append(last.select(KEY, F.col("_last._v").alias("_v"), F.col("_last.insert_day").alias("insert_day")), old + 1)
        fs, mark = hadoop_path(self.spark, f"{self.path.rstrip('/')}/is-gen-{old + 1}")
        stream = fs.create(mark, True)
        stream.write(bytearray(json.dumps({"generation": old + 1}).encode()))
        stream.close()
        self.spark.sql(f"DROP TABLE {self._table(old)}")
        fs.delete(hadoop_path(self.spark, self._folder(old))[1], True)
