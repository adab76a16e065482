"""Historical backfill as Spark jobs.

Both reference paths (per-file import, per-day column export) become *one*
declarative job over all pending units: read → dedup → convert → replace the units' own
rows in the shared table (``store``) → ledger.  Column batching is unnecessary (Parquet column
pruning) but ``stitch_slices`` reproduces it exactly when a source can only be
exported in column slices.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import unquote

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import coerce, epoch_to_timestamp, parse_list
from ..functions.types import source_type
from ..session import checkpoint_root, hadoop_path, path_exists, work_path
from .dedup import join_winners, winners_of
from .key_index import KEY, KeyIndex, insert_day, insert_days, key_of
from .layout import read_events, with_layout_columns
from .prune import latest_state, skip_done
from .schema_log import LOAD_UNIT, align, evolve
from .store import replace_units

log = logging.getLogger(__name__)

# Source column → event-table column renames.
BASE_RENAMES = {
    "time": "eventTime",
    "timeInserted": "processingTime",
    "dv_reevaluate_entity": "reEvaluateEntity",
    "origin_id": "originId",
    "origin_category": "originCategory",
}
FLAG_SOURCE, FLAG_TARGET = "dv_isDetection", "fromUpdateAPI"
TIME_COLUMNS = ("time", "timeInserted")
EXPORT_MARKER = "ch-exporter-event_result"
#: Cells (a slice's rows times all slices' columns) that a task of ``stitch_slices`` puts together.
STITCH_CELLS = 8_000_000
LEDGER_SCHEMA = "unit string, state string, rows long, updated_at timestamp"


@dataclass
class BackfillSpec:
    keys: tuple[str, ...] = ("pk", "eventId", "time", "eventType")
    version_cols: tuple[str, ...] = ("timeInserted",)
    renames: dict = field(default_factory=lambda: dict(BASE_RENAMES))
    primary_key_to_user: str | None = None  # e.g. "pk" → userId
    invert_flag: bool = True


def invert_flag(c: F.Column) -> F.Column:
    """``fromUpdateAPI = (dv_isDetection <> 1)``; NULL stays NULL."""
    return c.cast("string").try_cast("int") != F.lit(1)


def convert_rows(df: DataFrame, spec: BackfillSpec) -> DataFrame:
    """R7 + R11 + R12: epoch times → timestamps, flag inversion, renames."""
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name in TIME_COLUMNS:
            c = epoch_to_timestamp(c)
        if name == FLAG_SOURCE and spec.invert_flag:
            out.append(invert_flag(c).alias(FLAG_TARGET))
            continue
        target = spec.renames.get(name, name)
        if spec.primary_key_to_user and name == spec.primary_key_to_user:
            target = "userId"
            c = c.cast("string")
        out.append(c.alias(target))
    return df.select(*out)


def declared_types(declared) -> dict[str, str]:
    """``(name, type)`` table (DataFrame, small) or dict → dict."""
    if isinstance(declared, DataFrame):
        return {r[0]: r[1] for r in declared.select("name", "type").collect()}
    return dict(declared)


def type_snapshot(df: DataFrame, declared, null_spellings=None) -> DataFrame:
    """R13 + R14: typed projection of an all-text table from declared types.
    Arrays parse from list literals, scalars by the coercion rules; columns
    without a declaration stay text.  ``null_spellings`` (e.g. ['NA', 'null'])
    reproduces reader-level NULL spellings; by default only '' is NULL."""
    declared = declared_types(declared)
    cols = []
    for name in df.columns:
        s = F.col(f"`{name}`")
        if null_spellings:
            s = F.when(s.isin(list(null_spellings)), F.lit(None).cast("string")).otherwise(s)
        s = F.when(s == "", F.lit(None).cast("string")).otherwise(s)
        decl = declared.get(name)
        if decl is None or name in TIME_COLUMNS:
            cols.append(s.alias(name))
            continue
        t = source_type(decl)
        if isinstance(t, T.ArrayType):
            cols.append(parse_list(s, t.elementType).alias(name))
        else:
            cols.append(coerce(s, t).alias(name))
    return df.select(*cols)


def export_files(spark: SparkSession, root: str, marker: str = EXPORT_MARKER, names=None) -> dict[str, list[str]]:
    """Export (unit) name -> its files, from the listing alone.  Exports are flat files
    ``<name>.csv.gz`` or folders ``snapshot=<name>/``; chosen by name marker or by a list of ``names``."""
    found: dict[str, list[str]] = {}
    for pattern in ("*.csv.gz", "snapshot=*/*.csv*"):
        fs, glob = hadoop_path(spark, f"{root.rstrip('/')}/{pattern}")
        for status in fs.globStatus(glob) or []:
            p = status.getPath()
            folder = p.getParent().getName()
            name = unquote(folder.partition("=")[2]) if folder.startswith("snapshot=") else p.getName().removesuffix(".csv.gz")
            if (name in names) if names is not None else (marker in name):
                found.setdefault(name, []).append(p.toString())
    return {name: sorted(files) for name, files in sorted(found.items())}


#: Headers that are read at a time.
HEADERS = 32


def header_of(spark: SparkSession, file: str) -> str:
    """The header of an export, from the beginning of the file: its first line, and more while a quoted name goes on."""
    java = spark.sparkContext._jvm.java
    fs, p = hadoop_path(spark, file)
    stream = fs.open(p)
    try:
        data = java.util.zip.GZIPInputStream(stream) if file.endswith(".gz") else stream
        reader = java.io.BufferedReader(java.io.InputStreamReader(data, "UTF-8"))
        header = reader.readLine() or ""
        while header.count('"') % 2 and (line := reader.readLine()) is not None:
            header += "\n" + line
        return header
    finally:
        stream.close()


def headers_of(spark: SparkSession, files: list[str]) -> list[str]:
    """The headers of many exports; the calls wait for the store, so many are under way at a time."""
    with ThreadPoolExecutor(HEADERS) as pool:
        return list(pool.map(lambda f: header_of(spark, f), files))


def read_snapshots(spark: SparkSession, files: dict[str, list[str]]) -> DataFrame | None:
    """S3: gzip CSV exports, header row, every column as text, quoted newlines allowed, tagged with the export's
    name (``_export``).  Exports differ in their columns and in the columns' order, so those with the same header are
    read together under that header, and the groups are united by name.  Each gzip file is one task (not
    splittable).  An unreadable file fails the read."""
    groups: dict[str, list[str]] = {}
    every = [f for unit in files.values() for f in unit]
    for f, header in zip(every, headers_of(spark, every)):
        groups.setdefault(header, []).append(f)
    out = None
    for header, paths in sorted(groups.items()):
        if not header:
            continue
        names = next(csv.reader(io.StringIO(header)))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = (
            spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"')
            .option("ignoreCorruptFiles", "false").csv(paths)
            .select("*", F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1).alias("_folder"),
                    F.substring_index("_metadata.file_path", "/", -1).alias("_file"))
            .withColumn("_file", F.when(F.endswith("_file", F.lit(".csv.gz")), F.expr("left(_file, length(_file) - 7)")).otherwise(F.col("_file")))
        )
        named = F.when(F.col("_folder").startswith("snapshot="), F.expr("url_decode(replace(substring(_folder, 10), '+', '%2B'))")).otherwise(
            F.expr("url_decode(replace(_file, '+', '%2B'))"))
        df = df.withColumn("_export", named).drop("_folder", "_file")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# ---- ledger (B3) -------------------------------------------------------------
def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def append_ledger(spark: SparkSession, path: str, rows: DataFrame) -> None:
    rows.select("unit", "state", F.col("rows").cast("bigint").alias("rows"), "updated_at").coalesce(1).write.mode(
        "append"
    ).parquet(path)


def pending_units(spark: SparkSession, units, ledger_path: str) -> list[str]:
    """Units not DONE (FAILED ones are retried), in their order.  The ledger is reduced by an anti-join;
    the driver gets the pending units alone."""
    units = list(units)
    if not units:
        return []
    todo = skip_done(spark.createDataFrame([(u,) for u in units], "unit string"), read_ledger(spark, ledger_path))
    left = {r.unit for r in todo.collect()}
    return [u for u in units if u in left]


def _now():
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


# ---- B2: day backfill ----------------------------------------------------------
def day_rows(src: DataFrame, days, spec: BackfillSpec, proc_col: str = "timeInserted", prefilter=None, index: KeyIndex | None = None) -> DataFrame:
    """Rows inserted on ``days`` that are the *latest* version of their key.

    Dedup happens before the day filter semantically (a row superseded on a
    later day must not be exported on its earlier day) but is executed in two
    phases so that wide columns are read only for the exported days:

    1. the winning version of each key of the day rows, *narrow*: from every version of those keys in the source, or,
       with ``index``, from the key index (which has been given the days), so that the history is not read;
    2. the day rows (wide) joined to the winners on key + version; of rows that share both, one stays, chosen by
       the whole row.

    ``prefilter(df)`` may add partition predicates (e.g. derived event-day
    bounds, F2) to the day-row scan."""
    keys, ver = list(spec.keys), list(spec.version_cols)
    day = src.where(insert_days(days, proc_col))
    if prefilter is not None:
        day = prefilter(day)
    if index is not None:
        # Rows that share key and version are of the day: the narrow day rows tell how many there are.
        last = index.winners(days)
        own = day.select(*keys, *ver, key_of(keys).alias(KEY), F.struct(*ver).alias("_dv"))
        own = own.join(last, (own[KEY] == last[KEY]) & own["_dv"].eqNullSafe(last["_v"])).select(*keys, *ver)
        return join_winners(day, winners_of(own, keys, ver), keys, ver)
    day_keys = day.select(*keys).distinct()
    versions = src.select(*keys, *ver).join(day_keys, [src[k].eqNullSafe(day_keys[k]) for k in keys], "left_semi")
    return join_winners(day, winners_of(versions, keys, ver), keys, ver)


def superseded_days(src: DataFrame, days, spec: BackfillSpec, proc_col: str = "timeInserted") -> DataFrame:
    """(unit) earlier insert days of keys that have a version on ``days``: a row of theirs is no longer the last."""
    keys = list(spec.keys)
    narrow = src.select(*keys, proc_col)
    now = narrow.where(insert_days(days, proc_col)).groupBy(*keys).agg(F.max(proc_col).alias("_last"))
    now = now.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_last")
    older = narrow.join(now, [narrow[k].eqNullSafe(now[f"_k_{k}"]) for k in keys]).where(F.col(proc_col) < F.col("_last"))
    return older.select(insert_day(proc_col).alias("unit")).distinct()


def backfill_days(
    spark: SparkSession, src: DataFrame, days, target: str, ledger_path: str, spec: BackfillSpec | None = None,
    dry_run: bool = False, index: KeyIndex | None = None,
) -> DataFrame:
    """B2: one job for all pending days.  Returns per-day counts.  ``dry_run``
    writes nothing and marks nothing (the reference marked dry-run days DONE).

    ``index``: a ``KeyIndex`` of the source.  The pending days are added to it, and the run reads them and the index
    alone, whatever the length of the history.

    A day is the unit ``day-<day>`` of the shared table; only rows of that unit are replaced.  Days done before whose
    rows are superseded by a pending day are done again."""
    spec = spec or BackfillSpec()
    todo = pending_units(spark, [str(d) for d in days], ledger_path)
    if not todo:
        return spark.createDataFrame([], "unit string, rows long")
    done = latest_state(read_ledger(spark, ledger_path)).where("state = 'DONE'").select("unit")
    if index is not None:
        index.add(src, todo)  # also in a dry run: the index says nothing of the target
    older = superseded_days(src, todo, spec) if index is None else index.superseded(todo)
    again = older.join(done, "unit", "left_semi")  # days: bounded by the table's age
    todo = sorted({*todo, *(r.unit for r in again.collect())})
    rows = convert_rows(day_rows(src, todo, spec, index=index), spec)
    counts_of = lambda df: df.groupBy(F.date_format("processingTime", "yyyy-MM-dd").alias("unit")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    units = spark.createDataFrame([(u,) for u in todo], "unit string")
    if dry_run:
        return units.join(counts_of(rows), "unit", "left").select("unit", F.coalesce("rows", F.lit(0)).alias("rows"))
    tags = [f"day-{u}" for u in todo]
    replace_units(rows.withColumn(LOAD_UNIT, F.concat(F.lit("day-"), F.date_format("processingTime", "yyyy-MM-dd"))), target, tags,
                  [dt.date.fromisoformat(u) for u in todo])
    counts = _mark(spark, _written_counts(spark, target, "day-", tags), units, ledger_path)
    return counts


def _written_counts(spark: SparkSession, target: str, prefix: str, tags) -> DataFrame:
    """(unit, rows) of the units as written; partition columns only, so footers answer."""
    if not path_exists(spark, target):
        return spark.createDataFrame([], "unit string, rows long")
    held = read_events(spark, target).where(F.col(LOAD_UNIT).isin(tags))
    return held.groupBy(F.substring(LOAD_UNIT, len(prefix) + 1, 1000).alias("unit")).agg(F.count(F.lit(1)).alias("rows"))


def _mark(spark: SparkSession, counts: DataFrame, units: DataFrame, ledger_path: str, empty: str = "DONE", failed=()) -> DataFrame:
    """Append the ledger rows of a finished run; returns (unit, rows)."""
    checkpoint_root(spark)
    counts = units.join(counts, "unit", "left").select("unit", F.coalesce("rows", F.lit(0)).alias("rows"))
    counts = counts.checkpoint(eager=True)  # the ledger must not re-read a changing table
    state = F.when(F.col("unit").isin(list(failed)), "FAILED").when(F.col("rows") > 0, "DONE").otherwise(empty)
    append_ledger(spark, ledger_path, counts.select("unit", state.alias("state"), "rows", F.lit(_now()).alias("updated_at")))
    return counts


# ---- B1: file backfill -----------------------------------------------------------
#: Rows of a staged file at most: an export is read by one task, what comes after by many.
STAGED_ROWS = 250_000
#: Exports that are read at a time, each by a job of its own, once the read of all has failed.
READS = 8


def _staged(df: DataFrame) -> str:
    path = work_path(df.sparkSession, "exports")
    df.write.option("maxRecordsPerFile", STAGED_ROWS).parquet(path)
    return path


def _stage(spark: SparkSession, files: dict[str, list[str]], failed: list[str]) -> list[str]:
    """The exports' text, read once, in staging tables.  If that read fails, each export is read by itself, so that an
    unreadable one costs no other a further read; it goes to ``failed`` with none of its rows kept."""
    try:
        text = read_snapshots(spark, files)
        return [] if text is None else [_staged(text)]
    except (PySparkException, Py4JError) as e:
        if len(files) == 1:
            log.warning("export %s can't be read: %s", next(iter(files)), str(e)[:300])
            failed.extend(files)
            return []
        with ThreadPoolExecutor(READS) as pool:
            return [p for part in pool.map(lambda n: _stage(spark, {n: files[n]}, failed), files) for p in part]


def _typed(spark: SparkSession, staged: list[str], typed) -> list[str]:
    """The staged text made typed rows, by many tasks; tables with the same columns together."""
    same: dict[tuple, list[str]] = {}
    for path in staged:
        same.setdefault(tuple(sorted(spark.read.parquet(path).columns)), []).append(path)
    return [_staged(typed(spark.read.parquet(*paths))) for paths in same.values()]


def backfill_files(
    spark: SparkSession, root: str, declared, target: str, ledger_path: str,
    spec: BackfillSpec | None = None, dry_run: bool = False, null_spellings=None, names=None,
) -> DataFrame:
    """B1: every pending export; unit = export (file) name, of all exports or of ``names``.

    The pending exports are read once into a staging table, as text, which becomes another one of typed rows; counts, and
    the final write, are taken from that.  An
    export is the unit ``file-<name>`` of the shared table: its rows replace only its own earlier rows, so
    re-running is idempotent and neither other exports nor live rows of the same day are touched.  An export
    that can't be read or yields no rows is recorded FAILED, with no rows, and retried next time."""
    spec = spec or BackfillSpec()
    declared = declared_types(declared)
    files = export_files(spark, root, names=names)
    todo = pending_units(spark, files, ledger_path)
    if not todo:
        return spark.createDataFrame([], "unit string, rows long")

    def typed(text: DataFrame) -> DataFrame:
        rows = convert_rows(type_snapshot(text, declared, null_spellings), spec)
        rows = rows.withColumn(LOAD_UNIT, F.concat(F.lit("file-"), "_export")).withColumnRenamed("_export", "_source_file")
        return with_layout_columns(rows)

    failed: list[str] = []
    staged = _typed(spark, _stage(spark, {n: files[n] for n in todo}, failed), typed)
    units = spark.createDataFrame([(u,) for u in todo], "unit string")
    tags = [f"file-{u}" for u in todo]
    if not staged:
        none = spark.createDataFrame([], "unit string, rows long")
        return none if dry_run else _mark(spark, none, units, ledger_path, empty="FAILED", failed=failed)
    parts, schema = [spark.read.parquet(p) for p in staged], T.StructType([])
    for part in parts:
        schema = evolve(schema, part.schema)[0]
    rows = align(parts[0], schema)
    for part in parts[1:]:
        rows = rows.unionByName(align(part, schema))
    counts = rows.groupBy(F.col("_source_file").alias("unit")).agg(F.count(F.lit(1)).alias("rows"))
    if dry_run:
        return units.join(counts, "unit", "left").select("unit", F.coalesce("rows", F.lit(0)).alias("rows"))
    replace_units(rows, target, tags, [r[0] for r in rows.select("processing_day").distinct().collect()])
    return _mark(spark, counts, units, ledger_path, empty="FAILED", failed=failed)


# ---- R15: column slices --------------------------------------------------------------
def stitch_slices(slices: list[DataFrame], keys) -> DataFrame:
    """Put column slices (each = keys + some columns, deduplicated) back into
    wide rows by key.  One union + one ``groupBy(keys)`` (a single shuffle for
    any number of slices) instead of a chain of joins; NULL keys match NULL
    keys as in ``<=>``.  Each non-key column lives in exactly one slice, so
    ``first(ignorenulls)`` picks the only candidate.

    Each slice is written by a job of its own first, and counted: no task holds the sorts of several slices, and the
    shuffle gets as many tasks as the wide rows need (``STITCH_CELLS``)."""
    keys = list(keys)
    value_cols = [c for s in slices for c in s.columns if c not in keys]
    if len(set(value_cols)) != len(value_cols):
        raise ValueError("a non-key column appears in more than one slice")
    spark, tagged, n_rows = slices[0].sparkSession, None, 0
    for s in slices:
        seen, path = Observation(), work_path(spark, "slice")
        s.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        n_rows += seen.get["n"]
        s = spark.read.schema(s.schema).parquet(path)
        tagged = s if tagged is None else tagged.unionByName(s, allowMissingColumns=True)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows * len(value_cols) // STITCH_CELLS))
    dealt = tagged.repartition(n, *[F.col(f"`{k}`") for k in keys])
    return dealt.groupBy(*keys).agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in value_cols])
