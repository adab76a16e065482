"""Table layout, schema evolution and maintenance.

Event table layout: Parquet partitioned by ``processing_day`` (day of
processingTime) and ``eventType``; rows sorted by eventType, eventTime,
eventId inside each file; zstd; bloom filters on eventId and userId.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_path, work_path
from .schema_log import LOAD_UNIT, PARTITION_COLS, read_logged, widen

SORT_COLS = ("eventType", "eventTime", "eventId")
BLOOM_COLS = ("eventId", "userId")


def with_layout_columns(df: DataFrame, proc_col: str = "processingTime") -> DataFrame:
    return df.withColumn("processing_day", F.to_date(F.col(proc_col)))


def write_events(df: DataFrame, path: str, mode: str = "overwrite", max_records_per_file: int = 5_000_000) -> None:
    """Partition-scoped write.

    ``mode='overwrite'`` uses *dynamic* partition overwrite: only the
    partitions present in ``df`` are replaced, so re-running a unit whose rows
    are exactly those partitions (a processing day) is safe.  New rows for
    partitions that already hold other rows must use ``mode='append'``.

    Rows are fitted to the table's logged schema, which is widened first (``schema_log``).

    Rows are clustered by the partition columns with a REBALANCE hint: AQE
    splits a hot (day, eventType) partition across several tasks and merges
    small ones, so one huge event type never lands in a single writer task."""
    if "processing_day" not in df.columns:
        df = with_layout_columns(df)
    df = widen(df, path)
    by = partition_columns(df)
    writer = event_writer(df.hint("rebalance", *by).sortWithinPartitions(*SORT_COLS), mode, max_records_per_file).partitionBy(*by)
    if mode != "append":
        writer.parquet(path)  # a dynamic overwrite stages its files in a folder of its own
        return
    # Appends all stage theirs under <path>/_temporary, by attempt number, and the first to end would clear that folder
    # under the others; so each gets a number of its own and clears that alone.
    attempt = uuid.uuid4().int % (2**31 - 1) + 1
    writer.option("mapreduce.job.application.attempt.id", str(attempt)).option("mapreduce.fileoutputcommitter.cleanup.skipped", "true").parquet(path)
    fs, staged = hadoop_path(df.sparkSession, f"{path.rstrip('/')}/_temporary/{attempt}")
    fs.delete(staged, True)


def partition_columns(df: DataFrame) -> list[str]:
    return [*PARTITION_COLS, LOAD_UNIT] if LOAD_UNIT in df.columns else [*PARTITION_COLS]


def event_writer(df: DataFrame, mode: str, max_records_per_file: int = 5_000_000):
    """The writer properties of every event file, compacted ones included."""
    w = (
        df.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", str(max_records_per_file))
    )
    for c in BLOOM_COLS:
        if c in df.columns:
            # adaptive: the filter is sized to the distinct values actually written
            # (a fixed default costs 1 MB per column per file, even for tiny files)
            w = (w.option(f"parquet.bloom.filter.enabled#{c}", "true")
                 .option("parquet.bloom.filter.adaptive.enabled", "true"))
    return w


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Read by the logged schema (columns added over time read as NULL in older files)."""
    return read_logged(spark, path)


REPORT_SCHEMA = "files_before long, files_after long, rows_before long, rows_after long, rows_match boolean"
FILES = "directory string, path string, length long"
#: Bins, and files in them, that one job rewrites (one bin at least); file system calls that run at a time.
ROUND, ROUND_FILES, CALLS = 256, 20_000, 16


def _journals(path: str) -> str:
    return path.rstrip("/") + "__compaction"


def finish_compaction(spark: SparkSession, path: str) -> int:
    """Carry out what the journals of a compaction say, if there are any: move a bin's staged files into the table (renames,
    no data is copied), then delete the files they replace and the journal.  Each step may be repeated, so a crash
    at any point is mended by the next call.  Returns the number of bins.

    Between the two steps of a bin a reader can see its rows twice: where that matters, read before or after."""
    fs, root = hadoop_path(spark, _journals(path))
    if not fs.exists(root):
        return 0
    journals = [s.getPath().toString() for s in fs.listStatus(root) if s.getPath().getName().endswith(".json")]

    def finish(journal: str) -> None:
        entry = json.loads(_text(spark, journal))
        for source, target in entry["move"]:
            files, old = hadoop_path(spark, source)
            if files.exists(old):
                new = hadoop_path(spark, target)[1]
                files.mkdirs(new.getParent())
                if not files.rename(old, new):
                    raise RuntimeError(f"compaction: {source} could not be moved")
        for f in [*entry["delete"], entry["staging"], journal]:
            files, old = hadoop_path(spark, f)
            files.delete(old, True)

    with ThreadPoolExecutor(CALLS) as pool:
        list(pool.map(finish, journals))
    fs.delete(root, True)
    return len(journals)


def _text(spark: SparkSession, file: str) -> str:
    java = spark.sparkContext._jvm.java
    fs, p = hadoop_path(spark, file)
    stream = fs.open(p)
    try:
        return java.io.BufferedReader(java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()


def table_files(spark: SparkSession, path: str, partition_filter: str | None = None) -> DataFrame:
    """(directory, path, length) of the table's files, from the listing alone (no footer is opened)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    chosen = files.where(partition_filter) if partition_filter else files
    return chosen.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("directory"), "path", "length")


def pack_files(files: DataFrame, target_file_bytes: int) -> DataFrame:
    """(bin, path, length): the files to put together, first fit decreasing within each directory, into bins of up to twice the
    target.  Files of the target size or more, and a file that is alone in its bin, stay as they are."""

    def pack(held):
        held = held.sort_values(["length", "path"], ascending=[False, True])
        free: list[int] = []
        bins = []
        for size in held["length"]:
            k = next((k for k, room in enumerate(free) if size <= room), len(free))
            if k == len(free):
                free.append(2 * target_file_bytes)
            free[k] -= size
            bins.append(k)
        held = held.assign(bin=[f"{d}#{k}" for d, k in zip(held["directory"], bins)])
        return held[held.duplicated("bin", keep=False)][["bin", "path", "length"]]

    # The group is a directory's listing: names and sizes of its small files.
    return files.where(F.col("length") < target_file_bytes).groupBy("directory").applyInPandas(pack, "bin string, path string, length long")


def compact(spark: SparkSession, path: str, partition_filter: str | None = None, target_file_bytes: int = 256 << 20) -> DataFrame:
    """Put the small files of the selected partitions together into files of one to two times ``target_file_bytes``, sorted
    and with the table's writer properties; files of that size stay untouched, so a second run has nothing to do.

    Files are chosen by size (``pack_files``).  Bins are rewritten in rounds, one Spark job each;
    each bin's row count is checked, and then its swap journaled, on its own.  So a crash costs at most the round
    under way, and what was journaled is finished by the next call.  Files appended meanwhile are in no bin and
    stay.  Returns a one-row report."""
    finish_compaction(spark, path)
    schema = read_events(spark, path).schema
    chosen = materialized(pack_files(table_files(spark, path, partition_filter), target_file_bytes), "bins")
    bins = chosen.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # a row for each bin, not for each file
    totals, names, files = [0, 0, 0, 0], [], 0
    for k, r in enumerate(bins):
        names.append(r.bin)
        files += r.n
        if len(names) == ROUND or files >= ROUND_FILES or k == len(bins) - 1:
            done = _rewrite(spark, path, schema, chosen, names, target_file_bytes)
            totals, names, files = [a + b for a, b in zip(totals, done)], [], 0
    return spark.createDataFrame([(*totals, totals[2] == totals[3])], REPORT_SCHEMA)


def materialized(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rewrite(spark: SparkSession, path: str, schema, chosen: DataFrame, names: list[str], target_file_bytes: int) -> list[int]:
    """One round: these bins' files are read, written to a staging folder for each bin, checked, journaled and swapped."""
    members: dict[str, list[str]] = {}
    size = 0
    for r in chosen.where(F.col("bin").isin(names)).collect():
        members.setdefault(r.bin, []).append(r.path)
        size += r.length
    number = {name: k for k, name in enumerate(names)}
    files = spark.createDataFrame([(f, number[b]) for b, fs in members.items() for f in fs], "_path string, _bin int")
    stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d%H%M%S%f")
    staging = f"{path.rstrip('/')}__compact_{stamp}"
    source = spark.read.option("basePath", path).schema(schema).parquet(*[f for fs in members.values() for f in fs])
    by = [c for c in (*PARTITION_COLS, LOAD_UNIT) if c in source.columns]
    rows = source.withColumn("_path", F.col("_metadata.file_path")).join(F.broadcast(files), "_path").drop("_path")
    before = {r["_bin"]: r.n for r in rows.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Tasks by the bytes there are: a large bin about fills one, small ones share it.
    n = min(len(names), max(spark.sparkContext.defaultParallelism, -(-size // target_file_bytes)))
    parted = rows.repartition(n, "_bin").sortWithinPartitions("_bin", *by, *SORT_COLS)
    event_writer(parted, "overwrite").partitionBy("_bin", *by).parquet(staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    after = {r["_bin"]: r for r in staged.groupBy("_bin").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("_metadata.file_path").alias("files")).collect()}
    if wrong := [names[k] for k in before if k not in after or before[k] != after[k].n]:
        fs, target = hadoop_path(spark, staging)
        fs.delete(target, True)
        raise RuntimeError(f"compaction row mismatch in {wrong[:3]}; table untouched")
    marker = "/" + staging.rsplit("/", 1)[1] + "/"

    def journal(name: str) -> int:
        k = number[name]
        written = sorted(after[k].files) if k in after else []
        # Files of two bins that one task wrote have the same name.
        inside = [_renamed(path.rstrip("/") + "/" + f.rsplit(marker, 1)[1].split("/", 1)[1], f"{stamp}-{k}") for f in written]
        entry = {"move": [[_plain(f), _plain(t)] for f, t in zip(written, inside)], "delete": [_plain(f) for f in members[name]], "staging": f"{staging}/_bin={k}"}
        _write_text(spark, f"{_journals(path)}/{stamp}-{k}.json", json.dumps(entry))
        return len(written)

    with ThreadPoolExecutor(CALLS) as pool:
        new = sum(pool.map(journal, members))
    finish_compaction(spark, path)
    fs, rest = hadoop_path(spark, staging)
    fs.delete(rest, True)
    return [sum(map(len, members.values())), new, sum(before.values()), sum(r.n for r in after.values())]


def _renamed(file: str, tag: str) -> str:
    folder, _, name = file.rpartition("/")
    return f"{folder}/{name.replace('part-', f'part-{tag}-', 1)}"


def _write_text(spark: SparkSession, file: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    fs, target = hadoop_path(spark, file)
    draft = hadoop_path(spark, file + ".draft")[1]
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.rename(draft, target)


def _plain(uri: str) -> str:
    """The path a file URI (percent-encoded) stands for."""
    return unquote(uri) if uri.startswith(("file:", "hdfs:", "viewfs:", "s3")) else uri


def expired_partitions(df: DataFrame, as_of, keep_days: int, day_col: str = "processing_day") -> DataFrame:
    """Day partitions older than the retention (``day < as_of - keep_days``),
    with their row counts — the list a partition drop acts on."""
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    cutoff = as_of - dt.timedelta(days=keep_days)
    return (
        df.where(F.col(day_col) < F.lit(cutoff))
        .groupBy(day_col)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def apply_retention(spark: SparkSession, path: str, as_of, keep_days: int, dry_run: bool = True) -> list[str]:
    """T2 drop: remove the ``processing_day`` partitions older than the
    retention.  Only directories named ``processing_day=<expired day>``
    directly under ``path`` are touched, one directory delete each (atomic
    per partition on HDFS-like stores).  ``dry_run`` (default) only lists
    them.  Returns the partition directories (to be) removed."""
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    cutoff = as_of - dt.timedelta(days=keep_days)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    expired = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if not (status.isDirectory() and name.startswith("processing_day=")):
            continue
        try:
            day = dt.date.fromisoformat(name.split("=", 1)[1])
        except ValueError:
            continue
        if day < cutoff:
            expired.append(status.getPath().toString())
    if not dry_run:
        for p in expired:
            fs.delete(jvm.org.apache.hadoop.fs.Path(p), True)
    return sorted(expired)
