"""Backfill inputs (FIXTURES A3/A4), derived from the driver's ``events``.

* ``source_table``: the warehouse table of the day backfill — keys
  ``(pk, eventId, time, eventType)``, BIGINT epoch-ms times, a keep-last
  version in ``timeInserted``; rows with ``event_id % 50 = 0`` have a second,
  later version (value + 1).  ``n_wide`` adds rule-generated feature columns
  ``f_000 ...`` for width experiments.
* ``write_snapshots``: the same rows exported as gzip CSV text, one export
  per processing day, list columns rendered as list literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import BLOCK_EVERY, DUP_EVERY, MISSING_AT, MISSING_EVERY, country_col, processing_time_col
from .tables import read_table

SNAPSHOT_MARKER = "ch-exporter-event_result"

# Declared source types of the snapshot columns (name, type).
SNAPSHOT_TYPES = [
    ("eventId", "String"),
    ("eventType", "LowCardinality(String)"),
    ("time", "UInt64"),
    ("timeInserted", "UInt64"),
    ("pk", "Int64"),
    ("rules", "Array(Int32)"),
    ("actions", "Array(String)"),
    ("trialRules", "Array(Int32)"),
    ("trialActions", "Nullable(Array(String))"),
    ("dv_reevaluate_entity", "Nullable(String)"),
    ("origin_id", "Nullable(Int64)"),
    ("origin_category", "LowCardinality(Nullable(String))"),
    ("dv_isDetection", "UInt8"),
    ("txn_amount", "Nullable(Float64)"),
    ("country", "LowCardinality(Nullable(String))"),
    ("score", "Nullable(Int32)"),
    ("note", "Nullable(String)"),
    ("created", "DateTime"),
]


def source_table(spark: SparkSession, sf_dir: str, n_wide: int = 0, with_duplicates: bool = True) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    base = ev.select(
        "event_id", "ts", "user_id", "event_type",
        F.when(F.col("event_id") % MISSING_EVERY == MISSING_AT, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.lit(0).alias("version"),
    )
    if with_duplicates:
        base = base.unionByName(
            base.where(F.col("event_id") % DUP_EVERY == 0).withColumn("value", F.col("value") + 1).withColumn("version", F.lit(1))
        )
    eid = F.col("event_id")
    proc = processing_time_col(eid, F.col("ts")) + F.make_dt_interval(hours=F.col("version"))
    cols = [
        F.col("user_id").alias("pk"),
        eid.cast("string").alias("eventId"),
        F.unix_millis("ts").alias("time"),
        F.col("event_type").alias("eventType"),
        F.unix_millis(proc).alias("timeInserted"),
        F.array((eid % 13).cast("int")).alias("rules"),
        F.array(F.when(eid % BLOCK_EVERY == 0, "block").otherwise("pass"), F.lit(None).cast("string")).alias("actions"),
        F.when(eid % 17 == 0, "user").alias("dv_reevaluate_entity"),
        F.when(eid % 2 == 0, eid % 1000).alias("origin_id"),
        F.when(eid % 2 == 0, "api").otherwise("batch").alias("origin_category"),
        F.when(eid % 11 == 0, 0).otherwise(1).cast("tinyint").alias("dv_isDetection"),
        F.col("value").alias("txn_amount"),
        country_col(F.col("user_id")).alias("country"),
        F.col("k").alias("score"),
        F.date_format("ts", "yyyyMMdd").alias("event_day"),
    ]
    cols += [
        (((eid * (7 * i + 3) + F.col("version")) % 1000) / 10.0).alias(f"f_{i:03d}") for i in range(n_wide)
    ]
    return base.select(*cols)


def _list_text(arr: F.Column, quote: bool) -> F.Column:
    """Render an array as a Python list literal: [1, 2] or ['a', None]."""
    if quote:
        items = F.transform(arr, lambda x: F.when(x.isNull(), F.lit("None")).otherwise(F.concat(F.lit("'"), x, F.lit("'"))))
    else:
        items = F.transform(arr, lambda x: F.coalesce(x.cast("string"), F.lit("None")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def snapshot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export as all-text columns (A3) plus the export name per processing day."""
    src = source_table(spark, sf_dir)
    eid = F.col("eventId").cast("bigint")
    day_ms = (F.floor(F.col("timeInserted") / 86_400_000) * 86_400_000).cast("bigint")
    return src.select(
        "eventId", "eventType", F.col("time").cast("string").alias("time"),
        F.col("timeInserted").cast("string").alias("timeInserted"), F.col("pk").cast("string").alias("pk"),
        _list_text(F.col("rules"), False).alias("rules"),
        _list_text(F.col("actions"), True).alias("actions"),
        F.lit("[]").alias("trialRules"),
        F.when(eid % 89 == 0, "not a list").otherwise("[]").alias("trialActions"),
        "dv_reevaluate_entity", F.col("origin_id").cast("string").alias("origin_id"), "origin_category",
        F.col("dv_isDetection").cast("string").alias("dv_isDetection"),
        F.col("txn_amount").cast("string").alias("txn_amount"), "country", F.col("score").cast("string").alias("score"),
        F.when(eid % 97 == 0, F.concat(F.lit("first line\nsecond, \"quoted\" line "), F.col("eventId"))).alias("note"),
        F.date_format(F.timestamp_millis("time"), "yyyy-MM-dd HH:mm:ss").alias("created"),
        F.concat(F.lit(f"raw__{SNAPSHOT_MARKER}-"), day_ms.cast("string"), F.lit("-"),
                 F.substring(F.sha2(day_ms.cast("string"), 256), 1, 8)).alias("snapshot"),
    )


def write_snapshots(spark: SparkSession, sf_dir: str, root: str) -> str:
    """Write gzip CSV exports under ``root/snapshot=<name>/`` and return root."""
    (
        snapshot_text(spark, sf_dir)
        .repartition("snapshot")
        .write.option("header", "true")
        .option("compression", "gzip")
        .option("escape", '"')
        .partitionBy("snapshot")
        .csv(root)
    )
    return root


def snapshot_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SNAPSHOT_TYPES, "name string, type string")


def write_flat_exports(spark: SparkSession, sf_dir: str, root: str) -> str:
    """Three flat exports ``raw__<marker>-<n>-part<k>.csv.gz`` that share the events among them: the second has
    its columns in another order, the third a column more."""
    from ..session import hadoop_path

    src = source_table(spark, sf_dir, with_duplicates=False)
    part = F.col("eventId").cast("bigint") % 3
    rows = src.select("eventId", "eventType", *[F.col(c).cast("string").alias(c) for c in ("time", "timeInserted", "txn_amount", "score")])
    orders = [
        ["eventId", "eventType", "time", "timeInserted", "txn_amount", "score"],
        ["score", "timeInserted", "eventId", "txn_amount", "time", "eventType"],
        ["eventId", "eventType", "time", "timeInserted", "score", "txn_amount", "risk"],
    ]
    fs, folder = hadoop_path(spark, root)
    fs.mkdirs(folder)
    for k, names in enumerate(orders):
        own = rows.where(part == k).withColumn("risk", (F.col("score").cast("int") / 100).cast("string"))
        made = f"{root}__part{k}"
        # an exporter writes one file for each export
        own.select(*names).repartition(1).write.option("header", "true").option("compression", "gzip").csv(made)
        fs, glob = hadoop_path(spark, f"{made}/*.csv.gz")
        written = fs.globStatus(glob)[0].getPath()
        fs.rename(written, hadoop_path(spark, f"{root}/raw__{SNAPSHOT_MARKER}-{1704067200000 + k}-part{k}.csv.gz")[1])
    return root


def truncate_export(spark: SparkSession, root: str, part: str) -> None:
    """Cut the last third off an export, as a broken transfer leaves it.  What stays is copied from stream to stream beside
    the export and takes its place, so that the driver holds a buffer of it, whatever its size."""
    from ..session import hadoop_path

    fs, glob = hadoop_path(spark, f"{root}/*{part}.csv.gz")
    path = fs.globStatus(glob)[0].getPath()
    size = int(fs.getFileStatus(path).getLen() * 2 / 3)
    cut = path.suffix(".cut")
    stream, out = fs.open(path), fs.create(cut, True)
    try:
        # not Hadoop's copyBytes: an int there is the size of the buffer, and the whole export would be copied
        spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, size)
    finally:
        stream.close()
        out.close()
    fs.delete(path, False)
    if not fs.rename(cut, path):
        raise RuntimeError(f"{cut.toString()} could not be moved")
