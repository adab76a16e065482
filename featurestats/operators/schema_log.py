"""The schema log of an event table.

``<table>__schema`` holds one small JSON file for each version of the table's schema, written by the writer that widens it
*before* its rows.  Readers and writers take the schema from the last version, so nobody opens the footers of the table's
files, however many there are, and a column that a file lacks reads as NULL.

A version is published by a rename that fails where the target exists.  Of two writers that widen at once one comes second;
it reads the other's version, fits its rows to that and publishes the next, so both keep their columns.  A version is
complete: the last one holds all columns.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hadoop_path
from .resolve import FIXED_COLUMNS

PARTITION_COLS = ("processing_day", "eventType")
#: Which writer a row comes from (see ``store``): the last partition level of a shared table.
LOAD_UNIT = "_load_unit"
SIDE = "__"
#: Types that hold every value of the type before the arrow.
FITS = {
    ("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("int", "bigint"),
    ("tinyint", "double"), ("smallint", "double"), ("int", "double"), ("float", "double"), ("tinyint", "float"), ("smallint", "float"),
}
HISTORY = "version int, column string, type string, committed_at timestamp"


def fits(own: str, wide: str) -> bool:
    return own == wide or (own, wide) in FITS or wide == "string" and not own.startswith(("array", "map", "struct", "binary"))


def fit(rows: DataFrame, existing: T.StructType | None) -> DataFrame:
    """``rows`` with the types of the table: fixed columns have fixed types, another column keeps the type it has in the table
    (values that don't fit go to a side column), and columns the table lacks are added as they are."""
    fixed = dict(FIXED_COLUMNS)
    have = {f.name: f.dataType for f in existing.fields} if existing else {}
    out = []
    for f in rows.schema.fields:
        c, own = F.col(f"`{f.name}`"), f.dataType.simpleString()
        want = fixed.get(f.name, have.get(f.name))
        if want is None or want == f.dataType or f.name in (*PARTITION_COLS, LOAD_UNIT) and f.name not in fixed:
            out.append(c.alias(f.name))
        elif f.name in fixed or fits(own, want.simpleString()):
            out.append(c.try_cast(want).alias(f.name))
        else:
            out += [F.lit(None).cast(want).alias(f.name), c.alias(f"{f.name}{SIDE}{own}")]
    return rows.select(*out)


def evolve(existing: T.StructType, incoming: T.StructType) -> tuple[T.StructType, list[str]]:
    """Widen by name.  Existing columns keep their place and type; new
    columns are appended as nullable.  Returns the target schema and the
    list of added names (never drops or narrows)."""
    have = {f.name for f in existing.fields}
    added = [T.StructField(f.name, f.dataType, True) for f in incoming.fields if f.name not in have]
    return T.StructType(list(existing.fields) + added), [f.name for f in added]


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: missing columns as typed NULLs, casts where
    types differ (never drops target columns; extra columns are dropped)."""
    cols = set(df.columns)
    out = []
    for f in schema.fields:
        if f.name in cols:
            c = F.col(f"`{f.name}`")
            src_type = df.schema[f.name].dataType
            out.append((c if src_type == f.dataType else c.try_cast(f.dataType)).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)


def log_path(table: str) -> str:
    return table.rstrip("/") + "__schema"


def _versions(spark: SparkSession, table: str) -> list[int]:
    fs, root = hadoop_path(spark, log_path(table))
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def _read(spark: SparkSession, table: str, version: int) -> dict:
    java = spark.sparkContext._jvm.java
    fs, file = hadoop_path(spark, f"{log_path(table)}/v{version:08d}.json")
    stream = fs.open(file)
    try:
        return json.loads(java.io.BufferedReader(java.io.InputStreamReader(stream, "UTF-8")).readLine())
    finally:
        stream.close()


def current_schema(spark: SparkSession, table: str) -> tuple[int, T.StructType | None]:
    """(version, schema) of the table; (0, None) before the first write."""
    versions = _versions(spark, table)
    if not versions:
        return 0, None
    return versions[-1], T.StructType.fromJson(_read(spark, table, versions[-1])["schema"])


def publish(spark: SparkSession, table: str, version: int, schema: T.StructType) -> bool:
    """Write this version, unless another writer has: then False."""
    fs, target = hadoop_path(spark, f"{log_path(table)}/v{version:08d}.json")
    draft = hadoop_path(spark, f"{log_path(table)}/draft-{uuid.uuid4().hex}")[1]
    stamp = dt.datetime.now(dt.timezone.utc).isoformat()
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps({"schema": schema.jsonValue(), "committed_at": stamp}).encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(target), plain)
    except Py4JJavaError:
        if not fs.exists(target):
            raise
        fs.delete(draft, False)
        return False
    return True


def widen(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` fitted to the table, whose logged schema has all their columns from here on."""
    spark = rows.sparkSession
    while True:
        version, have = current_schema(spark, table)
        fitted = fit(rows, have)
        target, added = evolve(have or T.StructType([]), fitted.schema)
        if not added or publish(spark, table, version + 1, target):
            return fitted


def read_logged(spark: SparkSession, table: str) -> DataFrame:
    """The table by its logged schema.  A table of other writers, which has no log, is read as Spark reads it."""
    schema = current_schema(spark, table)[1]
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(table)


def schema_history(spark: SparkSession, table: str) -> DataFrame:
    """(version, column, type, committed_at) of every column, by the version that added it."""
    rows, seen = [], set()
    for version in _versions(spark, table):  # one small file for each widening
        entry = _read(spark, table, version)
        stamp = dt.datetime.fromisoformat(entry["committed_at"]).replace(tzinfo=None)
        for f in T.StructType.fromJson(entry["schema"]).fields:
            if f.name not in seen:
                seen.add(f.name)
                rows.append((version, f.name, f.dataType.simpleString(), stamp))
    return spark.createDataFrame(rows, HISTORY)
