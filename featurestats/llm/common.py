"""Helpers shared by the operators of this subpackage.

Operators read only the columns they name, so extra columns of a table never
clash with theirs.  Python code runs as ``mapInArrow`` over batches; Spark
partitions, shuffles and retries the work.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from featurestats.session import checkpoint_root, work_path

#: Characters that numpy code takes at once; a longer text is taken alone.
CHUNK_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def scan(df: DataFrame, make: Callable, ddl: str | StructType, rows: int | None = None) -> DataFrame:
    """mapInArrow with one state per task.

    ``make()`` is called once in each task and returns a function from a
    RecordBatch to a list of columns (in the order of ``ddl``), or None for no rows.
    ``rows``: it gets so many at a time, where a batch of Spark's would be too much to hold with its results."""
    schema = schema_of(ddl) if isinstance(ddl, str) else ddl
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for k in range(0, len(whole), rows or len(whole)) if len(whole) else ():
                columns = step(whole.slice(k, rows) if rows else whole)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) ranges of ``texts`` with at most ``limit`` characters, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and where each text begins (and the end)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def fold(column: str, mod: int) -> "F.Column":
    """crc32 of the id as text modulo ``mod``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back: it cuts the
    lineage, is computed once and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    checkpoint_root(spark)
    return work_path(spark, name)


def keep_ids(docs: DataFrame, ids: DataFrame, max_broadcast: int = 500_000) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (one bigint column ``keep_id``, materialised).

    Up to ``max_broadcast`` ids (8 bytes each) are broadcast, so that the texts stay where they are;
    beyond that Spark shuffles both sides."""
    side = F.broadcast(ids) if ids.limit(max_broadcast + 1).count() <= max_broadcast else ids
    return docs.join(side, docs["doc_id"] == side["keep_id"], "left_semi")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) on uint64 arrays."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def dumps(x) -> str:
    return json.dumps(x, separators=(",", ":"))
