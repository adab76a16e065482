"""Operator 2: token ids in Parquet list columns that allow selective reads.

Texts are range-partitioned by doc_id, encoded in that order with the tokenizers library and written by Spark's own
Parquet writer, whose commit protocol survives lost executors.  The writer settings (``WRITER``) give delta-packed
integers (no dictionaries: ids have too many values for one), row groups of a fixed size, small pages and page indexes, so a
reader can take the metadata columns alone (``read_metadata``), or the ids of a range of documents (``read_range``), without
the rest.  ``first_token`` is the offset within the file; a file's own offset is the number of ids in the files of smaller
doc_ids.

Results: a null or empty text gives the end id alone.  Null doc_ids stand first; ties stand in the order of their
texts; repeated rows stay.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import scan, shared_folder
from .units import LAST_SURE_LETTER, UnitCache, chunks_of

FILE = "doc_id bigint, first_token bigint, n_tokens bigint, ids array<int>"
OUT = "doc_id bigint, first_token bigint, n_tokens bigint, ids_crc32 bigint, file string"
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",  # integers: DELTA_BINARY_PACKED where there is no dictionary
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(32 << 20),  # a row group: what a reader of many ids holds at once
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",  # the grain of the page indexes
}

#: Documents whose texts and ids are held at a time.
ROWS = 3000
#: Texts that are cut and looked up at once: a word costs Python time once for each chunk.
CHUNK_BYTES = 8 << 20


class LibraryCoder:
    """The tokenizers library with a bounded cache of words (exact: see ``units``)."""

    def __init__(self, path: str, end_id: int, cache_words: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.end = end_id
        special = next((t.content for t in self.library.get_added_tokens_decoder().values()), None)
        self.words = UnitCache(self.encode_units, self.encode_whole, cache_words, special)
        self.sure = chr(LAST_SURE_LETTER)
        self.stand_ins = {b: c for c, b in byte_alphabet().items()}
        self.line_feed = self.encode_whole("\n")

    def encode_units(self, units: list[str]) -> list[bytes]:
        out, tokenize, stand_ins, sure = [], self.model.tokenize, self.stand_ins, self.sure
        for u in units:
            head, rest = (self.line_feed, u[1:]) if u[0] == "\n" and len(u) > 1 else (b"", u)
            word = rest[1:] if rest[0] == " " else rest
            if word.isalpha() and (word.isascii() or max(word) <= sure):  # one piece of the pre-tokenizer
                piece = rest.encode().decode("latin-1").translate(stand_ins)
                out.append(head + array("I", [t.id for t in tokenize(piece)]).tobytes())
            else:
                out.append(self.encode_whole(u))
        return out

    def encode_whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id after them; number of ids of each text)."""
        parts = []
        for chunk in chunks_of(texts, CHUNK_BYTES):
            ids, counts = self.words(chunk)
            parts.append((np.insert(ids, np.cumsum(counts), self.end), counts + 1))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, "<u4"), np.zeros(0, np.int64))


@functools.lru_cache(maxsize=1)
def worker_coder(path: str, end_id: int) -> LibraryCoder:
    """One coder in each Python worker: tasks that follow find its words."""
    return LibraryCoder(path, end_id)


def write_tokens(docs: DataFrame, path: str, vocab_path: str, end_id: int = 0, n_files: int | None = None) -> None:
    """Write the token files of ``docs`` under ``path``, in ascending doc_id order: ``n_files`` of them, or as many as
    there are shuffle partitions."""

    def make():
        coder, total = worker_coder(vocab_path, end_id), 0

        def step(batch: pa.RecordBatch):
            nonlocal total
            ids, sizes = coder.encode(batch.column(1))
            ends = np.cumsum(sizes)
            first = total + ends - sizes
            total += int(sizes.sum())
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            return [batch.column(0), pa.array(first), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))]

        return step

    n = n_files or docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = (docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")
               .repartitionByRange(int(n), "doc_id").sortWithinPartitions("doc_id", "text"))
    scan(ordered, make, FILE, ROWS).write.options(**WRITER).mode("overwrite").parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, first_token and n_tokens of all documents; the ids stay unread."""
    return spark.read.schema(FILE).parquet(path).select("doc_id", "first_token", "n_tokens")


def read_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """doc_id, n_tokens and ids of documents from ``low`` to below ``high``: files and pages outside are skipped."""
    return (spark.read.schema(FILE).parquet(path).where((F.col("doc_id") >= low) & (F.col("doc_id") < high))
            .select("doc_id", "n_tokens", "ids"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: where its ids start in the whole, how many there are, and their CRC-32."""

    def make():
        def step(batch: pa.RecordBatch):
            ids = batch.column(3)
            flat, offsets = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            return [batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64()), batch.column(4)]

        return step

    files = spark.read.schema(FILE).parquet(path).select("*", F.col("_metadata.file_path").alias("file"))
    rows = scan(files, make, OUT)
    # One row for each file; it reads the metadata columns alone.
    totals = files.groupBy("file").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("low"), F.sum("n_tokens").alias("size"))
    running = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", F.coalesce(F.sum("size").over(running), F.lit(0)).alias("before"))
    return rows.join(offsets, "file").select(
        "doc_id", (F.col("before") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_files(docs: DataFrame, vocab_path: str, end_id: int = 0) -> DataFrame:
    path = shared_folder(docs.sparkSession, "token-files")
    write_tokens(docs, path, vocab_path, end_id)
    return read_tokens(docs.sparkSession, path)
