"""Operator 10: document fingerprints by locally consistent parsing.

A text is parsed bottom up.  On each level runs of one symbol become a symbol; deterministic coin tossing relabels each
symbol by the lowest bit in which it differs from its left neighbour, until six labels are left; blocks begin at local maxima
of the labels, and the hash of a block's symbols names it on the next level.  A name depends on the block and on a few
symbols around it, never on offsets, so equal substrings share all their interior names.  The fingerprint is the
``SKETCH`` smallest distinct 32-bit names of level ``LOWEST`` and above and of the root, as hex; the likeness of two
fingerprints is the share of the smallest names of both together that both hold (1 for two empty ones).

Neighbours: documents stand in the order of doc_id, nulls first, ties by text; the next of the last is the first.  The table is
dealt into ranges of ids, each with a copy of the row that follows it, so one shuffle brings neighbours together
and a task streams through its ranges.

Results: a null text is empty; a lone document is its own next.  Repeated rows stay and are each other's neighbours.  An
empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import code_points, mix64, schema_of, texts_of

SKETCH = 64
LOWEST = 2
CHUNK = 1 << 19
PARTS_PER_TASK = 4
#: Ranges of ids at most: a task streams through its range, so a longer one takes time, not memory.
MAX_PARTS = 1 << 16
OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_MULTIPLIER = np.random.default_rng(10).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RUN = np.uint64(0xD6E8FEB86659FD93)


def _toss_table() -> np.ndarray:
    """The new label of b after a, for all labels below 128, at a * 128 + b."""
    a, b = np.divmod(np.arange(128 * 128), 128)
    x = a ^ b
    k = np.bitwise_count((x & -x) - 1)
    return (2 * k + (b >> k & 1)).astype(np.uint8)


_TOSS = _toss_table()


def block_starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where blocks begin; ``first`` marks the first symbol of each text, and no symbol equals its left neighbour."""
    one = symbols.dtype.type(1)
    apart = symbols.copy()
    apart[1:] ^= symbols[:-1]
    apart[first] = one
    k = np.bitwise_count((apart & (~apart + one)) - one)
    label = (k << np.uint8(1)) | ((symbols >> k) & one).astype(np.uint8)
    for _ in range(3):
        pair = label.astype(np.uint16)
        pair[1:] |= label[:-1].astype(np.uint16) << np.uint16(7)
        new = _TOSS[pair]
        new[first] = label[first] & 1
        label = new
    starts = first.copy()
    top = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    starts[1:-1] |= top
    return np.flatnonzero(starts)


def names(texts: list[str], lowest: int = LOWEST) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, 32-bit name) of all blocks from level ``lowest`` on and of all roots."""
    symbols, bounds = code_points(texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
    kept = []
    level = 0
    while len(symbols):
        first = np.ones(len(symbols), bool)
        first[1:] = owner[1:] != owner[:-1]
        # Runs of a symbol become one symbol.
        head = first.copy()
        head[1:] |= symbols[1:] != symbols[:-1]
        if not head.all():
            at = np.flatnonzero(head)
            size = np.diff(np.append(at, len(symbols)))
            symbols, owner, first = symbols[at], owner[at], first[at]
            repeated = size > 1
            symbols = symbols.astype(np.uint64)
            symbols[repeated] = mix64(symbols[repeated] * _RUN + size[repeated].astype(np.uint64))
        # Texts of one symbol are done: it names their root.
        alone = first.copy()
        alone[:-1] &= first[1:]
        if level >= lowest:
            kept.append((owner, symbols))
        elif alone.any():
            kept.append((owner[alone], symbols[alone]))
        if alone.any():
            symbols, owner, first = symbols[~alone], owner[~alone], first[~alone]
            if not len(symbols):
                break
        starts = block_starts(symbols, first)
        size = np.diff(np.append(starts, len(symbols)))
        at = np.arange(len(symbols)) - np.repeat(starts, size)
        symbols = mix64(np.add.reduceat((symbols.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER[at & 63], starts) + size.astype(np.uint64))
        owner = owner[starts]
        level += 1
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate([o for o, _ in kept]), np.concatenate([mix64(s.astype(np.uint64)) >> np.uint64(32) for _, s in kept]).astype(np.uint32)


def sketches(texts: list[str], size: int = SKETCH) -> list[np.ndarray]:
    owner, name = names(texts)
    keys = owner.astype(np.uint64) << np.uint64(32) | name
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = keys.astype(np.uint32)
    return [low[a:min(b, a + size)] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    if not len(a) and not len(b):
        return 1.0
    x, y = set(a.tolist()), set(b.tolist())
    both = x & y
    if not both:
        return 0.0
    smallest = sorted(x | y)[:size]
    return sum(v in both for v in smallest) / len(smallest)


def as_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Stream:
    """Rows of a range in order; a row's result comes when the next row is known."""

    def __init__(self):
        self.prior = None  # (part, whether it only follows, doc_id, text, sketch)
        self.rows: list[tuple] = []
        self.chars = 0

    def push(self, row: tuple) -> list[tuple] | None:
        self.rows.append(row)
        self.chars += len(row[3])
        return self.flush() if self.chars >= CHUNK else None

    def flush(self) -> list[tuple]:
        rows, self.rows, self.chars = self.rows, [], 0
        if not rows:
            return []
        rows = [(*r, s) for r, s in zip(rows, sketches([r[3] for r in rows]))]
        line = ([self.prior] if self.prior else []) + rows
        self.prior = line[-1]
        pairs = [(a, b) for a, b in zip(line, line[1:]) if not a[1] and a[0] == b[0]]
        edited = [edit(a[3], b[3]) for a, b in pairs]
        return [
            (a[2], len(a[3]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(a[4]), as_hex(s), likeness(a[4], s), likeness(a[4], b[4]))
            for (a, b), e, s in zip(pairs, edited, sketches(edited))
        ]


def _places(bounds: list[int]):
    """A function of ids: twice the number of bounds up to an id, and one more if it is a bound.  The bounds, at most
    ``MAX_PARTS``, are sent to the tasks as an array."""
    held = np.array(bounds, np.int64)

    @F.pandas_udf("bigint")
    def place(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy(np.int64)
        k = np.searchsorted(held, x, "right")
        return pd.Series(2 * k + ((k > 0) & (held[np.maximum(k - 1, 0)] == x)))

    return place


def with_neighbours(docs: DataFrame) -> DataFrame | None:
    """(part, follows, doc_id, text), dealt and sorted by part; the last rows of a part, marked ``follows``,
    are those that come next in the order.  None if there are no rows."""
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")
    n = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * PARTS_PER_TASK, MAX_PARTS)
    known = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("at"), F.min("doc_id").alias("low"), F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    if not known["all"]:
        return None
    # A bound is the id of a row, so no part is empty; part 0 begins with the first row.
    bounds = sorted({b for b in known["at"] or [] if b > known["low"]})
    nulls = known["all"] > known["n"]
    if nulls and known["n"]:
        bounds = [known["low"], *bounds]
    last = len(bounds)
    # Where a row stands; a null id before all.
    rows = rows.withColumn("_place", F.when(F.col("doc_id").isNotNull(), _places(bounds)(F.coalesce("doc_id", F.lit(0)))).otherwise(0) if bounds else F.lit(0))
    part = F.shiftright("_place", 1).cast("int")
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == known["low"]
    opens = F.col("_place").bitwiseAND(1) == 1
    places = F.array(F.struct(part.alias("part"), F.lit(False).alias("follows")))
    places = F.when(opens, F.concat(places, F.array(F.struct((part - 1).alias("part"), F.lit(True).alias("follows"))))).otherwise(places)
    places = F.when(is_first, F.concat(places, F.array(F.struct(F.lit(last).alias("part"), F.lit(True).alias("follows"))))).otherwise(places)
    dealt = rows.select(F.explode(places).alias("p"), "doc_id", "text").select("p.part", "p.follows", "doc_id", "text")
    return dealt.repartition("part").sortWithinPartitions("part", "follows", "doc_id", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    dealt = with_neighbours(docs)
    if dealt is None:
        return docs.sparkSession.createDataFrame([], OUT)
    arrow = to_arrow_schema(schema_of(OUT))

    def pack(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream()
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch)):
                if found := stream.push(row):
                    yield pack(found)
        if found := stream.flush():
            yield pack(found)

    return dealt.mapInArrow(run, schema_of(OUT))
