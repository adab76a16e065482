"""Operator 4: SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprint: XXH64 (seed 42) of every ``SHINGLE``-word shingle of the text, A-Z lower-cased; a bit is set if it is set
in over half the hashes.  Equal fingerprints are one node.  Two fingerprints at most ``BITS`` apart agree on one of
BITS + 1 blocks of bits, so nodes are dealt out once for each block by the block's value (by two or more blocks of more,
if there are very many).  Within such a bucket they stand in Gray order; a hierarchy over the order holds, in each node, the bits all its fingerprints share (mask and
pattern), less those its parent holds.  A query goes down adding the differences met so far and drops a whole group as
soon as they exceed BITS.  A bucket over ``BUCKET`` nodes is range-partitioned by Gray rank into chunks, and
pairs of its chunks are searched wherever their shared bits allow, so no task holds more, whatever the data.  Each
search gives a spanning forest of its links, not all pairs.

Results: a text without words (null, empty, blanks) has fingerprint zero, linked like any other.  A null doc_id counts
as larger than any other (component_id is null only if the whole component has none).  Repeated rows stay, each with the
same result.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_ids, materialize, scan, schema_of, texts_of
from .components import components

SHINGLE = 4
BITS = 4
BUCKET = 1 << 13
FAN = 16
ROWS = 1 << 17  # rows that a task of the search takes at once
QUERIES = 512  # queries that go down the index together
SEED = 42


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - ends[0])[: len(words) - shingle + 1].copy()
    starts[1:] = ends[: len(words) - shingle]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1:] - 1).tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k:k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp); fp is the fingerprint as a signed 64-bit number."""

    def make():
        def step(batch: pa.RecordBatch):
            fps = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64)
            return [batch.column(0), pa.array(fps.view(np.int64))]

        return step

    return scan(docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text"), make, "doc_id bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where each number stands in the sequence of the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Hierarchies over buckets of fingerprints; ``bucket`` is ascending, rows of a bucket stand together."""

    def __init__(self, fps: np.ndarray, bucket: np.ndarray, fan: int = FAN):
        self.order = np.lexsort((gray_rank(fps), bucket))
        self.fps, self.bucket = fps[self.order], bucket[self.order]
        both, some, owner = self.fps, self.fps, self.bucket
        self.levels = []  # bottom up: (first row of each node, mask, pattern)
        first = np.arange(len(fps))
        while True:
            self.levels.append([first, ~(both ^ some), both])
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            if len(begin) == len(owner):
                break
            within = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
            start = np.flatnonzero(within % fan == 0)
            both, some = np.bitwise_and.reduceat(both, start), np.bitwise_or.reduceat(some, start)
            self.levels[-1].append(start)  # children of the nodes above
            owner, first = owner[start], first[start]
        # What a node adds to its parent's mask.
        for low, high in zip(self.levels, self.levels[1:]):
            size = np.diff(np.append(low[3], len(low[0])))
            low[1] = low[1] & ~np.repeat(high[1], size)
        self.root = np.searchsorted(owner, self.bucket)

    def pairs(self, begin: int, end: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Row pairs (i, j), begin <= i < end and i < j, of one bucket and at most ``bits`` apart."""
        row = np.arange(begin, end)
        node, apart = self.root[begin:end], np.zeros(end - begin, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            first, mask, pattern, children = *self.levels[level - 1][:3], self.levels[level - 1][3]
            stop = np.append(children[1:], len(first))
            size = (stop - children)[node]
            row, apart = np.repeat(row, size), np.repeat(apart, size)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            node = np.repeat(children[node], size) + offset
            last = np.append(first[1:], len(self.fps))[node]  # rows below end here
            later = last > row + 1
            row, node, apart = row[later], node[later], apart[later]
            apart = apart + np.bitwise_count((self.fps[row] ^ pattern[node]) & mask[node])
            near = apart <= bits
            row, node, apart = row[near], node[near], apart[near]
        return (row, node) if len(self.levels) > 1 else (row[:0], row[:0])

    def forest(self, bits: int, queries: int = QUERIES) -> tuple[np.ndarray, np.ndarray]:
        """Links that join what ``pairs`` would: each row to the first row of its part."""
        label = np.arange(len(self.fps))
        for begin in range(0, len(self.fps), queries):
            i, j = self.pairs(begin, min(begin + queries, len(self.fps)), bits)
            while True:
                a, b = label[i], label[j]
                open_ = a != b
                if not open_.any():
                    break
                i, j, a, b = i[open_], j[open_], a[open_], b[open_]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label != (above := label[label])).any():
                    label = above
        linked = np.flatnonzero(label != np.arange(len(label)))
        return self.fps[linked], self.fps[label[linked]]


def masks(n: int, bits: int) -> list[int]:
    """Masks such that fingerprints at most ``bits`` apart agree on one of them at least.

    Of bits + k blocks, k are free of differences; k grows with the number of nodes, so that by chance a bucket
    gets about a thousand."""
    k = 1
    while k < 4 and n >> 64 * k // (bits + k) > 1024:
        k += 1
    cuts = [round(64 * i / (bits + k)) for i in range(bits + k + 1)]
    blocks = [(1 << z) - (1 << a) for a, z in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(blocks, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(nodes: DataFrame, over: list[int]) -> DataFrame:
    """Each fp once for each mask, in the bucket (used, val) of its bits under the mask."""
    rows = nodes.select("fp", F.explode(F.array(*(F.lit(_signed(m)).cast("bigint") for m in over))).alias("used"))
    return rows.withColumn("val", F.expr("fp & used"))


def _in_chunks(rows: DataFrame, n: int, size: int) -> DataFrame:
    """Rows of large buckets cut in Gray order into chunks of at most ``size``: (fp, used, val, chunk)."""
    rank = F.expr("aggregate(array(1, 2, 4, 8, 16, 32), fp, (x, s) -> x ^ shiftrightunsigned(x, s))")
    ordered = rows.withColumn("rank", rank).repartitionByRange(max(1, n // size), "used", "val", "rank").sortWithinPartitions("used", "val", "rank")

    def run(batches):
        part, key, number, held = TaskContext.get().partitionId() << 32, None, 0, 0
        for batch in batches:
            used, val = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            chunk = np.empty(len(used), np.int64)
            for k, own in enumerate(zip(used.tolist(), val.tolist())):
                if own != key or held == size:
                    key, held, number = own, 0, number + 1
                chunk[k], held = part + number, held + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(chunk)], names=["fp", "used", "val", "chunk"])

    return ordered.mapInArrow(run, schema_of("fp bigint, used bigint, val bigint, chunk bigint"))


def _chunk_pairs(chunked: DataFrame, bits: int) -> DataFrame:
    """Rows (fp, used, val) of each pair of chunks of one bucket, ``val`` being the pair.  A pair is left out if the
    bits that all fingerprints of each chunk share are too many apart already."""
    nodes = chunked.groupBy("used", "val", "chunk").agg(F.expr("bit_and(fp)").alias("low"), F.expr("bit_or(fp)").alias("high"))
    nodes = materialize(nodes.select("used", "val", "chunk", "low", F.expr("~(low ^ high)").alias("mask")), "simhash-chunks")
    left, right = (nodes.select("used", "val", *(F.col(c).alias(f"{c}{k}") for c in ("chunk", "low", "mask"))) for k in (1, 2))
    pairs = left.join(right, ["used", "val"]).where("chunk1 <= chunk2 AND bit_count((low1 ^ low2) & mask1 & mask2) <= " + str(bits))
    pairs = pairs.withColumn("pair", F.monotonically_increasing_id())
    sides = materialize(pairs.select("pair", F.explode(F.array_distinct(F.array("chunk1", "chunk2"))).alias("chunk")), "simhash-pairs")
    return chunked.join(sides, "chunk").select("fp", F.lit(0).cast("bigint").alias("used"), F.col("pair").alias("val"))


def _search(dealt: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) within buckets of equal (used, val), none of them over BUCKET rows."""

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def take(rows: np.ndarray):
            begin = np.concatenate([[True], (rows[1:, 1:] != rows[:-1, 1:]).any(1)])
            a, b = GrayIndex(rows[:, 0].view(np.uint64), np.cumsum(begin)).forest(bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            size += batch.num_rows
            if size >= ROWS:
                rows = np.concatenate(held)
                end = size - np.argmax((rows[::-1, 1:] != rows[-1, 1:]).any(1))  # the last bucket may go on
                if (rows[0, 1:] != rows[-1, 1:]).any():
                    yield take(np.ascontiguousarray(rows[:end]))
                    rows = rows[end:]
                held, size = [rows], len(rows)
        if size:
            yield take(np.concatenate(held))

    ordered = dealt.repartition("used", "val").sortWithinPartitions("used", "val")
    return ordered.mapInArrow(run, schema_of("a bigint, b bigint"))


def links(nodes: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect what is at most ``bits`` apart in ``nodes`` (one bigint column fp, distinct)."""
    dealt = materialize(_deal(nodes, masks(nodes.count(), bits)), "simhash-dealt")
    large = materialize(dealt.groupBy("used", "val").count().where(F.col("count") > bucket), "simhash-large")
    rows = large.agg(F.sum("count")).first()[0]
    if not rows:
        return _search(dealt, bits)
    small = dealt.join(large, ["used", "val"], "left_anti").select("fp", "used", "val")
    hot = dealt.join(large, ["used", "val"], "left_semi").select("fp", "used", "val")
    chunked = materialize(_in_chunks(hot, rows, max(1, bucket // 2)), "simhash-chunked")
    return _search(small.unionByName(_chunk_pairs(chunked, bits)), bits)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, root, component_id); root is the component's smallest fp."""
    rows = materialize(fingerprints(docs, shingle), "simhash-rows")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(lows, "root"), "fp").select("doc_id", "fp", "root", "component_id")


def hex_fingerprint(fp: str) -> "F.Column":
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` (all columns), one of each component: that with the smallest doc_id."""
    thin = materialize(near_duplicates(docs, shingle, bits), "simhash-components")
    odd = materialize(thin.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("odd_id")), "simhash-odd")
    keep = thin.where("doc_id = component_id").join(odd, F.col("doc_id") == F.col("odd_id"), "left_anti")
    kept = keep_ids(docs, materialize(keep.select(F.col("doc_id").alias("keep_id")), "simhash-keep"))
    if odd.isEmpty():
        return kept

    # Ids that stand for several rows, or none: such rows are told apart by their fingerprint.
    twins = docs.join(odd, docs["doc_id"].eqNullSafe(odd["odd_id"]), "left_semi")
    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, "__fp"])

    parts = thin.select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), F.col("component_id").alias("__component")).distinct()
    one = (twins.mapInArrow(run, schema).join(parts, "__fp").where(F.col("doc_id").eqNullSafe(F.col("__component")))
           .dropDuplicates(["__root"]).select(*docs.columns))
    return kept.unionByName(one)
