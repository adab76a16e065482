"""Operator 13: exact top-k inner products by a pivot-distance index.

Vectors are scaled to integers.  Each is keyed by its nearest pivot (pivots: a farthest-first walk over a bounded sample) and
its distance from it.  Sorted by that key, consecutive vectors of a pivot are packed into annuli of at most ``ANNULUS`` rows,
each with its inner and outer distance and its longest vector (``index_vectors``).  Queries are packed into slices in the same
order; each brings the k-th best score within its own annulus as a first threshold.

For a query q, a pivot p and a vector v of an annulus [lo, hi] around p, the triangle inequality gives
``|q - v| >= gap = max(0, lo - |q - p|, |q - p| - hi)``, hence ``q.v <= (|q|^2 + max|v|^2 - gap^2) / 2``, and also
``q.v <= q.p + |q| hi``.  A slice visits the annuli whose bound reaches the least of its thresholds.  In a task, a slice's
annuli come by falling bound; each is compared with the queries whose own bound reaches their running threshold, and the task
stops at the first bound below all thresholds.  Any pivots give the exact answer; good ones save work.

Results: exact, whatever the data.  Rows with a null id or vector, or with null or non-finite components, take no part.  An id
names one vector: of repeated rows with one id the greatest vector counts.  Only vectors of one length are compared; empty
ones have score 0.  Ties go to the smaller id.  Components beyond the range of a long stand at its ends, and so do scores.
Empty tables, or queries without candidates, give no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, schema_of

SCALE = 256
TOP = 5
#: Rows from which pivots are chosen, and pivots of one vector length at most.
SAMPLE, PIVOTS = 4096, 64
#: Vectors of an annulus, queries of a slice.
ANNULUS = SLICE = 1024
#: Annuli that one task takes for a slice, about.
LANE = 16
LEAST = np.iinfo(np.int64).min

KEYED = "dim int, pivot int, dist double, vec_id bigint, vec array<bigint>, is_query boolean"
#: kind 0: an annulus; kind 1: the queries in it, with the k-th best score they find there.
PACKED = ("kind int, id bigint, dim int, pivot int, lo double, hi double, norm double, "
          "ids array<bigint>, width int, vecs binary, bar array<bigint>")
REACHES = "id bigint, dim int, pivot int, near double, far double, q_norm double, q_dot double, bar bigint"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def integers(vectors: DataFrame, id_column: str, vector_column: str, is_query: Column) -> DataFrame:
    """(vec_id, vec, is_query) of the rows that take part."""
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform("vec", lambda x: F.floor(x.cast("double") * SCALE))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite).select("vec_id", whole.alias("vec"))
    return rows.groupBy("vec_id").agg(F.max("vec").alias("vec")).withColumn("is_query", is_query)


def choose_pivots(rows: DataFrame, sample: int = SAMPLE, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots of each vector length in a sample: the sample's first vector, then always the one farthest from all chosen."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").collect()
    by_dim: dict[int, list] = {}
    for (v,) in drawn:
        by_dim.setdefault(len(v), []).append(v)
    out = {}
    for dim, vs in by_dim.items():
        x = np.array(vs, np.float64).reshape(len(vs), dim)
        chosen, away = [0], np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < pivots and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, np.linalg.norm(x - x[chosen[-1]], axis=1))
        out[dim] = x[chosen]
    return out


def pivots_of(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return pivots[dim] if dim in pivots else np.zeros((1, dim))


def keyed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Each vector with its nearest pivot and its distance from it."""
    schema = to_arrow_schema(schema_of(KEYED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1)
            flat, first = vecs.values.to_numpy().astype(np.float64), vecs.offsets.to_numpy().astype(np.int64)
            dims = np.diff(first)
            pivot, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x, p = flat[first[at][:, None] + np.arange(dim)], pivots_of(pivots, dim)
                pivot[at] = ((p * p).sum(1) - 2 * (x @ p.T)).argmin(1)
                dist[at] = np.linalg.norm(x - p[pivot[at]], axis=1)
            columns = [pa.array(dims.astype(np.int32)), pa.array(pivot), pa.array(dist), batch.column(0), vecs.cast(schema.field("vec").type), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.select("vec_id", "vec", "is_query").mapInArrow(run, schema_of(KEYED))


def narrow(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes of a number, the numbers) in the narrowest integers that hold them."""
    most = max(int(x.max()), -int(x.min()) - 1) if x.size else 0
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return width, x.astype(f"<i{width}").tobytes()


def wide(data: bytes, width: int, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(n, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two integer arrays: in floats while every partial sum is exact there."""
    bound = np.sqrt((a.astype(np.float64) ** 2).sum(1).max(initial=0) * (b.astype(np.float64) ** 2).sum(1).max(initial=0))
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)


def best_of(row: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best of each row (ascending rows): high scores first, then small ids."""
    order = np.lexsort((ids, -score, row))
    sorted_row = row[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_row, sorted_row) < top]


def index_vectors(rows: DataFrame, n_parts: int, top: int) -> DataFrame:
    """Annuli and the queries in each, packed (``PACKED``), as a table."""
    schema = to_arrow_schema(schema_of(PACKED))

    def pack(held: list[tuple], number: int):
        dim, pivot = held[0][0], held[0][1]
        ids = np.array([r[3] for r in held], np.int64)
        x = np.array([r[4] for r in held], np.int64).reshape(len(held), dim)
        norm = float(np.linalg.norm(x.astype(np.float64), axis=1).max())
        yield (0, number, dim, pivot, held[0][2], held[-1][2], norm, ids, *narrow(x), [])
        q = np.flatnonzero([r[5] for r in held])
        if len(q):
            bar = np.full(len(q), LEAST)
            if len(held) > top:
                score = products(x[q], x)
                score[np.arange(len(q)), q] = LEAST
                bar = np.partition(score, len(held) - top, axis=1)[:, len(held) - top]
            yield (1, number, dim, pivot, held[0][2], held[-1][2], norm, ids[q], *narrow(x[q]), bar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def packed():
            nonlocal number
            number += 1
            rows = [*pack(held, number)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == ANNULUS or held[0][:2] != r[:2]):
                    yield packed()
                    held = []
                held.append(r)
        if held:
            yield packed()

    by = ["dim", "pivot", "dist", "vec_id"]
    return materialize(rows.repartitionByRange(n_parts, *by).sortWithinPartitions(*by).mapInArrow(run, schema_of(PACKED)), "nearest-index")


def slices_of(index: DataFrame, n_parts: int) -> DataFrame:
    """The queries of several annuli together, up to ``SLICE``, as a table like the index (kind 1)."""
    schema = to_arrow_schema(schema_of(PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def packed():
            nonlocal number
            number += 1
            dim = held[0]["dim"]
            x = np.concatenate([wide(r["vecs"], r["width"], len(r["ids"]), dim) for r in held])
            norm = float(np.linalg.norm(x.astype(np.float64), axis=1).max())
            row = (1, number, dim, -1, 0.0, 0.0, norm, np.concatenate([r["ids"] for r in held]), *narrow(x), np.concatenate([r["bar"] for r in held]))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (held[0]["dim"] != r["dim"] or sum(len(h["ids"]) for h in held) + len(r["ids"]) > SLICE):
                    yield packed()
                    held = []
                held.append(r)
        if held:
            yield packed()

    # Few rows of a bounded size each; no shuffle.
    return materialize(index.where("kind = 1").coalesce(n_parts).mapInArrow(run, schema_of(PACKED)), "nearest-slices")


def reaches(slices: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """For each slice and pivot: how near and far the queries are, their longest, the best product with the pivot."""
    schema = to_arrow_schema(schema_of(REACHES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                p = pivots_of(pivots, r["dim"])
                x = wide(r["vecs"], r["width"], len(r["ids"]), r["dim"]).astype(np.float64)
                near, far, dot = np.full(len(p), np.inf), np.zeros(len(p)), np.full(len(p), -np.inf)
                for k, one in enumerate(p):
                    d = np.linalg.norm(x - one, axis=1)
                    near[k], far[k], dot[k] = d.min(), d.max(), (x @ one).max()
                n = len(p)
                columns = [np.full(n, r["id"]), np.full(n, r["dim"], np.int32), np.arange(n, dtype=np.int32), near, far, np.full(n, r["norm"]), dot, np.full(n, min(r["bar"]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return slices.select("id", "dim", "ids", "width", "vecs", "norm", "bar").mapInArrow(run, schema_of(REACHES))


#: Bounds are floats: this much is granted to them.
SLACK = 1e-9


def upper_bound(q_norm, q_dot, gap, norm, hi, least):
    """The largest product that the triangle inequality allows (columns or arrays)."""
    by_gap, by_pivot = (q_norm * q_norm + norm * norm - gap * gap) / 2, q_dot + q_norm * hi
    bound = least(by_gap, by_pivot) + SLACK * (q_norm * q_norm + norm * norm + hi * hi) + SLACK
    return -least(-bound, 0 * bound - float(LEAST))  # scores stop at the end of a long, too


def compare(work: DataFrame, pivots: dict[int, np.ndarray], top: int) -> DataFrame:
    """The best of each query in each lane: a slice's row comes first, then its annuli by falling bound."""
    schema = to_arrow_schema(schema_of(FOUND))

    class Lane:
        def __init__(self, key, r):
            self.key, self.over = key, False
            self.dim, self.ids = r["dim"], np.array(r["ids"], np.int64)
            self.x = wide(r["vecs"], r["width"], len(self.ids), self.dim)
            self.real = self.x.astype(np.float64)
            self.norm, self.bar = np.linalg.norm(self.real, axis=1), np.array(r["bar"], np.int64)
            self.row, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

        def visit(self, r):
            if self.over or r["bound"] < self.bar.min():
                self.over = True  # bounds only fall from here
                return
            p = pivots_of(pivots, self.dim)[r["pivot"]]
            away = np.linalg.norm(self.real - p, axis=1)
            gap = np.maximum(0, np.maximum(r["lo"] - away, away - r["hi"]))
            at = np.flatnonzero(upper_bound(self.norm, self.real @ p, gap, r["norm"], r["hi"], np.minimum) >= self.bar)
            if not len(at):
                return
            ids = np.array(r["ids"], np.int64)
            score = products(self.x[at], wide(r["vecs"], r["width"], len(ids), self.dim))
            q, v = np.nonzero((score >= self.bar[at][:, None]) & (ids[None, :] != self.ids[at][:, None]))
            row, ids, score = np.concatenate([self.row, at[q]]), np.concatenate([self.id, ids[v]]), np.concatenate([self.score, score[q, v]])
            best = best_of(row, ids, score, top)
            self.row, self.id, self.score = row[best], ids[best], score[best]
            last = np.flatnonzero(np.arange(len(best)) - np.searchsorted(self.row, self.row) == top - 1)
            self.bar[self.row[last]] = np.maximum(self.bar[self.row[last]], self.score[last])

        def found(self):
            return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.id), pa.array(self.score)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = None
        for batch in batches:
            for k in range(len(batch)):
                r = batch.slice(k, 1).to_pylist()[0]
                key = (r["slice"], r["lane"])
                if lane is None or key != lane.key:
                    if lane is not None:
                        yield lane.found()
                    lane = Lane(key, r)
                else:
                    lane.visit(r)
        if lane is not None:
            yield lane.found()

    return work.mapInArrow(run, schema_of(FOUND))


def top_k(vectors: DataFrame, is_query: Column, top: int = TOP, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``top`` highest inner products of each query (``is_query``: a condition on ``vec_id``) with the other vectors."""
    spark = vectors.sparkSession
    rows = materialize(integers(vectors, id_column, vector_column, is_query), "nearest-integers")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    pivots = choose_pivots(rows)
    index = index_vectors(keyed(rows, pivots), max(1, -(-n // (4 * ANNULUS))), top)
    slices = slices_of(index, max(1, -(-n_queries // (4 * SLICE))))
    annuli = index.where("kind = 0")

    reach = reaches(slices, pivots).alias("s")
    gap = F.greatest(F.lit(0.0), F.col("a.lo") - F.col("s.far"), F.col("s.near") - F.col("a.hi"))
    bound = upper_bound(F.col("s.q_norm"), F.col("s.q_dot"), gap, F.col("a.norm"), F.col("a.hi"), F.least)
    lanes = max(1, -(-annuli.count() // LANE))
    visits = materialize(
        reach.join(annuli.select("id", "dim", "pivot", "lo", "hi", "norm").alias("a"), ["dim", "pivot"])
        .select(F.col("s.id").alias("slice"), F.col("a.id").alias("id"), F.pmod(F.xxhash64("a.id"), F.lit(lanes)).alias("lane"), bound.alias("bound"), "s.bar")
        .where("bound >= bar").drop("bar"), "nearest-visits")

    payload = ["dim", "pivot", "lo", "hi", "norm", "ids", "width", "vecs", "bar"]
    asked = (visits.select("slice", "lane").distinct().join(slices.withColumnRenamed("id", "slice"), "slice")
             .select("slice", "lane", F.lit(float("inf")).alias("bound"), F.lit(0).alias("turn"), *payload))
    taken = visits.join(annuli, "id").select("slice", "lane", "bound", F.lit(1).alias("turn"), *payload)
    work = asked.unionByName(taken).repartition("slice", "lane").sortWithinPartitions("slice", "lane", "turn", F.desc("bound"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (compare(work, pivots, top).select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
            .where(F.col("rank") <= top))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.vec, v.vec) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
