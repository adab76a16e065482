"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on the node, written to the shared checkpoint folder, so no group of
links is ever held by one task and a lost executor costs a recomputed partition.  A component of n nodes takes
O(log n) rounds in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from featurestats.session import work_path


def _write(df: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """``df`` of (u, v) as a table, with a count and a hash of its rows."""
    seen = Observation()
    path = work_path(df.sparkSession, name)
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), (seen.get["n"], seen.get["x"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (two bigint columns); root is the smallest node it reaches."""
    a, b = (F.col(c) for c in links.columns)
    edges, state = _write(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = _write(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "links")
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
