"""Order-dependent computations that stay balanced when one group is huge.

A window ``partitionBy(group).orderBy(x)`` sends a whole group to one task; if
one segment holds a third of the table that task holds a third of the table.
Both helpers here instead range-partition on ``(group, order)`` — so a hot
group is cut into many balanced slices — compute per slice, and stitch the
slices with a *small* table (one row per slice and group).

* ``exact_percentiles``: exact ``percentile`` (linear interpolation at
  ``q * (n - 1)``, as Spark's ``percentile`` and DuckDB's ``quantile_cont``)
  via a distributed prefix sum over value counts.
* ``runs``: gaps-and-islands — maximal runs of consecutive flagged rows per
  group, with runs crossing slice borders stitched exactly.

The slice id is a partition id, so the sliced frame is checkpointed (reliable
checkpoint in ``spark.checkpoint.dir``) before it is used twice: that pins
the slice assignment and cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root


def _slices(df: DataFrame, order_cols, n_slices: int | None) -> DataFrame:
    spark = df.sparkSession
    checkpoint_root(spark)
    n = n_slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order_cols).withColumn("_slice", F.spark_partition_id()).checkpoint(eager=True)


def join_groups(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join on columns of the same names, where a NULL group is a group like any other."""
    if how == "left_semi":
        right = right.select(*on).distinct()
    keys = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = [left[c].eqNullSafe(keys[f"_r_{c}"]) for c in on]
    return left.join(keys, cond, how).drop(*[f"_r_{c}" for c in on])


def value_ranks(counts: DataFrame, group_cols, n_slices: int | None = None) -> DataFrame:
    """Per value of a group (``counts``: *group_cols, _v, _c rows have it): n of the group, _lo and _hi, the value's ranks
    from 0 as [_lo, _hi)."""
    g = list(group_cols)
    sliced = _slices(counts, [*g, "_v"], n_slices)
    w_local = Window.partitionBy("_slice", *g).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_local", F.sum("_c").over(w_local))
    # one row per (slice, group): its total and its rank offset among earlier slices
    tot = sliced.groupBy("_slice", *g).agg(F.sum("_c").alias("_ptot"))
    w_off = Window.partitionBy(*g).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*g)
    offs = tot.select(
        "_slice",
        *g,
        F.coalesce(F.sum("_ptot").over(w_off), F.lit(0)).alias("_off"),
        F.sum("_ptot").over(w_all).alias("n"),
    )
    return join_groups(local, offs, ["_slice", *g]).select(
        *g,
        "_v",
        "n",
        (F.col("_off") + F.col("_local") - F.col("_c")).alias("_lo"),  # first 0-based rank of this value
        (F.col("_off") + F.col("_local")).alias("_hi"),  # one past its last rank
    )


def exact_percentiles(df: DataFrame, group_cols, value_col: str, quantiles: dict, n_slices: int | None = None):
    """Exact percentiles per group. ``quantiles`` maps output name → q in [0, 1].

    Output: *group_cols, n, <name>... (NULL when the group has no values)."""
    g = list(group_cols)
    counts = (
        df.where(F.col(value_col).isNotNull())
        .select(*g, F.col(value_col).cast("double").alias("_v"))
        .groupBy(*g, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))  # partial-aggregated: duplicates collapse map-side
    )
    ranked = value_ranks(counts, g, n_slices)
    aggs, finals = [], []
    hit_any = None
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("n") - 1)
        lo_i, hi_i = F.floor(pos), F.ceil(pos)
        has_lo = (F.col("_lo") <= lo_i) & (lo_i < F.col("_hi"))
        has_hi = (F.col("_lo") <= hi_i) & (hi_i < F.col("_hi"))
        hit = has_lo | has_hi
        hit_any = hit if hit_any is None else (hit_any | hit)
        aggs += [F.max(F.when(has_lo, F.col("_v"))).alias(f"{name}__lo"), F.max(F.when(has_hi, F.col("_v"))).alias(f"{name}__hi")]
        frac = pos - lo_i
        finals.append((F.col(f"{name}__lo") + frac * (F.col(f"{name}__hi") - F.col(f"{name}__lo"))).alias(name))
    picked = ranked.where(hit_any).groupBy(*g, "n").agg(*aggs)
    return picked.select(*g, F.col("n").cast("bigint").alias("n"), *finals)


def runs(df: DataFrame, group_cols, order_cols, flag: F.Column, min_len: int = 1, n_slices: int | None = None):
    """Maximal runs of consecutive rows with ``flag`` true, per group, ordered by
    ``order_cols`` (which must make the order total).

    Output: *group_cols, run_start (struct of order cols), run_end, run_len —
    only runs with ``run_len >= min_len``."""
    g, o = list(group_cols), list(order_cols)
    base = df.select(*g, *o, flag.alias("_f"))
    sliced = _slices(base, [*g, *o], n_slices)
    w = Window.partitionBy("_slice", *g).orderBy(*o)
    # classic island id inside the slice: rank among all rows minus rank among flagged rows
    local = sliced.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_frn", F.sum(F.col("_f").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    pieces = (
        local.where("_f")
        .groupBy("_slice", *g, (F.col("_rn") - F.col("_frn")).alias("_isl"))
        .agg(
            F.min(F.struct(*o)).alias("run_start"),
            F.max(F.struct(*o)).alias("run_end"),
            F.count(F.lit(1)).alias("_len"),
            F.min("_rn").alias("_first_rn"),
            F.max("_rn").alias("_last_rn"),
        )
    )
    sizes = sliced.groupBy("_slice", *g).agg(F.count(F.lit(1)).alias("_size"))
    pieces = join_groups(pieces, sizes, ["_slice", *g])
    # Stitch pieces that touch slice borders.  Per (slice, group): head = flagged
    # prefix piece, tail = flagged suffix piece (the same piece when the slice is
    # all flagged).  Slice j continues slice j-1 (previous slice holding the
    # group) when j has a head and j-1 a tail.  A chain starts at every slice
    # that is not "all flagged and continuing"; all pieces of a chain merge.
    heads_tails = pieces.groupBy("_slice", *g).agg(
        F.max(F.when(F.col("_first_rn") == 1, F.col("_len"))).alias("_head"),
        F.max(F.when(F.col("_last_rn") == F.col("_size"), F.col("_len"))).alias("_tail"),
    )
    ws = Window.partitionBy(*g).orderBy("_slice")  # one row per slice of a group: small
    info = join_groups(sizes, heads_tails, ["_slice", *g], "left")
    info = info.withColumn("_cont", F.col("_head").isNotNull() & F.lag("_tail").over(ws).isNotNull())
    info = info.withColumn("_full", F.coalesce(F.col("_head") == F.col("_size"), F.lit(False)))
    info = info.withColumn(
        "_chain",
        F.max(F.when(~(F.col("_full") & F.col("_cont")), F.col("_slice"))).over(
            ws.rowsBetween(Window.unboundedPreceding, 0)
        ),
    ).withColumn("_prev_chain", F.lag("_chain").over(ws))
    keyed = join_groups(pieces, info.select("_slice", *g, "_cont", "_chain", "_prev_chain"), ["_slice", *g]).withColumn(
        "_k",
        F.when(F.col("_last_rn") == F.col("_size"), F.col("_chain")).when(
            (F.col("_first_rn") == 1) & F.col("_cont"), F.col("_prev_chain")
        ),
    )
    inner = keyed.where(F.col("_k").isNull()).select(*g, "run_start", "run_end", "_len")
    merged = (
        keyed.where(F.col("_k").isNotNull())
        .groupBy(*g, "_k")
        .agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("_len").alias("_len"))
        .select(*g, "run_start", "run_end", "_len")
    )
    out = inner.unionByName(merged)
    return out.where(F.col("_len") >= min_len).select(
        *g, "run_start", "run_end", F.col("_len").cast("bigint").alias("run_len")
    )


def peak_running_sum(df: DataFrame, group_cols, order_cols, value_col: str, n_slices: int | None = None) -> DataFrame:
    """The largest running sum of ``value_col`` per group in the order of ``order_cols``.

    Output: *group_cols, peak.  Slices give their sum and their own peak; a slice's peak counts from the sum of the
    group's earlier slices."""
    g, o = list(group_cols), list(order_cols)
    sliced = _slices(df.select(*g, *o, F.col(value_col).alias("_x")), [*g, *o], n_slices)
    w = Window.partitionBy("_slice", *g).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    per = sliced.withColumn("_run", F.sum("_x").over(w)).groupBy("_slice", *g).agg(F.sum("_x").alias("_sum"), F.max("_run").alias("_peak"))
    before = Window.partitionBy(*g).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    return per.withColumn("_off", F.coalesce(F.sum("_sum").over(before), F.lit(0))).groupBy(*g).agg(
        F.max(F.col("_off") + F.col("_peak")).alias("peak"))
