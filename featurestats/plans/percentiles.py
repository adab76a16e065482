"""Exact window percentiles guided by the stored sketches (M7).

The merged KLL sketches of a window bound each percentile to a narrow band of values.  One scan counts the rows below the band
and gathers the band's values with their counts; the exact order statistics lie among these, at known ranks.  Should a rank
fall outside its band (a sketch's error is only probable), that band is widened and scanned again, in the end to all values.
So nothing is sorted but the band, a few per cent of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import PERCENTILES, state_name
from ..operators.arrivals import ArrivalIndex, date_in_days
from ..operators.ordered import join_groups, value_ranks
from .cube import Cube
from .rollup import time_in_days

#: The band around a rank, to each side: over twice the sketches' usual error.
MARGIN = 0.03
WIDER = 4
#: Percentiles asked for (40 bytes each) up to which they are broadcast.
BROADCAST = 100_000
GROUP = ["feature", "segment_value"]


def bands(states: DataFrame, cube: Cube, days, quantiles: dict[str, float], margin: float) -> DataFrame:
    """(feature, segment_value, measure, q, n, low, high): one small row for each percentile asked for."""
    mine = states.where((F.col("tenant") == F.lit(cube.tenant)) & date_in_days("stat_date", days))
    merged = mine.groupBy("segment_value").agg(
        *[F.sum(state_name(f, "cnt")).alias(f"{f}__n") for f in cube.features],
        *[F.kll_merge_agg_double(state_name(f, "pct_state")).alias(f"{f}__s") for f in cube.features])
    rows = []
    for f in cube.features:
        for name, q in quantiles.items():
            at = lambda rank, f=f: F.when(F.col(f"{f}__n") > 0, F.kll_sketch_get_quantile_double(F.col(f"{f}__s"), F.lit(rank)))
            low = at(q - margin) if q - margin > 0 else F.lit(float("-inf"))
            high = at(q + margin) if q + margin < 1 else F.lit(float("inf"))
            rows.append(F.struct(F.lit(f).alias("feature"), F.lit(name).alias("measure"), F.lit(q).alias("q"),
                                 F.col(f"{f}__n").alias("n"), low.alias("low"), high.alias("high")))
    return merged.select("segment_value", F.inline(F.array(*rows))).where("n > 0")


def window_percentiles(fact: DataFrame, cube: Cube, states: DataFrame, days, quantiles: dict[str, float] | None = None,
                       margin: float = MARGIN, arrivals: ArrivalIndex | None = None) -> DataFrame:
    """(feature, segment_value, measure, n, value, band_share): exact percentiles (linear interpolation) over the window, and
    the share of the rows that were gathered.  ``states``: daily states with percentile sketches of all these days."""
    quantiles = quantiles or PERCENTILES
    days = sorted(set(days))
    rows = fact.where(time_in_days(cube.time_col, days))
    if arrivals is not None and "processing_day" in fact.columns:
        rows = rows.where(arrivals.holds(days))
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in cube.features])
    long = rows.select(cube.dimension.segment().alias("segment_value"), F.inline(items)).where("x IS NOT NULL")
    todo, found = bands(states, cube, days, quantiles, margin).checkpoint(), None
    while not todo.isEmpty():
        hit = _scan(long, todo).checkpoint()
        good = hit.where("value IS NOT NULL")
        found = good if found is None else found.unionByName(good)
        margin *= WIDER
        wider = bands(states, cube, days, quantiles, margin)
        missed = hit.where("value IS NULL").select(*GROUP, "measure")
        todo = join_groups(wider, missed, [*GROUP, "measure"], "left_semi").checkpoint()
    if found is None:
        found = _scan(long.limit(0), todo)
    return found.select(*GROUP, "measure", "n", "value", "band_share")


def _scan(long: DataFrame, wanted: DataFrame) -> DataFrame:
    """One scan for these bands; ``value`` is NULL where a rank lies outside its band."""
    keys = [*GROUP, "measure"]
    asked = wanted.groupBy(*GROUP).agg(F.collect_list(F.struct("measure", "low", "high")).alias("asked"))
    # Small: a row for each segment and feature.  Beyond the bound Spark shuffles, and splits a hot segment as a skewed join.
    side = F.broadcast(asked) if wanted.limit(BROADCAST + 1).count() <= BROADCAST else asked
    met = join_groups(long, side, GROUP).select(*GROUP, "x", F.inline("asked"))
    # NaN sorts above all numbers here and in ``low``/``high``, so it is in the top band alone.
    place = met.where("x <= high OR high = double('infinity')").select(*keys, F.when(F.col("x") >= F.col("low"), F.col("x")).alias("v"))
    counted = place.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))  # a row for those below, one for each value of the band
    below = counted.where("v IS NULL").select(*keys, F.col("c").alias("below"))
    inside = counted.where("v IS NOT NULL").select(*keys, F.col("v").alias("_v"), F.col("c").alias("_c"))
    ranked = value_ranks(inside, keys).withColumnRenamed("n", "band")
    context = join_groups(wanted.select(*keys, "q", F.col("n").alias("rows")), below, keys, "left")
    at = join_groups(ranked, context, keys)
    low, high = F.col("_lo") + F.coalesce("below", F.lit(0)), F.col("_hi") + F.coalesce("below", F.lit(0))
    pos = F.col("q") * (F.col("rows") - 1)
    at = at.withColumn("a", F.when((low <= F.floor(pos)) & (F.floor(pos) < high), F.col("_v"))).withColumn(
        "b", F.when((low <= F.ceil(pos)) & (F.ceil(pos) < high), F.col("_v")))
    picked = at.groupBy(*keys, "q", "rows", "band").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    frac = F.col("q") * (F.col("rows") - 1) - F.floor(F.col("q") * (F.col("rows") - 1))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + frac * (F.col("b") - F.col("a")))
    got = picked.select(*keys, value.alias("value"), (F.col("band") / F.col("rows")).alias("band_share"))
    return join_groups(wanted.select(*keys, "n"), got, keys, "left")
