"""Dimension and cube specifications."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.measures import MEASURES, NUMERIC_MEASURES

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Dimension:
    """``type='expression'``: a SQL expression (e.g. ``CASE WHEN ...``);
    ``type='column'``: a raw column.  Either way the segment is a string and a
    NULL segment is kept as its own group."""

    name: str
    expr: str
    type: str = "expression"
    tenant: str = "default"

    def segment(self) -> Column:
        if self.type == "expression":
            return F.expr(self.expr).cast("string")
        if self.type == "column":
            return F.col(self.expr).cast("string")
        raise ValueError(f"dimension type must be 'expression' or 'column', got {self.type!r}")


@dataclass(frozen=True)
class Cube:
    name: str
    dimension: Dimension
    features: tuple[str, ...]
    measures: tuple[str, ...] = MEASURES
    tenant: str = "default"
    time_col: str = "eventTime"

    def __post_init__(self):
        object.__setattr__(self, "features", tuple(self.features))
        object.__setattr__(self, "measures", tuple(self.measures))

    def rollup_name(self, feature: str) -> str:
        """Naming rule of the per-feature rollup: ``mv_{tenant}_{dimension}_{feature}``."""
        clean = lambda s: re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
        return f"mv_{clean(self.tenant)}_{clean(self.dimension.name)}_{clean(feature)}"


@dataclass
class Validation:
    ok: bool
    errors: list[str] = field(default_factory=list)


def validate(cube: Cube, fact: DataFrame) -> Validation:
    """Stage 1 and 2 of the spec check, by analysis only (no job runs).

    Names must exist, the dimension expression must analyse, measures must be
    known and numeric measures need numeric features."""
    errors: list[str] = []
    cols = {f.name: f.dataType for f in fact.schema.fields}
    try:
        fact.select(cube.dimension.segment()).schema  # analysis, no execution
    except AnalysisException as e:  # pragma: no branch
        errors.append(f"dimension {cube.dimension.name}: {e.getMessage() if hasattr(e, 'getMessage') else e}")
    if cube.time_col not in cols:
        errors.append(f"time column {cube.time_col} missing")
    bad = [m for m in cube.measures if m not in MEASURES]
    if bad:
        errors.append(f"unknown measures {bad}")
    for f in cube.features:
        if f not in cols:
            errors.append(f"feature {f} missing")
            continue
        numeric = isinstance(cols[f], NUMERIC_TYPES)
        wrong = [m for m in cube.measures if (m in NUMERIC_MEASURES or m in ("min", "max")) and not numeric]
        if wrong:
            errors.append(f"feature {f} ({cols[f].simpleString()}) does not support {wrong}")
    return Validation(ok=not errors, errors=errors)


def feature_compatibility(df: DataFrame, features) -> DataFrame:
    """One-pass deep check (C14): per feature, rows, non-null values and how
    many of those parse as numbers.  Long form: feature, n_rows, n_present,
    n_numeric, numeric_rate."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for f in features:
        aggs.append(F.count(F.col(f)).alias(f"{f}__present"))
        aggs.append(F.count(F.expr(f"try_cast(cast(`{f}` as string) as double)")).alias(f"{f}__numeric"))
    wide = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"{f}__present").alias("n_present"),
                F.col(f"{f}__numeric").alias("n_numeric"),
            )
            for f in features
        ]
    )
    return wide.select("n_rows", F.inline(rows)).select(
        "feature",
        "n_rows",
        "n_present",
        "n_numeric",
        F.try_divide(F.col("n_numeric").cast("double"), F.col("n_present").cast("double")).alias("numeric_rate"),
    )
