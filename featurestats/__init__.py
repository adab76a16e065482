"""featurestats: a Spark-native feature-statistics engine.

Sub-packages
------------
sources     readers for the driver tables, raw event messages, snapshots, metadata
functions   column-expression builders (types, coercion, cube measures)
operators   DataFrame transforms: resolution, dedup, pruning, backfill, layout, profiles, audit
plans       cube specification, rollup build/refresh, window statistics serve planner
streaming   Structured Streaming resolution and dedup
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
