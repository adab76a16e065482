"""Event resolution R1-R10: raw JSON messages → the wide typed event table.

Metadata (published features, event attributes) is tiny and is collected on
the driver once per metadata version to *generate one projection*: one
``try_cast``-style expression per output column over the parsed maps.  No
explode / pivot / join of the event stream is needed; the whole resolution is
a single narrow ``select`` that runs inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import bad_ints, coerce_variant, epoch_to_timestamp, int_array, to_boolean, to_int
from ..functions.types import stream_type

# The fixed columns of the event table, in order, with types.
FIXED_COLUMNS = [
    ("eventId", T.StringType()),
    ("eventType", T.StringType()),
    ("userId", T.StringType()),
    ("eventTime", T.TimestampType()),
    ("processingTime", T.TimestampType()),
    ("rules", T.ArrayType(T.IntegerType())),
    ("actions", T.ArrayType(T.StringType())),
    ("trialRules", T.ArrayType(T.IntegerType())),
    ("trialActions", T.ArrayType(T.StringType())),
    ("reEvaluateEntity", T.StringType()),
    ("originId", T.IntegerType()),
    ("originCategory", T.StringType()),
    ("fromUpdateAPI", T.BooleanType()),
]

# Fixed part of the message schema: scalars as text (numbers and numeric
# strings both parse), rule lists of any values, action lists of text.  A field of another JSON
# type reads as NULL and the record's other fields are kept (partial results).
FIXED_MESSAGE_FIELDS = [
    T.StructField(n, T.StringType())
    for n in (
        "eventId", "eventType", "userId", "time", "eventTime", "processTime", "processingTime",
        "reEvaluateEntity", "originId", "originCategory", "fromUpdateAPI",
    )
] + [T.StructField(n, T.ArrayType(T.VariantType())) for n in ("rules", "trialRules")] + [
    T.StructField(n, T.ArrayType(T.StringType())) for n in ("actions", "trialActions")
]

# Generic schema: maps of text values (nested values become JSON text).  Used
# where the *set* of ids matters (unresolved-id audit); resolution uses the
# per-metadata schema of ``message_schema``.
MESSAGE_SCHEMA = T.StructType(
    FIXED_MESSAGE_FIELDS
    + [T.StructField(n, T.MapType(T.StringType(), T.StringType())) for n in ("featureMap", "eventFields")]
    + [T.StructField("_corrupt", T.StringType())]
)


def message_schema(plan: "SchemaPlan | None") -> T.StructType:
    """Parse schema for one metadata version: ``featureMap`` and ``eventFields``
    become structs with one VARIANT field per known id.  The JSON parser
    matches keys by name while streaming through the object, so resolving N
    features costs O(N) per message (a map lookup per feature would scan the
    keys each time: O(N^2)); unknown ids are skipped by the parser; VARIANT
    keeps each value's JSON type for the conversion rules."""
    if plan is None:
        return MESSAGE_SCHEMA
    f_ids = sorted({i for c in plan.columns for i in c.feature_ids}, key=int)
    a_ids = sorted({i for c in plan.columns for i in c.attribute_ids}, key=int)
    as_struct = lambda ids: T.StructType([T.StructField(i, T.VariantType()) for i in ids])
    return T.StructType(
        FIXED_MESSAGE_FIELDS
        + [T.StructField("featureMap", as_struct(f_ids)), T.StructField("eventFields", as_struct(a_ids))]
        + [T.StructField("_corrupt", T.StringType())]
    )


@dataclass
class ResolvedColumn:
    name: str
    dtype: T.DataType
    feature_ids: list[str] = field(default_factory=list)
    attribute_ids: list[str] = field(default_factory=list)


@dataclass
class SchemaPlan:
    """Output layout for one metadata version: fixed, then features, then attributes."""

    columns: list[ResolvedColumn]
    collisions: list[str]
    version: int = 0

    def struct(self) -> T.StructType:
        fixed = [T.StructField(n, t) for n, t in FIXED_COLUMNS]
        return T.StructType(fixed + [T.StructField(c.name, c.dtype) for c in self.columns])


def build_schema(feature_rows, attribute_rows, version: int = 0) -> SchemaPlan:
    """R4/R5 on collected metadata rows ``(id, name, return_type, status)`` and
    ``(id, name, type)``.  Only PUBLISHED features; ids in ascending order; the
    first definition of a name fixes its type; names of fixed columns are
    reserved (collision reported, fixed value wins)."""
    fixed = {n for n, _ in FIXED_COLUMNS}
    cols: dict[str, ResolvedColumn] = {}
    collisions: list[str] = []
    for fid, name, rtype, status in sorted(feature_rows, key=lambda r: r[0]):
        if status != "PUBLISHED":
            continue
        if name in fixed:
            collisions.append(f"feature {fid} '{name}' shadows a fixed column")
            continue
        col = cols.setdefault(name, ResolvedColumn(name, stream_type(rtype)))
        col.feature_ids.append(str(fid))
    for aid, name, atype in sorted(attribute_rows, key=lambda r: r[0]):
        if name in fixed:
            collisions.append(f"attribute {aid} '{name}' shadows a fixed column")
            continue
        col = cols.setdefault(name, ResolvedColumn(name, stream_type(atype)))
        col.attribute_ids.append(str(aid))
    return SchemaPlan(list(cols.values()), collisions, version)


def plan_from_meta(feature_meta: DataFrame, attribute_meta: DataFrame, version: int = 0) -> SchemaPlan:
    """Collect the (small) metadata tables and build the projection plan."""
    f_rows = [tuple(r) for r in feature_meta.select("id", "name", "return_type", "status").collect()]
    a_rows = [tuple(r) for r in attribute_meta.select("id", "name", "type").collect()]
    return build_schema(f_rows, a_rows, version)


def parse_messages(raw: DataFrame, value_col: str = "value", plan: "SchemaPlan | None" = None) -> DataFrame:
    """Drop tombstones (NULL value); parse JSON objects.  Output keeps the
    raw text and the parsed struct ``j`` (with ``j._corrupt`` for bad records).
    With a ``plan`` the feature maps are parsed by id (``message_schema``).

    The parse sits inside a one-element ``inline`` generator: filters on the
    parsed fields (quarantine split) cannot be pushed below a generator, so
    the optimizer cannot inline ``from_json`` into both the filter and the
    projection — each message is parsed exactly once."""
    schema = message_schema(plan)
    parsed = F.from_json(F.col(value_col), schema, {"columnNameOfCorruptRecord": "_corrupt"})
    return raw.where(F.col(value_col).isNotNull()).select(
        F.inline(F.array(F.struct(F.col(value_col).alias("raw_value"), parsed.alias("j"))))
    )


def _fixed_exprs(j: str = "j") -> list[F.Column]:
    c = lambda n: F.col(f"{j}.{n}")
    return [
        c("eventId").alias("eventId"),
        c("eventType").alias("eventType"),
        c("userId").alias("userId"),
        epoch_to_timestamp(F.coalesce(c("time"), c("eventTime"))).alias("eventTime"),
        epoch_to_timestamp(F.coalesce(c("processTime"), c("processingTime"))).alias("processingTime"),
        int_array(c("rules")).alias("rules"),
        c("actions").alias("actions"),
        int_array(c("trialRules")).alias("trialRules"),
        c("trialActions").alias("trialActions"),
        c("reEvaluateEntity").alias("reEvaluateEntity"),
        to_int(c("originId")).alias("originId"),
        c("originCategory").alias("originCategory"),
        to_boolean(c("fromUpdateAPI")).alias("fromUpdateAPI"),
    ]


def _feature_expr(col: ResolvedColumn, j: str = "j") -> F.Column:
    """Attribute values (R3) override feature values (R2) when present."""
    fm, ef = F.col(f"{j}.featureMap"), F.col(f"{j}.eventFields")
    sources = [coerce_variant(ef.getField(a), col.dtype) for a in col.attribute_ids] + [
        coerce_variant(fm.getField(f), col.dtype) for f in col.feature_ids
    ]
    expr = sources[0] if len(sources) == 1 else F.coalesce(*sources)
    return expr.cast(col.dtype).alias(col.name)


def _bad_time(c) -> F.Column:
    return c.isNotNull() & epoch_to_timestamp(c).isNull()


def bad_fixed_fields(j: str = "j") -> F.Column:
    """A present fixed field that does not parse: processing time, originId, or
    a non-null rule id that is not a number (the reference fails such records)."""
    c = lambda n: F.col(f"{j}.{n}")
    return (
        _bad_time(F.coalesce(c("processTime"), c("processingTime")))
        | (c("originId").isNotNull() & to_int(c("originId")).isNull())
        | bad_ints(c("rules"))
        | bad_ints(c("trialRules"))
    )


def not_an_object(j: str = "j", raw: str = "raw_value") -> F.Column:
    """Malformed JSON, or JSON that is no object.  Only records that the parser flagged are looked at again: the rest
    of them are objects with a field of another JSON type, which reads as NULL (R8)."""
    whole = F.try_parse_json(F.col(raw))
    return F.col(f"{j}._corrupt").isNotNull() & (whole.isNull() | ~F.ltrim(F.col(raw)).startswith("{"))


def is_quarantined(j: str = "j") -> F.Column:
    """Records that are not JSON objects, or whose event time or another fixed field does not parse."""
    c = lambda n: F.col(f"{j}.{n}")
    return not_an_object(j) | _bad_time(F.coalesce(c("time"), c("eventTime"))) | bad_fixed_fields(j)


def resolve(parsed: DataFrame, plan: SchemaPlan) -> DataFrame:
    """One projection to the wide typed table (good records only).
    ``parsed`` must come from ``parse_messages(..., plan=plan)``."""
    good = parsed.where(~is_quarantined())
    return good.select(*_fixed_exprs(), *[_feature_expr(c) for c in plan.columns])


def resolve_messages(raw: DataFrame, plan: SchemaPlan, value_col: str = "value") -> DataFrame:
    return resolve(parse_messages(raw, value_col, plan), plan)


def _reason() -> F.Column:
    return (
        F.when(not_an_object(), "not_an_object")
        .when(_bad_time(F.coalesce(F.col("j.time"), F.col("j.eventTime"))), "bad_event_time")
        .otherwise("bad_fixed_field")
        .alias("reason")
    )


def quarantine(parsed: DataFrame) -> DataFrame:
    """Rejected records with a reason."""
    return parsed.where(is_quarantined()).select("raw_value", _reason())


def settle(parsed: DataFrame, plan: SchemaPlan) -> DataFrame:
    """``resolve`` and ``quarantine`` in one projection, to be kept and read by ``resolved_of`` and ``rejected_of``: for each
    record the wide typed row, and ``_rejected`` (its text and the reason) where it is no good one."""
    rejected = F.when(is_quarantined(), F.struct("raw_value", _reason()))
    return parsed.select(*_fixed_exprs(), *[_feature_expr(c) for c in plan.columns], rejected.alias("_rejected"))


def resolved_of(settled: DataFrame) -> DataFrame:
    return settled.where(F.col("_rejected").isNull()).drop("_rejected")


def rejected_of(settled: DataFrame) -> DataFrame:
    return settled.where(F.col("_rejected").isNotNull()).select("_rejected.raw_value", "_rejected.reason")


def unresolved_features(parsed: DataFrame, feature_meta: DataFrame) -> DataFrame:
    """Audit (2.2.1): feature ids present in messages but not published, with
    the number of events carrying each.  The id list is partial-aggregated
    before the (small) anti join against the metadata."""
    ids = (
        parsed.where(~is_quarantined())
        .select(F.explode(F.map_keys("j.featureMap")).alias("feature_id"))
        .groupBy("feature_id")
        .agg(F.count(F.lit(1)).alias("n_events"))
    )
    published = feature_meta.where(F.col("status") == "PUBLISHED").select(F.col("id").cast("string").alias("feature_id"))
    return ids.join(published, "feature_id", "left_anti")
