"""Structured Streaming ingestion.

``readStream`` (Kafka, or text files) → optional at-least-once dedup by
``eventId`` → per micro-batch resolution against the *current* metadata →
append to the shared event table (``operators.store``).

The wide schema depends on metadata that can change while the stream runs,
so messages are parsed inside ``foreachBatch``: metadata is reloaded at
the start of every batch (each trigger is a 10-minute commit interval in
production), the last good metadata is kept when a reload fails, rows are
fitted to the table's types, and the table widens by name.

Nothing is lost: rejected messages go to ``<table>__quarantine`` with a reason.
Batches are recorded in a ledger after their data is written, by the id of the
streaming query (which lives in its checkpoint) and the batch id, so another
checkpoint's batches are never taken for done.  Rows carry ``_ingest_batch``: a
replayed batch whose rows are already in the table (crash between the data
commit and the ledger row) is not written again.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrivals import LIVE, ArrivalIndex
from ..operators.layout import read_events
from ..operators.resolve import SchemaPlan, parse_messages, plan_from_meta, rejected_of, resolved_of, settle
from ..operators.store import append_live
from ..session import path_exists

log = logging.getLogger(__name__)


def _signature(plan: SchemaPlan):
    """Names, types *and* id mappings: a remapped id is a new version too."""
    return tuple((c.name, c.dtype.simpleString(), tuple(c.feature_ids), tuple(c.attribute_ids)) for c in plan.columns)


@dataclass
class MetadataCache:
    """The projection plan for the latest good metadata."""

    loader: Callable[[], tuple[DataFrame, DataFrame]]
    plan: SchemaPlan | None = None
    version: int = 0
    errors: list[str] = field(default_factory=list)

    def refresh(self) -> SchemaPlan:
        try:
            features, attributes = self.loader()
            fresh = plan_from_meta(features, attributes, self.version + 1)
            if self.plan is None or _signature(fresh) != _signature(self.plan):
                self.version += 1
                fresh.version = self.version
                self.plan = fresh
        except Exception as e:  # keep the last good plan
            self.errors.append(str(e))
            log.warning("metadata reload failed, keeping version %s: %s", self.version, e)
            if self.plan is None:
                raise
        return self.plan


def message_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S1 from files: one message per line from files arriving in ``source_dir``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(source_dir)


def kafka_message_stream(spark: SparkSession, bootstrap: str, topic: str, max_offsets_per_trigger: int | None = None):
    """S1 in production: one topic per tenant, message value as text.  Needs the
    Kafka connector on the classpath (not present in this container: untested)."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    return reader.load().select(F.col("value").cast("string").alias("value"))


def dedup_stream(messages: DataFrame, delay: str) -> DataFrame:
    """D3: drop messages redelivered (same eventId) within ``delay`` of each other's arrival.

    The watermark is on the arrival time, which never runs behind, so no message is ever dropped as late.
    Messages without an eventId, unparsable ones included, pass."""
    keyed = messages.withColumn("_arrived", F.current_timestamp()).withColumn(
        "_event_id", F.coalesce(F.get_json_object("value", "$.eventId"), F.expr("uuid()"))
    )
    return keyed.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["_event_id"]).select("value")


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The streaming query's id, which its checkpoint keeps across restarts."""
    return json.loads(spark.read.text(checkpoint.rstrip("/") + "/metadata").first()[0])["id"]


def resolve_batch(settled: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected messages) of a settled micro-batch; both carry the batch's tag."""
    rows = resolved_of(settled).withColumn("processing_day", F.to_date("processingTime"))
    return rows.withColumn("_ingest_batch", F.lit(tag)), rejected_of(settled).withColumn("_ingest_batch", F.lit(tag))


def batch_committed(spark: SparkSession, path: str, tag: str, days: list | None = None) -> bool:
    """Whether rows of the batch are already in the table (a crash after the data commit but before the ledger row).
    With ``days`` only these processing days are probed; min/max stats on ``_ingest_batch`` skip other files."""
    if not path_exists(spark, path):
        return False
    table = read_events(spark, path)
    if "_ingest_batch" not in table.columns:
        return False
    if days is not None:
        known = [d for d in days if d is not None]
        table = table.where(F.col("processing_day").isin(known) | (F.col("processing_day").isNull() if len(known) < len(days) else F.lit(False)))
    return not table.where(F.col("_ingest_batch") == tag).isEmpty()


def quarantine_path(table_path: str) -> str:
    return table_path.rstrip("/") + "__quarantine"


def affected_path(table_path: str) -> str:
    return table_path.rstrip("/") + "__affected"


def start_ingest(
    spark: SparkSession,
    source: str | DataFrame,
    table_path: str,
    checkpoint: str,
    metadata: MetadataCache,
    dedup_delay: str | None = None,
    trigger: dict | None = None,
):
    """Start the ingest query.  ``source``: a folder of text files, or a streaming DataFrame with a text column
    ``value`` (``kafka_message_stream``).  ``dedup_delay`` turns dedup on.  ``trigger`` defaults to 10-minute commits."""
    messages = message_stream(spark, source) if isinstance(source, str) else source
    messages = messages.select("value")
    if dedup_delay:
        if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", None):
            # dedup state = event ids of the delay: keep it off the JVM heap
            spark.conf.set(
                "spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            )
        messages = dedup_stream(messages, dedup_delay)
    ledger_path = table_path.rstrip("/") + "__batches"

    def run(batch: DataFrame, batch_id: int) -> None:
        query = query_id(spark, checkpoint)
        tag = f"{query}:{batch_id}"
        if path_exists(spark, ledger_path) and not spark.read.parquet(ledger_path).where(
                (F.col("query_id") == query) & (F.col("batch_id") == batch_id)).isEmpty():
            return
        plan = metadata.refresh()
        # Each message is parsed once, with the current metadata; typed rows take less room than their texts.
        settled = settle(parse_messages(batch, plan=plan), plan).persist()
        try:
            out, rejected = resolve_batch(settled, tag)
            if not batch_committed(spark, quarantine_path(table_path), tag):
                rejected.write.mode("append").parquet(quarantine_path(table_path))
            # One pass tells the days; a micro-batch spans few.
            counts = out.groupBy("processing_day", F.to_date("eventTime").alias("event_day")).agg(F.count(F.lit(1)).alias("n_rows")).collect()
            days = list({r.processing_day for r in counts})
            if days and batch_committed(spark, table_path, tag, days):
                ArrivalIndex(spark, table_path).mark(tag, [LIVE])
            elif days:
                append_live(out, table_path, tag, spark.createDataFrame(counts, "processing_day date, event_day date, n_rows bigint"))
            stamp = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            # Event days this batch touched (late rows included), for refresh_pending
            touched = sorted({r.event_day for r in counts if r.event_day is not None})
            spark.createDataFrame([(tag, d, stamp) for d in touched], "batch string, stat_date date, arrived_at timestamp") \
                .coalesce(1).write.mode("append").parquet(affected_path(table_path))
        finally:
            settled.unpersist()
        stamp = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        spark.createDataFrame([(query, batch_id, plan.version, stamp)], "query_id string, batch_id long, meta_version int, committed_at timestamp") \
            .coalesce(1).write.mode("append").parquet(ledger_path)

    writer = messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"processingTime": "10 minutes"}))
    return writer.start()
