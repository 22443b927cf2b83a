"""Named queries that run through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from dripline.plans.catalog import query, with_ctes
from dripline.session import scratch_path
from dripline.streaming import slots


@query("slot_stream", with_ctes("SELECT pattern, person_id, date, slot, CAST(amount AS DOUBLE) AS amount FROM slots", "slots"))
def slot_stream(spark, base):
    events = slots.event_stream(spark, base, "events.parquet")
    out = scratch_path(spark, "slots")
    run = slots.write_updates(slots.slot_stream(events), out, scratch_path(spark, "progress"))
    run.awaitTermination()
    return slots.current_slots(spark, out).withColumn("amount", F.col("amount").cast("double"))


@query("slot_stream_with_late", with_ctes("SELECT pattern, person_id, date, slot, CAST(amount AS DOUBLE) AS amount FROM slots", "slots"))
def slot_stream_with_late(spark, base):
    """Slot sums of the stream, late events added."""
    out = scratch_path(spark, "slots")
    slots.write_slots(slots.event_stream(spark, base, "events.parquet"), out, scratch_path(spark, "progress")).awaitTermination()
    return slots.merged_slots(spark, out).withColumn("amount", F.col("amount").cast("double"))
