"""Streaming forms: events to slot sums, new shapes to pattern predictions.

Slots come in two ways. ``slot_stream`` is the stateful aggregation for consumers of a live stream; its watermark bounds
the state, and what comes later is not in it. ``write_slots`` keeps every event: each micro-batch leaves partial sums,
those of events behind its mark in a sink of their own, and ``merged_slots`` adds both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dripline.operators import classify
from dripline.operators.grid import slot_sums
from dripline.sources.tables import AMOUNT, pattern_of, slot_of

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def slot_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Half-hour sums per person; events later than ``late`` behind the newest one are left out of closed slots.

    ``write_slots`` is the form that keeps them.
    """
    # Watermarks need an instant: the zone-less event time is read as UTC, and shown as UTC again below.
    instant = F.expr("cast(convert_timezone('UTC', current_timezone(), ts) as timestamp)")
    window = F.window("at", "30 minutes")
    summed = (
        events.withColumn("at", instant).withWatermark("at", late)
        .groupBy(pattern_of(F.col("user_id")).alias("pattern"), F.col("user_id").alias("person_id"), window.alias("w"))
        .agg(F.sum(F.col("value").cast(AMOUNT)).cast(AMOUNT).alias("amount"))
    )
    start = F.to_utc_timestamp("w.start", F.current_timezone())
    return summed.select(
        "pattern",
        "person_id",
        F.to_date(start).alias("date"),
        (F.hour(start) * 2 + F.floor(F.minute(start) / 30)).cast("int").alias("slot"),
        "amount",
    )


def write_updates(slots: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Changed slots of each micro-batch go to their own folder, so a repeated batch overwrites itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        slots.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(save).start()
    )


def current_slots(spark: SparkSession, path: str) -> DataFrame:
    """Newest value of every slot."""
    rows = spark.read.parquet(path)
    keys = ["pattern", "person_id", "date", "slot"]
    return rows.groupBy(*keys).agg(F.max_by("amount", "batch").alias("amount"))


def _partial_sums(events: DataFrame) -> DataFrame:
    keyed = events.select(
        pattern_of(F.col("user_id")).alias("pattern"), F.col("user_id").alias("person_id"), F.to_date("ts").alias("date"),
        slot_of(F.col("ts")).alias("slot"), F.col("value").cast(AMOUNT).alias("amount"),
    )
    return slot_sums(keyed)


def write_slots(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Partial slot sums of each micro-batch: ``path/slots`` for events in time, ``path/late`` for those behind.

    The mark of a batch is the newest event of all batches before it less ``late``; a slot that ended before the mark
    is closed, and its events are late. Marks are files of the batches too, so a batch that is run again finds the same
    mark, splits the same way and overwrites itself. No state is kept and no event is lost.
    """
    spark = events.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        mark = F.lit(None).cast("timestamp_ntz")
        if number:
            marks = spark.read.schema("newest timestamp_ntz, batch long").parquet(f"{path}/marks").filter(F.col("batch") < number)
            newest = marks.agg(F.max("newest")).first()[0]
            mark = F.lit(newest).cast("timestamp_ntz") - F.expr(f"interval {late}")
        ends = F.date_trunc("hour", "ts") + F.expr("make_dt_interval(0, 0, 30 * (1 + cast(minute(ts) / 30 as int)), 0)")
        behind = F.coalesce(ends <= mark, F.lit(False))
        held = batch.withColumn("_late", behind).persist()
        for kind, rows in (("slots", held.filter("not _late")), ("late", held.filter("_late"))):
            _partial_sums(rows).write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
        held.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        held.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


_PARTIAL = "pattern string, person_id long, date date, slot int, amount decimal(18,2), batch long"


def merged_slots(spark: SparkSession, path: str, late: bool = True) -> DataFrame:
    """Slot sums over all micro-batches, with or without the events that came late."""
    rows = spark.read.schema(_PARTIAL).parquet(f"{path}/slots")
    if late:
        rows = rows.unionByName(spark.read.schema(_PARTIAL).parquet(f"{path}/late"))
    return slot_sums(rows)


def score_shapes(
    shapes: DataFrame, models: dict, limits: DataFrame, path: str, checkpoint: str
) -> StreamingQuery:
    """Classify arriving five-day shapes with models trained before."""

    def save(batch: DataFrame, number: int) -> None:
        errors = classify.reconstruction_errors(batch, models)
        classify.predict(errors, limits).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        shapes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    )
