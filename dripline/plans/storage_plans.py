"""Named queries that write the sinks and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from dripline.operators import classify, features
from dripline.plans import inputs as I
from dripline.plans.catalog import query, with_ctes
from dripline.session import cut, scratch_path
from dripline.sources import sinks, tables
from dripline.streaming import slots as streaming

def _amount():
    return F.col("amount").cast("double").alias("amount")


@query("daily_files", with_ctes("SELECT person_id, date, slot, CAST(amount AS DOUBLE) AS amount FROM slots", "slots"))
def daily_files(spark, base):
    """One folder per day, written in two overlapping runs, read back by one scan over all of them."""
    path = scratch_path(spark, "daily")
    s = I.slots(spark, base)
    middle = s.agg(F.date_add(F.min("date"), 15)).scalar()
    sinks.write_daily(s.filter(F.col("date") <= middle), path)
    sinks.write_daily(s.filter(F.col("date") >= middle), path)
    return tables.read_daily(spark, path, "*.parquet").select("person_id", "date", "slot", _amount())


@query("pattern_files", with_ctes("SELECT pattern, person_id, date, slot, CAST(amount AS DOUBLE) AS amount FROM slots", "slots"))
def pattern_files(spark, base):
    """One CSV grid per pattern; the label of a row is in the name of its folder."""
    path = scratch_path(spark, "grids")
    s = I.slots(spark, base)
    grid = s.select(
        "person_id", "date", F.floor(F.col("slot") / 2).cast("int").alias("hour"), (F.col("slot") % 2 * 30).cast("int").alias("minute"), "amount",
        F.concat(F.lit("pattern_"), "pattern", F.lit("_grid")).alias("file"),
    )
    grid.write.partitionBy("file").option("header", True).csv(path)
    rows = tables.with_label_from_path(tables.read_grid_csv(spark, f"{path}/*"), r"pattern_([^_/]+)_grid")
    return rows.select("pattern", "person_id", "date", (F.col("hour") * 2 + F.col("minute") / 30).cast("int").alias("slot"), _amount())


@query(
    "registry_view",
    with_ctes(
        """SELECT pattern, MAX(date) AS created, CAST(max_by(n, date) AS INTEGER) AS people_cnt, CASE WHEN max_by(n, date) > 1 THEN 'base' ELSE 'custom' END AS type
           FROM (SELECT pattern, date, COUNT(DISTINCT person_id) AS n FROM slots GROUP BY pattern, date) GROUP BY pattern""",
        "slots",
    ),
)
def registry_view(spark, base):
    """Every day registers its patterns again; the registry shows the newest entry of each."""
    path = scratch_path(spark, "registry")
    n = F.count_distinct("person_id").cast("int")
    daily = I.slots(spark, base).groupBy("pattern", "date").agg(n.alias("people_cnt"))
    daily = daily.withColumn("created_at", F.to_timestamp("date")).withColumn("type", F.when(F.col("people_cnt") > 1, "base").otherwise("custom"))
    halves = F.pmod(F.dayofmonth("date"), F.lit(2))
    for half in (0, 1):
        sinks.registry_append(spark, path, daily.filter(halves == half))
    return sinks.registry_read(spark, path).select("pattern", F.to_date("created_at").alias("created"), "people_cnt", "type")


@query(
    "defaulted_dates",
    "SELECT event_id, user_id, DATE '2022-02-01' AS date FROM events",
)
def defaulted_dates(spark, base):
    """Rows without a date get the default one; columns that are in the way go if they are there."""
    ev = sinks.drop_if_present(tables.table(spark, base, "events"), "ts", "event_type", "value", "props", "no such column")
    return sinks.default_date(sinks.default_date(ev), "2030-01-01")


@query(
    "feature_override",
    with_ctes(
        "SELECT pattern, person_id, date, slot, CAST(amount AS DOUBLE) AS amount, CAST(out1 AS DOUBLE) AS prev_output, seq AS output_seq FROM seqd",
        "seqd",
    ),
)
def feature_override(spark, base):
    """Model columns chosen by name; a choice of fewer than two is ignored."""
    wanted = features.feature_columns(["prev_output", "output_seq"])
    if features.feature_columns(["prev_output"]) != features.feature_columns():
        raise ValueError("a single name must not override")
    rows = features.with_sequence(features.nonzero(I.slots(spark, base)))
    before = F.coalesce(F.lag("amount").over(I.W.partitionBy("person_id", "date").orderBy("slot")), F.lit(0)).cast("double")
    return rows.withColumn("prev_output", before).select("pattern", "person_id", "date", "slot", _amount(), *wanted)


@query("stream_shape_classes")
def stream_shape_classes(spark, base):
    """Five-day shapes arrive as a stream and are classified by models trained before."""
    shapes = cut(I.shapes(spark, base))
    models = classify.train(shapes)
    limits, _ = classify.choose_thresholds(cut(classify.reconstruction_errors(shapes, models)))
    arriving, out = scratch_path(spark, "arriving"), scratch_path(spark, "classes")
    shapes.write.parquet(arriving)
    stream = spark.readStream.schema(shapes.schema).parquet(arriving)
    streaming.score_shapes(stream, models, cut(limits), out, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).drop("batch")
