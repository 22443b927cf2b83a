"""Inputs of the named queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from dripline.operators import eda, evaluate, features, grid
from dripline.sources.tables import table, usage_events


def slots(spark: SparkSession, base: str) -> DataFrame:
    return grid.slot_sums(usage_events(spark, base))


def sized_events(spark: SparkSession, base: str) -> DataFrame:
    return usage_events(spark, base).withColumn("capacity", eda.nearest_capacity(F.col("amount")))


def feature_rows(spark: SparkSession, base: str) -> DataFrame:
    return features.feature_table(slots(spark, base))


def shapes(spark: SparkSession, base: str) -> DataFrame:
    s = slots(spark, base)
    return grid.sparse_five_day_shapes(s, grid.first_day(s))


def predictions(spark: SparkSession, base: str) -> DataFrame:
    """Two simple predictors of every dispense: the person's earlier mean and previous amount.

    The windows read slot sums, at most 48 rows per person and day.
    """
    w = W.partitionBy("pattern", "person_id").orderBy("date", "slot")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    return (
        features.nonzero(slots(spark, base))
        .select(
            "pattern", "person_id", "date", "slot",
            F.col("amount").cast("double").alias("actual"),
            F.lag("amount").over(w).cast("double").alias("personal"),
            (F.sum("amount").over(before).cast("double") / F.count("*").over(before)).alias("base"),
        )
        .filter("personal is not null")
    )


def split_predictions(spark: SparkSession, base: str) -> DataFrame:
    return evaluate.split_by_date(predictions(spark, base))


def daily_scores(spark: SparkSession, base: str) -> DataFrame:
    """Metric history: one entry per pattern and day."""
    preds = predictions(spark, base).select(F.col("pattern").alias("scope"), "date", "actual", F.col("base").alias("pred"))
    m = evaluate.regression_metrics(preds, ["scope", "date"])
    return m.select("scope", "date", F.round("r2", 6).alias("r2"), F.round("accuracy", 6).alias("accuracy"))


def versions(spark: SparkSession, base: str) -> DataFrame:
    """Model versions: one per (user, week), scored on that week's dispenses."""
    start = F.lit("2024-01-01").cast("date")
    preds = predictions(spark, base).withColumn("version", (F.floor(F.datediff("date", start) / 7) + 1).cast("int"))
    a, p = F.col("actual"), F.col("base")
    return preds.groupBy(F.col("person_id").alias("user_id"), "pattern", "version").agg(
        F.round(F.coalesce(evaluate.r2(a, p), F.lit(0.0)), 6).alias("r2"),
        F.round(evaluate.accuracy(a, p), 6).alias("accuracy"),
        F.max("date").alias("created_at"),
    )


def voice_samples(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "customer")
    return c.select(
        F.concat(F.lit("VOICE_"), F.col("c_custkey").cast("string")).alias("id"),
        F.concat(F.lit("HOME_"), F.col("c_nationkey").cast("string")).alias("family_id"),
        F.when(F.col("c_custkey") % 2 == 0, "Male").otherwise("Female").alias("gender"),
        (F.col("c_custkey") % 80).cast("int").alias("age"),
        ((F.col("c_custkey") % 31) + 70).cast("double").alias("accuracy"),
    )


def frames(spark: SparkSession, base: str) -> DataFrame:
    """Recordings: the label is the speaker, every embedding one frame.

    A frame of the data model has 14 coefficients; the first 14 of the 64 values stand for them. A recording holds the
    frames whose ids share their hundreds.
    """
    e = table(spark, base, "embeddings")
    return e.select(
        F.col("label").cast("long").alias("user_id"),
        F.floor(F.col("vec_id") / 100).cast("long").alias("recording"),
        "vec_id",
        F.transform(F.slice("embedding", 1, 14), lambda x: x.cast("double")).alias("frame"),
    )
