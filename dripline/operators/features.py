"""Previous-day features of every dispense, in one shuffle after the slot sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dripline.functions import scalars as S
from dripline.operators.grid import DAY

# Feature names in model order.
FEATURES = [
    "output_seq",
    "ratio_to_prev_day",
    "ratio_prev_to_total",
    "time_diff_prev_outputs",
    "prev_sum",
    "prev_day_mean",
    "prev_day_std",
    "prev_day_total",
    "slope_prev_day_n_n_minus_1",
    "slope_prev_day_n_minus_1_n_minus_2",
    "avg_change_rate",
    "prev_output",
    "prev_prev_output",
]
MODEL_FEATURES = [*FEATURES, "time_sin", "time_cos"]

PERSON = ["pattern", "person_id"]


def nonzero(slots: DataFrame) -> DataFrame:
    return slots.filter(F.col("amount") > 0)


def with_sequence(slots: DataFrame) -> DataFrame:
    """Dispense number within the day: running count of non-zero slots, 0 on empty slots."""
    used = (F.col("amount") > 0).cast("int")
    w = W.partitionBy(*DAY).orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    return slots.withColumn("output_seq", (F.sum(used).over(w) * used).cast("int"))


def first_persons(slots: DataFrame, n: int, on: str | None = None) -> DataFrame:
    """First ``n`` persons of each pattern by id (0 takes all), among those present on day ``on``."""
    base = slots if on is None else slots.filter(F.col("date") == F.lit(on).cast("date"))
    people = base.select("pattern", "person_id").distinct()
    if n <= 0:
        return people
    # Distinct persons only; the limit lets Spark keep n rows per task before the shuffle.
    rank = F.row_number().over(W.partitionBy("pattern").orderBy("person_id"))
    return people.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def chosen_persons(slots: DataFrame, people: DataFrame) -> DataFrame:
    """Rows of chosen persons. Spark picks the join by the size it measures; nothing is forced."""
    return slots.join(people, ["pattern", "person_id"], "left_semi")


def processed_days(slots: DataFrame, wrap: bool = False) -> DataFrame:
    """Each day that has dispenses and the processed day before it.

    With ``wrap`` the first day takes the last one as its predecessor. One row per calendar day.
    """
    days = nonzero(slots).select("date").distinct()
    w = W.orderBy("date")
    prev = F.lag("date").over(w)
    if wrap:
        prev = F.coalesce(prev, F.max("date").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return days.withColumn("prev_date", prev)


def day_table(slots: DataFrame) -> DataFrame:
    """One row per (person, day): its dispenses in order, with the day's statistics.

    Everything a dispense needs from its own day is put into its struct here.
    """
    w = W.partitionBy(*DAY).orderBy("slot")
    before = F.sum("amount").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = (
        nonzero(slots)
        .repartition(*PERSON)
        .withColumn("seq", F.row_number().over(w))
        .withColumn("before", F.coalesce(before, F.lit(0)).cast("decimal(28,2)"))
        .withColumn("out1", F.lag("amount", 1).over(w))
        .withColumn("out2", F.lag("amount", 2).over(w))
        .withColumn("gap", F.coalesce((F.col("slot") - F.lag("slot").over(w)) * 1800, F.lit(0)))
    )
    item = F.struct("slot", "amount", "seq", "before", "out1", "out2", "gap")
    value = F.col("amount").cast("double")
    return rows.groupBy(*DAY).agg(
        F.array_sort(F.collect_list(item)).alias("outs"),
        F.sum("amount").cast("double").alias("total"),
        (F.sum("amount").cast("double") / F.count("*")).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.coalesce(F.when(F.count("*") >= 2, F.regr_slope(value, F.col("seq"))), F.lit(0.0)).alias("slope"),
    )


def _seq_delta(prev: Column, seq: Column) -> Column:
    """Amount number ``seq`` minus the one before it on the previous day; 0 when either is missing."""
    here = F.try_element_at(prev, seq)["amount"]
    last = F.when(seq >= 2, F.try_element_at(prev, F.greatest(seq - 1, F.lit(1))))["amount"]
    return F.coalesce((here - last).cast("double"), F.lit(0.0))


def feature_table(slots: DataFrame, wrap: bool = False, first_day: str | None = None) -> DataFrame:
    """One row per dispense with its twelve features and sequence number.

    A dispense whose person has no dispense on the previous processed day gets 0 in every feature but the
    sequence number. ``first_day`` keeps the rows from that day on.
    """
    days = day_table(slots)
    person = W.partitionBy(*PERSON).orderBy("date")
    state = F.struct("date", "outs", "total", "mean", "std", "slope")
    if wrap:
        last = F.last(state).over(person.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        prev = F.coalesce(F.lag(state).over(person), last)
    else:
        prev = F.lag(state).over(person)
    # One row per calendar day, so this side stays a few thousand rows whatever the log size.
    calendar = F.broadcast(processed_days(slots, wrap))
    lagged = (
        days.withColumn("_p", prev)
        .join(calendar, "date", "left")
        .withColumn("_p", F.when(F.col("_p.date") == F.col("prev_date"), F.col("_p")))
    )
    if first_day is not None:
        lagged = lagged.filter(F.col("date") >= F.lit(first_day).cast("date"))
    flat = lagged.select(*DAY, "_p", F.explode("outs").alias("o")).select(*DAY, "_p", "o.*")
    total = F.col("_p.total")
    known = F.coalesce(total > 0, F.lit(False))

    def kept(value: Column) -> Column:
        return F.when(known, value.cast("double")).otherwise(F.lit(0.0))

    outs = F.col("_p.outs")
    reached = F.try_element_at(F.filter(outs, lambda y: y["slot"] <= F.col("slot")), F.lit(-1))
    upto = F.coalesce((reached["before"] + reached["amount"]).cast("double"), F.lit(0.0))
    now = F.col("before") + F.col("amount")
    return flat.select(
        *DAY,
        S.slot_hour(F.col("slot")).alias("hour"),
        S.slot_minute(F.col("slot")).alias("minute"),
        F.col("amount").cast("double").alias("amount"),
        F.col("seq").alias("output_seq"),
        kept(now.cast("double") / total).alias("ratio_to_prev_day"),
        kept(F.col("before").cast("double") / total).alias("ratio_before"),
        kept(upto / total).alias("ratio_prev_to_total"),
        kept(F.col("gap")).alias("time_diff_prev_outputs"),
        kept(F.col("before")).alias("prev_sum"),
        kept(F.col("_p.mean")).alias("prev_day_mean"),
        kept(F.col("_p.std")).alias("prev_day_std"),
        kept(total).alias("prev_day_total"),
        kept(_seq_delta(outs, F.col("seq"))).alias("slope_prev_day_n_n_minus_1"),
        kept(F.when(F.col("seq") >= 2, _seq_delta(outs, F.greatest(F.col("seq") - 1, F.lit(1)))).otherwise(0.0)).alias(
            "slope_prev_day_n_minus_1_n_minus_2"
        ),
        kept(F.col("_p.slope")).alias("avg_change_rate"),
        kept(F.coalesce("out1", F.lit(0))).alias("prev_output"),
        kept(F.coalesce("out2", F.lit(0))).alias("prev_prev_output"),
    )


def features_for_known_persons(
    slots: DataFrame, start: str, before_start: str, n: int = 0, end: str | None = None
) -> DataFrame:
    """Features from ``start`` to ``end`` for persons present on the day before ``start``."""
    people = first_persons(slots, n, before_start)
    window = slots.filter(F.col("date") >= F.lit(before_start).cast("date"))
    if end is not None:
        window = window.filter(F.col("date") <= F.lit(end).cast("date"))
    return feature_table(chosen_persons(window, people), first_day=start)


def with_time_encoding(df: DataFrame) -> DataFrame:
    """Cyclic time of day: sine and cosine of the minute of the day."""
    return df.withColumn("time_sin", S.time_sin(F.col("hour"), F.col("minute"))).withColumn(
        "time_cos", S.time_cos(F.col("hour"), F.col("minute"))
    )


def model_input(features: DataFrame, leak_free: bool = False) -> DataFrame:
    """Model columns; ``leak_free`` replaces the ratio that contains the target amount."""
    df = with_time_encoding(features.filter(F.col("amount") > 0))
    return df.withColumn("ratio_to_prev_day", F.col("ratio_before")) if leak_free else df


def feature_columns(override: list[str] | None = None) -> list[str]:
    """Model columns; an override of fewer than two names is ignored."""
    return list(override) if override and len(override) >= 2 else list(MODEL_FEATURES)
