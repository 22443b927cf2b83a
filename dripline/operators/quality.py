"""Data-quality rules, metric gates, drift, trend and version rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Valid range of each feature (low, high).
RANGES = {
    "output_seq": (1, 100),
    "ratio_to_prev_day": (0, 10),
    "ratio_prev_to_total": (0, 10),
    "time_diff_prev_outputs": (0, 86400),
    "prev_sum": (0, 10000),
    "prev_day_mean": (0, 10000),
    "prev_day_std": (0, 10000),
    "prev_day_total": (0, 10000),
    "slope_prev_day_n_n_minus_1": (-10000, 10000),
    "slope_prev_day_n_minus_1_n_minus_2": (-10000, 10000),
    "avg_change_rate": (0, 10000),
    "prev_output": (0, 10000),
    "prev_prev_output": (0, 10000),
}

# Acceptance limits.
MIN_SILHOUETTE = 0.6
MIN_CLUSTERED_ROWS = 500
MIN_COVERAGE = 0.95
MAX_UNKNOWN = 0.05
BASE_LIMITS = {"r2": 0.6, "accuracy": 60.0, "rmse": 30.0}
PERSONAL_LIMITS = {"r2": 0.5, "accuracy": 60.0}
ROLLBACK_DROP = 0.02
ENSEMBLE_GAIN = 0.05
DECLINE_DAYS = 14
MIN_POINTS = 30


def in_range(ranges: dict[str, tuple[float, float]] = RANGES) -> Column:
    ok = F.lit(True)
    for name, (low, high) in ranges.items():
        ok = ok & F.col(name).between(low, high)
    return ok


def keep_valid(df: DataFrame, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Rows with every value present and inside its range."""
    return df.filter(F.coalesce(in_range(ranges), F.lit(False)))


def range_violations(df: DataFrame, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Per rule: values below, above and missing. One pass over the table."""
    below = [F.sum((F.col(c) < lo).cast("long")).alias(f"b_{c}") for c, (lo, _) in ranges.items()]
    above = [F.sum((F.col(c) > hi).cast("long")).alias(f"a_{c}") for c, (_, hi) in ranges.items()]
    missing = [F.sum(F.col(c).isNull().cast("long")).alias(f"m_{c}") for c in ranges]
    wide = df.agg(*below, *above, *missing)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.coalesce(F.col(f"b_{c}"), F.lit(0)).alias("below"),
                F.coalesce(F.col(f"a_{c}"), F.lit(0)).alias("above"),
                F.coalesce(F.col(f"m_{c}"), F.lit(0)).alias("missing"),
            )
            for c in ranges
        ]
    )
    return wide.select(F.inline(rows))


def null_counts(df: DataFrame) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
    return wide.select(F.inline(rows))


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop()


def first_per_moment(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per (person, time), the first in ``order``; partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def with_minimum_rows(df: DataFrame, keys: list[str], least: int = MIN_POINTS) -> DataFrame:
    """Rows of keys that have at least ``least`` rows.

    Counting first and semi-joining keeps a very frequent key out of a single window task.
    """
    enough = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return df.join(enough, keys, "left_semi")


def gates(metrics: DataFrame, limits: dict[str, float], at_most: tuple[str, ...] = ()) -> DataFrame:
    """One row per (scope, metric) with value, limit and verdict.

    Metrics listed in ``at_most`` pass below the limit, the others at or above it.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m).cast("double").alias("value"),
                F.lit(float(limit)).alias("limit_value"),
                (F.col(m) < limit if m in at_most else F.col(m) >= limit).alias("passed"),
            )
            for m, limit in limits.items()
        ]
    )
    return metrics.select("scope", F.inline(rows))


def cluster_gate(stats: DataFrame) -> DataFrame:
    """Silhouette high enough and a large enough share of the rows inside clusters, whatever their number.

    ``many_rows`` reports beside it whether the clusters hold at least 500 rows.
    """
    good = F.coalesce(F.col("silhouette") >= MIN_SILHOUETTE, F.lit(False))
    covered = F.col("coverage") >= MIN_COVERAGE
    many = F.col("clustered") >= MIN_CLUSTERED_ROWS
    return stats.withColumns({"silhouette_ok": good, "covered_ok": covered, "many_rows": many, "passed": good & covered})


def unknown_gate(ratio: Column) -> Column:
    return ratio <= MAX_UNKNOWN


def decline_runs(history: DataFrame, days: int = DECLINE_DAYS) -> DataFrame:
    """Length of the current run of entries in which both R² and accuracy fell; restart flag when long.

    The first entry is compared with 0, as an empty history counts as 0.
    """
    w = W.partitionBy("scope").orderBy("date")
    fell = (F.col("r2") < F.lag("r2", 1, 0.0).over(w)) & (F.col("accuracy") < F.lag("accuracy", 1, 0.0).over(w))
    marked = history.withColumn("fell", fell)
    resets = F.sum((~F.col("fell")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))
    run = W.partitionBy("scope", "island").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return (
        marked.withColumn("island", resets)
        .withColumn("decline_days", F.sum(F.col("fell").cast("long")).over(run))
        .withColumn("restart", F.col("decline_days") >= days)
        .select("scope", "date", "r2", "accuracy", "decline_days", "restart")
    )


def compare_versions(versions: DataFrame) -> DataFrame:
    """Each model version beside the version numbered one lower, with the rollback verdict."""
    prev = versions.select(
        "user_id", "pattern", (F.col("version") + 1).alias("version"),
        F.col("r2").alias("prev_r2"), F.col("accuracy").alias("prev_accuracy"),
    )
    r2_drop = F.col("prev_r2") - F.col("r2")
    acc_drop = F.col("prev_accuracy") - F.col("accuracy")
    verdict = F.coalesce((r2_drop > ROLLBACK_DROP) | (acc_drop > ROLLBACK_DROP * 100), F.lit(False))
    return versions.join(prev, ["user_id", "pattern", "version"], "left").withColumn("rollback", verdict)


def current_versions(versions: DataFrame) -> DataFrame:
    """Version in use per (user, pattern): the newest one that was not rolled back."""
    kept = compare_versions(versions).filter(~F.col("rollback"))
    return kept.groupBy("user_id", "pattern").agg(F.max("version").alias("version"))


def promotions(versions: DataFrame, gain: float = 0.02, spread: float = 0.1) -> DataFrame:
    """Promote a version that is at least ``gain`` better than the one before it and stable over its folds."""
    w = W.partitionBy("scope").orderBy("version")
    better = F.col("r2") - F.lag("r2").over(w) >= gain
    first = F.lag("version").over(w).isNull()
    return versions.withColumn("promote", (first | better) & (F.col("r2_spread") <= spread))


def user_model_map(versions: DataFrame) -> DataFrame:
    """Latest model of each user."""
    pick = F.max_by(F.struct("pattern", "version"), F.struct("created_at", "version")).alias("m")
    return versions.groupBy("user_id").agg(pick).select(
        "user_id", F.col("m.pattern").alias("pattern"), F.col("m.version").alias("version")
    )


def shape_drift(shapes: DataFrame, keys: list[str], period: str = "period") -> DataFrame:
    """Relative L1 change of each key's shape against the period before, flagged above 10 % and 15 %.

    ``shapes`` has one row per (keys, period, slot) with ``amount``.
    """
    prev = shapes.select(*keys, (F.col(period) + 1).alias(period), "slot", F.col("amount").alias("before"))
    both = shapes.join(prev, [*keys, period, "slot"], "full_outer").select(
        *keys, period,
        F.coalesce(F.col("amount"), F.lit(0.0)).alias("now"), F.coalesce(F.col("before"), F.lit(0.0)).alias("before"),
        F.col("amount").isNotNull().cast("int").alias("has_now"),
        F.col("before").isNotNull().cast("int").alias("has_before"),
    )
    moved = both.groupBy(*keys, period).agg(
        F.sum(F.abs(F.col("now") - F.col("before"))).alias("moved"),
        F.sum("before").alias("base"),
        F.max("has_now").alias("has_now"), F.max("has_before").alias("has_before"),
    )
    change = F.col("moved") / F.col("base")
    return (
        moved.filter("has_now = 1 and has_before = 1 and base > 0").withColumn("change", change)
        .select(*keys, period, "change", (change > 0.10).alias("unstable"), (change > 0.15).alias("retrain"))
    )
