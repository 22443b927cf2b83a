"""Exploratory roll-ups over dispense events and dashboard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dripline.operators import scan

# Display order of the dispense sizes in ml.
CAPACITIES = [120, 140, 260, 500, 1000]

# Named parts of the day as (name, first hour, end hour).
BANDS = [("morning", 6, 9), ("lunch", 11, 14), ("evening", 17, 20), ("night", 22, 5)]


def hourly_counts(events: DataFrame) -> DataFrame:
    """Count per hour from the first to the last hour of the log, empty hours as 0."""
    hour = F.date_trunc("hour", "ts")
    counts = events.groupBy(hour.alias("hour")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL '1' HOUR"))).alias("hour"))
    return spine.join(counts, "hour", "left").select(
        F.concat_ws("-", F.dayofmonth("hour"), F.hour("hour")).alias("label"),
        F.to_date("hour").alias("date"),
        F.hour("hour").alias("hour"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def hourly_by_type(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count per hour and kind, and its share within the hour (optionally per person)."""
    keys = [*(by or []), "date", "hour"]
    counts = events.withColumn("hour", F.hour("ts")).groupBy(*keys, "type").agg(F.count("*").alias("n"))
    # The window sees aggregated rows only: at most one per kind.
    total = F.sum("n").over(W.partitionBy(*keys))
    return counts.withColumn("share", F.col("n") / total)


def hourly_amount(events: DataFrame) -> DataFrame:
    """Amount per hour, in total and per kind."""
    rolled = events.withColumn("hour", F.hour("ts")).groupingSets(
        [["date", "hour"], ["date", "hour", "type"]], "date", "hour", "type"
    )
    return rolled.agg(F.sum("amount").cast("double").alias("amount"), F.grouping("type").alias("g")).select(
        "date", "hour", F.when(F.col("g") == 1, "total").otherwise(F.col("type")).alias("type"), "amount"
    )


def shares(df: DataFrame, category: str) -> DataFrame:
    """Count and share of each category value."""
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(category, "n", (F.col("n") / total).alias("share"))


def combined_label(capacity: Column, kind: Column) -> Column:
    return F.concat_ws(" - ", capacity.cast("string"), kind)


def nearest_capacity(amount: Column) -> Column:
    """Smallest listed size that holds the amount; the largest one beyond."""
    expr = F.lit(CAPACITIES[-1])
    for size in reversed(CAPACITIES[:-1]):
        expr = F.when(amount <= size, F.lit(size)).otherwise(expr)
    return expr


def combination_counts(events: DataFrame) -> DataFrame:
    """Counts of size and kind combinations; ``rank`` is size order, then label."""
    counts = (
        events.groupBy("capacity", "type").agg(F.count("*").alias("n"))
        .withColumn("combined", combined_label(F.col("capacity"), F.col("type")))
    )
    order = F.array_position(F.array(*[F.lit(c) for c in CAPACITIES]), F.col("capacity"))
    # At most sizes x kinds rows reach this window.
    rank = F.row_number().over(W.orderBy(order, F.col("combined")))
    return counts.withColumn("rank", rank).select("rank", "combined", "n")


def person_type_pivot(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Total and per-kind amounts per person, and each kind's share of the total."""
    pivot = events.groupBy("person_id").agg(
        F.sum("amount").cast("double").alias("total"),
        *[
            F.coalesce(F.sum(F.when(F.col("type") == k, F.col("amount"))).cast("double"), F.lit(0.0)).alias(k)
            for k in kinds
        ],
    )
    share = [F.when(F.col("total") > 0, F.col(k) / F.col("total")).otherwise(0.0).alias(f"{k}_share") for k in kinds]
    return pivot.select("*", *share)


def _by_person(events: DataFrame) -> tuple[DataFrame, list[str], list[Column]]:
    order = [F.col("ts"), F.col("event_id")]
    return scan.pieces(events, [F.col("person_id"), *order]), ["person_id"], order


def gap_groups(events: DataFrame, gap: str = "INTERVAL '1' MINUTE") -> DataFrame:
    """Number the runs of a person's events whose gaps are at most ``gap``.

    A person with very many events is scanned in pieces; the breaks counted in the pieces before are added.
    """
    rows, keys, order = _by_person(events)
    rows = scan.with_neighbour(rows, keys, order, "ts", "_prev")
    rows = rows.withColumn("_opens", F.when(F.col("ts") - F.col("_prev") > F.expr(gap), 1).otherwise(0))
    rows = scan.with_running(rows, keys, order, "_opens", "_grp")
    return rows.select("person_id", "event_id", "ts", "date", "type", F.col("_grp").cast("long").alias("grp"))


def next_gap_minutes(events: DataFrame) -> DataFrame:
    """Minutes to a person's next event; null on the last one."""
    rows, keys, order = _by_person(events)
    rows = scan.with_neighbour(rows, keys, order, "ts", "_next", ahead=True)
    gap = (F.col("_next") - F.col("ts")).cast("interval second")
    return rows.select("person_id", "event_id", (gap.cast("decimal(20,6)").cast("double") / 60).alias("gap_min"))


def group_consistency(groups: DataFrame) -> DataFrame:
    """How many groups hold a single kind, how many hold several."""
    per_group = groups.groupBy("person_id", "grp").agg(
        (F.min("type") == F.max("type")).alias("consistent")
    )
    return per_group.groupBy("consistent").agg(F.count("*").alias("n"))


def slot_profile(days: DataFrame, grid_days: DataFrame, patterns: list[str]) -> DataFrame:
    """Average amount per slot and pattern, pivoted; empty slots of active days count as 0.

    ``days`` holds slot sums; the number of active days per pattern supplies the zeros, so the dense grid
    is never built.
    """
    n = grid_days.groupBy("pattern").agg(F.count("*").alias("days"))
    total = days.groupBy("pattern", "slot").agg(F.sum("amount").cast("double").alias("s"))
    avg = total.join(F.broadcast(n), "pattern").withColumn("avg", F.col("s") / F.col("days"))
    return avg.groupBy("slot").pivot("pattern", patterns).agg(F.first("avg")).na.fill(0.0)


def project_versions(profile: DataFrame, version: str) -> DataFrame:
    """Patterns a dashboard version shows: v1 the first two, v2 the first three, later ones all."""
    # Pattern columns per dashboard version.
    shown = {"v1.0.0": ["A", "B"], "v2.0.0": ["A", "B", "C"]}
    columns = shown.get(version)
    return profile if columns is None else profile.select("slot", *columns)


def hourly_totals(slots: DataFrame) -> DataFrame:
    return slots.groupBy("pattern", F.floor(F.col("slot") / 2).cast("int").alias("hour")).agg(
        F.sum("amount").cast("double").alias("usage")
    )


def band_of(hour: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, start, end in BANDS:
        inside = (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
        expr = F.when(inside, name).otherwise(expr)
    return expr


def peak_bands(events: DataFrame) -> DataFrame:
    """Amount and distinct persons in named parts of the day."""
    # Summing per person first keeps the distinct count a plain count.
    per_person = (
        events.withColumn("band", band_of(F.hour("ts"))).filter("band is not null")
        .groupBy("band", "person_id").agg(F.sum("amount").alias("amount"))
    )
    return per_person.groupBy("band").agg(
        F.sum("amount").cast("double").alias("usage"), F.count("*").alias("users")
    )


def monthly_vs_baseline(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """Monthly amount per pattern beside its baseline (one row per pattern)."""
    month = F.date_format("date", "yyyy-MM")
    usage = events.groupBy("pattern", month.alias("month")).agg(F.sum("amount").cast("double").alias("usage"))
    return usage.join(baseline, "pattern", "left").withColumn("delta", F.col("usage") - F.col("baseline"))


def kpis(events: DataFrame, device: Column) -> DataFrame:
    """Distinct persons, distinct devices and the mean daily amount."""
    daily = events.groupBy("date").agg(F.sum("amount").alias("amount")).agg(
        (F.sum("amount").cast("double") / F.count("*")).alias("mean_daily")
    )
    persons = events.groupBy("person_id").agg(F.first(device).alias("device"))
    return persons.agg(F.count("*").alias("persons"), F.countDistinct("device").alias("devices")).withColumn(
        "mean_daily", daily.scalar()
    )


def accuracy_by_cluster(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Mean accuracies per cluster and the mean of the cluster rows."""
    per = scores.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns])
    overall = per.agg(*[F.avg(c).alias(c) for c in columns]).select(F.lit("mean").alias("cluster"), *columns)
    return per.unionByName(overall)


def status_counts(devices: DataFrame) -> DataFrame:
    """Devices per status with the total."""
    return devices.rollup("status").agg(F.count("*").alias("n"), F.grouping("status").alias("g")).select(
        F.when(F.col("g") == 1, "all").otherwise(F.col("status")).alias("status"), "n"
    )


def success_counts(jobs: DataFrame, by: list[str]) -> DataFrame:
    ok = F.sum(F.when(F.col("status") == "success", 1).otherwise(0))
    return jobs.groupBy(*by).agg(ok.alias("ok"), F.count("*").alias("jobs"))


def accuracy_band(accuracy: Column) -> Column:
    return F.when(accuracy >= 90, "90+").when(accuracy >= 80, "80-90").otherwise("<80")


def age_band(age: Column) -> Column:
    return F.when(age < 20, "<20").when(age < 40, "20-39").when(age < 60, "40-59").otherwise("60+")


def facet_filter(
    samples: DataFrame,
    search: str = "",
    accuracy: str | None = None,
    gender: str | None = None,
    age: str | None = None,
) -> DataFrame:
    """Rows whose sample or home id contains ``search`` (any case) and that match the chosen facets."""
    wanted = search.lower()
    out = samples.filter(F.lower("id").contains(wanted) | F.lower("family_id").contains(wanted))
    if accuracy:
        out = out.filter(accuracy_band(F.col("accuracy")) == accuracy)
    if gender:
        out = out.filter(F.col("gender") == gender)
    if age:
        out = out.filter(age_band(F.col("age")) == age)
    return out


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first): distinct keys in the order of their first row; only distinct keys are sorted, by range."""
    return df.groupBy(key).agg(F.min(order).alias("first")).orderBy("first")


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum falls into the last bin."""
    keys = by or []
    if keys:
        ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        joined = df.join(ends, keys)
    else:
        joined = df.withColumn("lo", df.agg(F.min(value)).scalar()).withColumn("hi", df.agg(F.max(value)).scalar())
    width = (F.col("hi") - F.col("lo")) / bins
    raw = F.when(width > 0, F.floor((F.col(value) - F.col("lo")) / width)).otherwise(F.lit(0))
    return (
        joined.withColumn("bin", F.least(raw, F.lit(bins - 1)).cast("int"))
        .groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    )
