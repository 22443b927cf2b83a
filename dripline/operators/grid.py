"""Events to half-hour slots, day vectors and five-day shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dripline.functions import arrays as A
from dripline.sources.tables import AMOUNT

DAY = ["pattern", "person_id", "date"]
#: Rows of a partition of days whose 48 slot rows are made and sorted in the same task.
DAY_ROWS = 20_000


def slot_sums(events: DataFrame) -> DataFrame:
    """Amount per (pattern, person, day, slot).

    Partial sums run before the shuffle, so a person who owns a third of all events still sends at most
    48 rows per day and task.
    """
    return events.groupBy(*DAY, "slot").agg(F.sum("amount").cast(AMOUNT).alias("amount"))


def placed_by_day(df: DataFrame, rows: int) -> DataFrame:
    """``df`` placed by day so that a task has about ``DAY_ROWS`` of ``rows`` rows, however many there are.

    Days grow to 48 rows each within the task, which adaptive execution does not see when it merges partitions.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // DAY_ROWS)), *DAY)


def day_attributes(events: DataFrame) -> DataFrame:
    """List-valued day attributes: hours with a dispense and the count in each of them."""
    per_hour = events.groupBy(*DAY, F.hour("ts").alias("hour")).agg(F.count("*").cast("int").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("hour", "n")))
    return per_hour.groupBy(*DAY).agg(pairs.alias("p")).select(
        *DAY,
        F.transform("p", lambda s: s["hour"]).alias("start_hours"),
        F.transform("p", lambda s: s["n"]).alias("counts"),
    )


def _fill(slots: F.Column) -> F.Column:
    """48 amounts from a (slot -> amount) map."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(A.SLOTS - 1)),
        lambda s: F.coalesce(F.try_element_at(slots, s), F.lit(0).cast(AMOUNT)),
    )


def _sparse_days(slots: DataFrame) -> DataFrame:
    entries = F.map_from_entries(F.collect_list(F.struct("slot", "amount")))
    return slots.groupBy(*DAY).agg(entries.alias("m"))


def dense_grid(slots: DataFrame) -> DataFrame:
    """48 rows for each active (person, day); empty slots hold 0."""
    full = _sparse_days(slots).select(*DAY, F.posexplode(_fill(F.col("m"))).alias("slot", "amount"))
    return full.select(
        *DAY,
        "slot",
        F.floor(F.col("slot") / 2).cast("int").alias("hour"),
        ((F.col("slot") % 2) * 30).cast("int").alias("minute"),
        "amount",
    )


def calendar_grid(slots: DataFrame) -> DataFrame:
    """Dense grid over every calendar day between a person's first and last active day."""
    # Slot sums are small per person, so one placement by person serves both groupings below.
    days = _sparse_days(slots.repartition("pattern", "person_id"))
    # One row per person: at most one small map per day of the log.
    person = days.groupBy("pattern", "person_id").agg(
        F.map_from_entries(F.collect_list(F.struct("date", "m"))).alias("days"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
    )
    spread = person.select(
        "pattern", "person_id", "days", F.explode(F.sequence("first", "last")).alias("date")
    )
    empty = F.create_map().cast("map<int,decimal(18,2)>")
    filled = F.coalesce(F.try_element_at("days", F.col("date")), empty)
    return spread.select(*DAY, F.posexplode(_fill(filled)).alias("slot", "amount"))


def day_vectors(grid: DataFrame) -> DataFrame:
    """One 48-vector per complete day; days with any other row count are left out."""
    cells = F.array_sort(F.collect_list(F.struct("slot", "amount")))
    return (
        grid.groupBy(*DAY)
        .agg(cells.alias("c"), F.count("*").alias("n"))
        .filter(F.col("n") == A.SLOTS)
        .select(*DAY, F.transform("c", lambda s: s["amount"].cast("double")).alias("vec"))
    )


def sparse_day_vectors(slots: DataFrame) -> DataFrame:
    """Day vectors straight from slot sums, without building the 48-row grid."""
    return _sparse_days(slots).select(
        *DAY, F.transform(_fill(F.col("m")), lambda x: x.cast("double")).alias("vec")
    )


def grid_from_vectors(vectors: DataFrame) -> DataFrame:
    """Back to one row per slot."""
    return vectors.select(*DAY, F.posexplode("vec").alias("slot", "amount")).select(
        *DAY,
        F.floor(F.col("slot") / 2).cast("int").alias("hour"),
        ((F.col("slot") % 2) * 30).cast("int").alias("minute"),
        "amount",
    )


def attach_day_attributes(grid: DataFrame, source: DataFrame, names: list[str]) -> DataFrame:
    """Attach attributes that ``source`` repeats on every slot of a day, from its earliest slot."""
    first = F.min_by(F.struct(*names), F.col("slot")).alias("_a")
    per_day = source.groupBy(*DAY).agg(first)
    return grid.join(per_day, DAY, "left").select(*grid.columns, *[F.col(f"_a.{n}").alias(n) for n in names])


def block_of(date: F.Column, start: F.Column, days: int = 5) -> F.Column:
    return F.floor(F.datediff(date, start) / days).cast("int")


def first_day(df: DataFrame) -> F.Column:
    """First day of a table as a scalar subquery."""
    return df.agg(F.min("date")).scalar()


def with_blocks(df: DataFrame, start: F.Column | str | None = None, days: int = 5) -> DataFrame:
    """Number the five-day blocks from ``start``, or from the first day of the whole table."""
    if start is None:
        start = first_day(df)
    elif isinstance(start, str):
        start = F.lit(start).cast("date")
    return df.withColumn("block", block_of(F.col("date"), start, days))


def five_day_shapes(grid: DataFrame, start: F.Column | str | None = None) -> DataFrame:
    """Slot sums over complete five-day blocks (240 rows), divided by their maximum.

    Summing, averaging or pre-scaling the days gives the same shape because the scale cancels.
    """
    keys = ["pattern", "person_id", "block"]
    per_slot = with_blocks(grid, start).groupBy(*keys, "slot").agg(
        F.sum("amount").cast(AMOUNT).alias("amount"), F.count("*").alias("n")
    )
    cells = F.array_sort(F.collect_list(F.struct("slot", "amount")))
    return (
        per_slot.groupBy(*keys)
        .agg(cells.alias("c"), F.sum("n").alias("n"))
        .filter((F.col("n") == 5 * A.SLOTS) & (F.size("c") == A.SLOTS))
        .select(*keys, A.max_norm(F.transform("c", lambda s: s["amount"].cast("double"))).alias("vec"))
    )


def sparse_five_day_shapes(slots: DataFrame, start: F.Column) -> DataFrame:
    """``five_day_shapes`` of the calendar grid, straight from slot sums: no row per empty slot or day is made.

    A block is complete if all its days lie between a person's first and last active day; one without a dispense is zero.
    """
    person = ["pattern", "person_id"]
    sums = with_blocks(slots, start).groupBy(*person, "block", "slot").agg(
        F.sum("amount").cast(AMOUNT).alias("amount"), F.min("date").alias("first"), F.max("date").alias("last")
    )
    # Block sums are few per person, so one placement by person serves both groupings below.
    blocks = sums.repartition(*person).groupBy(*person, "block").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "amount"))).alias("m"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )
    people = blocks.groupBy(*person).agg(
        F.map_from_entries(F.collect_list(F.struct("block", "m"))).alias("blocks"),
        block_of(F.date_add(F.min("first"), 4), start).alias("lo"), (block_of(F.date_add(F.max("last"), 1), start) - 1).alias("hi"),
    )
    every = people.filter("lo <= hi").select(*person, "blocks", F.explode(F.sequence("lo", "hi")).alias("block"))
    empty = F.create_map().cast("map<int,decimal(18,2)>")
    filled = F.coalesce(F.try_element_at("blocks", F.col("block")), empty)
    vec = F.transform(_fill(filled), lambda x: x.cast("double"))
    return every.select(*person, "block", A.max_norm(vec).alias("vec"))


def explode_vector(df: DataFrame, keys: list[str], vec: str = "vec", value: str = "amount") -> DataFrame:
    return df.select(*keys, F.posexplode(vec).alias("slot", value))
