"""Small scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def exact_hour(hour: Column, minute: Column) -> Column:
    return hour + minute / F.lit(60.0)


def slot_index(hour: Column, minute: Column) -> Column:
    return (hour * 2 + F.floor(minute / 30)).cast("int")


def slot_hour(slot: Column) -> Column:
    return F.floor(slot / 2).cast("int")


def slot_minute(slot: Column) -> Column:
    return ((slot % 2) * 30).cast("int")


def time_sin(hour: Column, minute: Column) -> Column:
    return F.sin(F.lit(2.0) * F.pi() * (hour * 60 + minute) / F.lit(1440.0))


def time_cos(hour: Column, minute: Column) -> Column:
    return F.cos(F.lit(2.0) * F.pi() * (hour * 60 + minute) / F.lit(1440.0))


def percent_error(actual: Column, predicted: Column) -> Column:
    return (actual - predicted) / actual * 100


def gender_flag(gender: Column) -> Column:
    return F.when(F.lower(gender).startswith("m"), 1).otherwise(0)


def version_key(user: Column, cluster: Column, date: Column, version: Column) -> Column:
    return F.format_string("%s_%s_%s_v%s", user.cast("string"), cluster, F.date_format(date, "yyyyMMdd"), version.cast("string"))


def hashed_fraction(*keys: Column, seed: int = 42) -> Column:
    """Number in [0, 1) that depends only on the key values and the seed.

    Unlike ``rand`` it does not change with the partitioning or when a task is run again.
    """
    text = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
