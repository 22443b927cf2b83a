"""Array expressions for 48-slot vectors; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SLOTS = 48


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it in ``body`` as often as needed.

    Lambdas are not covered by common-subexpression elimination, so an array minimum written inside one
    would be computed again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def minmax(v: Column) -> Column:
    """Scale to [0, 1]; a constant vector becomes zeros."""

    def scaled(s: Column) -> Column:
        span = s["hi"] - s["lo"]
        return F.transform(s["v"], lambda x: F.when(span > 0, (x - s["lo"]) / span).otherwise(0.0))

    return _let(
        v, lambda w: _let(F.struct(w.alias("v"), F.array_min(w).alias("lo"), F.array_max(w).alias("hi")), scaled)
    )


def running_sum(v: Column) -> Column:
    return F.aggregate(
        v,
        F.array().cast("array<double>"),
        lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))),
    )


def cumulative_minmax(v: Column) -> Column:
    return minmax(running_sum(v))


def max_norm(v: Column) -> Column:
    """Divide by the maximum; an all-zero vector stays as it is."""

    def scaled(s: Column) -> Column:
        return F.transform(s["v"], lambda x: F.when(s["hi"] != 0, x / s["hi"]).otherwise(x))

    return _let(v, lambda w: _let(F.struct(w.alias("v"), F.array_max(w).alias("hi")), scaled))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def mean_squared_error(a: Column, b: Column) -> Column:
    return squared_distance(a, b) / F.size(a)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def confidence(mse: Column) -> Column:
    return F.lit(1.0) - F.least(F.lit(1.0), mse)


def parse_int_list(text: Column) -> Column:
    """``"[1, 2]"`` to an integer array; no code is evaluated."""
    return F.from_json(text, "array<int>")


def speech_window(signal: Column, start: Column, end: Column, rate: Column) -> Column:
    """Samples between two times given in seconds."""
    first, last = (start * rate).cast("int"), (end * rate).cast("int")
    return F.slice(signal, first + 1, F.greatest(last - first, F.lit(0)))
