"""Windows over groups of any size, in pieces.

Rows are placed by range of their group and order, so a group that holds half of all rows spreads over many pieces and
a small one lies in one. A window runs inside a piece; what it needs from before or behind is one value per piece and
group, found on the short table of pieces and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.window import WindowSpec

from dripline.session import cut

#: Pieces at least; with as many, a group of half of all rows puts about a thirtieth into a task.
LEAST_PIECES = 32


def pieces(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``_piece``: ranges of ``order``, which begins with the group's columns."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), LEAST_PIECES)
    return cut(rows.repartitionByRange(n, *order).withColumn("_piece", F.spark_partition_id()))


def _inside(keys: list[str], order: list[Column]) -> WindowSpec:
    return W.partitionBy("_piece", *keys).orderBy(*order)


def _joined(placed: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return placed.join(found, ["_piece", *keys])


def with_neighbour(placed: DataFrame, keys: list[str], order: list[Column], value: str, name: str, ahead: bool = False) -> DataFrame:
    """``name``: the value of the row before in its group, or behind with ``ahead``; null at the end of the group."""
    near = _inside(keys, order)
    step = F.lead if ahead else F.lag
    marked = placed.withColumn(name, step(value).over(near)).withColumn("_at", F.row_number().over(near))
    edge = F.min_by(value, "_at") if ahead else F.max_by(value, "_at")
    ends = marked.groupBy("_piece", *keys).agg(edge.alias("_edge"))
    along = W.partitionBy(*keys).orderBy("_piece")
    ends = ends.select("_piece", *keys, step("_edge").over(along).alias("_beyond"))
    marked = marked.drop("_at")
    return _joined(marked, ends, keys).withColumn(name, F.coalesce(name, "_beyond")).drop("_beyond")


def with_running(placed: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` up to and with each row of its group."""
    local = placed.withColumn(name, F.sum(value).over(_inside(keys, order).rowsBetween(W.unboundedPreceding, 0)))
    sums = placed.groupBy("_piece", *keys).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_piece", *keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return _joined(local, sums, keys).withColumn(name, F.col(name) + F.col("_before")).drop("_before")
