"""What the operators of this folder share: reading, batches, words, written steps, running totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from dripline.session import cut, scratch_path

#: Bytes of one Arrow batch handed to Python, so that long texts don't pile up by the ten thousand.
BATCH_BYTES = 8 << 20
#: Rows of a side table that may be broadcast; larger ones are joined by Spark's own choice.
BROADCAST_ROWS = 100_000
#: A word: a run of anything but these six characters. ``bytes.split()`` splits at exactly them.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, stem: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors, prunes columns."""
    path = scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame) -> DataFrame:
    """``df`` computed once; marked for broadcast only if counted to be small."""
    df = cut(df)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes as well as rows."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("b") or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Values as bytes; null is empty."""
    return [b"" if x is None else x for x in column.to_pylist()]


def text_bytes(name: str = "text") -> Column:
    """Text as binary: Python then needs no decoding. Null stays null."""
    return F.col(name).cast("binary").alias(name)


def bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(-1))


ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lower_words(text: bytes) -> list[bytes]:
    return text.translate(ASCII_LOWER).split()


def running_total(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before, in the order of ``order``.

    Rows are placed by range, summed inside their range, and moved by the totals of the ranges before: no task sees
    all rows, and only one total per range goes into a single window.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = written(
        df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order), "range"
    )
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = placed.withColumn(out, F.coalesce(F.sum(value).over(own), F.lit(0)))
    return inside.join(small_side(offsets), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def by_offsets(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between one start and the next, also where both are equal. ``starts`` has a last end."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def per_text(
    docs: DataFrame,
    fn: Callable[[list[bytes]], list],
    fields: str,
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """Apply ``fn`` to the texts of a batch: (row, fields...), one row per row of ``docs``.

    ``row`` is a struct of the carried columns (default: all), so their names can't clash with the results.
    ``fn`` returns one list or array per field. Null texts reach it as empty.
    """
    names = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    schema = StructType([*rows.select("row").schema.fields, *StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(schema)][1:]
        for batch in batches:
            got = fn(bytes_of(batch.column(1)))
            arrays = [pa.array(x, k) for x, k in zip(got, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return map_batches(rows, run, schema)
