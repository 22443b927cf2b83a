"""Scans: typed usage events and file layouts they arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Behaviour pattern names, user_id modulo 4 picks one.
PATTERNS = ["A", "B", "C", "D"]

AMOUNT = T.DecimalType(18, 2)

GRID_SCHEMA = T.StructType(
    [
        T.StructField("person_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("minute", T.IntegerType()),
        T.StructField("amount", AMOUNT),
        T.StructField("pattern", T.StringType()),
    ]
)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def pattern_of(user: F.Column) -> F.Column:
    labels = F.array(*[F.lit(p) for p in PATTERNS])
    return F.element_at(labels, (user % len(PATTERNS) + 1).cast("int"))


def slot_of(ts: F.Column) -> F.Column:
    """Half-hour slot 0..47 of a timestamp."""
    return (F.hour(ts) * 2 + F.floor(F.minute(ts) / 30)).cast("int")


def usage_events(spark: SparkSession, base: str) -> DataFrame:
    """Dispense events: who, when, which kind, how much."""
    ev = table(spark, base, "events")
    return ev.select(
        "event_id",
        F.col("user_id").alias("person_id"),
        "ts",
        F.to_date("ts").alias("date"),
        slot_of(F.col("ts")).alias("slot"),
        F.col("event_type").alias("type"),
        F.col("value").cast(AMOUNT).alias("amount"),
        pattern_of(F.col("user_id")).alias("pattern"),
    )


def read_grid_csv(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """CSV slot grid with a declared schema (no inference pass over the data)."""
    schema = T.StructType([f for f in GRID_SCHEMA if f.name != "pattern"])
    return spark.read.schema(schema).option("header", header).csv(path)


def with_label_from_path(df: DataFrame, regex: str = r"pattern_([^_/]+)_", name: str = "pattern") -> DataFrame:
    """Label each row with the part of its file name that ``regex`` captures."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), regex, 1))


def read_daily(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All daily outputs below ``path`` in one scan; ``date`` comes from the folder names."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


LABEL_SCHEMA = T.StructType(
    [
        T.StructField("Wav", T.StructType([T.StructField("SignalToNoiseRatio", T.StringType())])),
        T.StructField(
            "Other",
            T.StructType([T.StructField("SpeechStart", T.StringType()), T.StructField("SpeechEnd", T.StringType())]),
        ),
        T.StructField(
            "Speaker", T.StructType([T.StructField("Age", T.StringType()), T.StructField("Gender", T.StringType())])
        ),
        T.StructField(
            "Environment",
            T.StructType(
                [T.StructField("NoiseEnviron", T.StringType()), T.StructField("RecordingEnviron", T.StringType())]
            ),
        ),
    ]
)


def parse_labels(df: DataFrame, column: str = "json") -> DataFrame:
    """Flatten nested recording labels; ``"12dB"`` becomes 12. Malformed labels give nulls."""
    j = F.from_json(F.col(column), LABEL_SCHEMA)
    return df.withColumn("_j", j).select(
        *[c for c in df.columns if c != column],
        F.regexp_replace("_j.Wav.SignalToNoiseRatio", "dB", "").try_cast("int").alias("snr"),
        F.col("_j.Other.SpeechStart").try_cast("double").alias("speech_start"),
        F.col("_j.Other.SpeechEnd").try_cast("double").alias("speech_end"),
        F.col("_j.Speaker.Age").alias("age_group"),
        F.col("_j.Speaker.Gender").alias("gender"),
        F.col("_j.Environment.NoiseEnviron").alias("noise_env"),
        F.col("_j.Environment.RecordingEnviron").alias("recording_env"),
    )


def unprocessed(inputs: DataFrame, processed: DataFrame, key: str | list[str]) -> DataFrame:
    """Inputs whose key is not in the processed-keys table yet."""
    return inputs.join(processed, key, "left_anti")
