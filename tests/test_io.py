"""Sources and sinks on disk."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dripline.sources import sinks, tables


@pytest.fixture
def rows(spark):
    data = [("A", 2, dt.date(2024, 1, 1), 1.0), ("A", 1, dt.date(2024, 1, 1), 2.0), ("B", 3, dt.date(2024, 1, 2), 3.0)]
    return spark.createDataFrame(data, "pattern string, person_id long, date date, x double")


def test_daily_sink_replaces_only_the_days_it_gets(spark, tmp_path, rows):
    path = str(tmp_path / "daily")
    sinks.write_daily(rows, path)
    sinks.write_daily(rows.filter("pattern = 'B'").withColumn("x", F.lit(9.0)), path)
    got = {(r["person_id"], str(r["date"]), r["x"]) for r in tables.read_daily(spark, path, "*.parquet").collect()}
    assert got == {(2, "2024-01-01", 1.0), (1, "2024-01-01", 2.0), (3, "2024-01-02", 9.0)}


def test_pattern_sink_drops_duplicates_and_sorts(spark, tmp_path, rows):
    path = str(tmp_path / "patterns")
    sinks.write_patterns(rows.unionByName(rows), path)
    assert spark.read.parquet(path).count() == 3
    assert [r["person_id"] for r in spark.read.parquet(f"{path}/pattern=A").coalesce(1).collect()] == [1, 2]


def test_append_merge_touches_only_the_days_it_gets(spark, tmp_path, rows):
    root = str(tmp_path / "merged")
    assert sinks.read_snapshot(spark, root) is None
    assert sinks.append_merge(spark, root, rows.unionByName(rows), ["person_id"]) == 1
    files = lambda: {r[0] for r in sinks.read_snapshot(spark, root, days=[dt.date(2024, 1, 2)]).select(F.col("_metadata.file_path")).collect()}
    before = files()
    extra = spark.createDataFrame(
        [("A", 2, dt.date(2024, 1, 1), 1.0, "n"), ("C", 0, dt.date(2024, 1, 3), 4.0, None), ("D", 9, None, 5.0, None)],
        "pattern string, person_id long, date date, x double, note string",
    )
    assert sinks.append_merge(spark, root, extra, ["person_id"]) == 2
    got = sorted((r["person_id"], r["x"], r["note"] or "") for r in sinks.read_snapshot(spark, root).collect())
    # A row that is equal but for the new column is another row.
    assert got == [(0, 4.0, ""), (1, 2.0, ""), (2, 1.0, ""), (2, 1.0, "n"), (3, 3.0, ""), (9, 5.0, "")]
    assert files() == before and sinks.read_snapshot(spark, root, 1).count() == 3
    assert "note" in sinks.merge_rows(rows, extra).columns


def test_a_broken_merge_leaves_the_old_snapshot(spark, tmp_path, rows):
    root = str(tmp_path / "merged")
    sinks.append_merge(spark, root, rows, ["person_id"])
    broken = rows.withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.append_merge(spark, root, broken, ["person_id"])
    assert sinks.read_snapshot(spark, root).count() == 3
    sinks.append_merge(spark, root, rows.withColumn("x", F.lit(7.0)), ["person_id"])
    assert sinks.read_snapshot(spark, root).count() == 6



def test_registry_keeps_the_newest_entry(spark, tmp_path):
    path = str(tmp_path / "registry")
    entry = lambda name, day, n, kind: spark.createDataFrame(
        [(name, dt.datetime(2024, 1, day), n, kind)], sinks.REGISTRY_SCHEMA
    )
    for e in (entry("A", 1, 10, "base"), entry("A", 2, 20, "base"), entry("Z", 1, 5, "custom")):
        sinks.registry_append(spark, path, e)
    got = {r["pattern"]: r["people_cnt"] for r in sinks.registry_read(spark, path).collect()}
    assert got == {"A": 20, "Z": 5}
    wanted = spark.createDataFrame([("A",), ("Q",)], "pattern string")
    assert [r[0] for r in sinks.unregistered(wanted, sinks.registry_read(spark, path)).collect()] == ["Q"]


def test_csv_grid_and_label_from_file_name(spark, tmp_path):
    for name in ("A", "B"):
        (tmp_path / f"pattern_{name}_30days.csv").write_text(
            "person_id,date,hour,minute,amount\n1,2024-01-01,3,30,120.50\n"
        )
    df = tables.with_label_from_path(tables.read_grid_csv(spark, str(tmp_path)))
    got = sorted((r["pattern"], r["person_id"], float(r["amount"])) for r in df.collect())
    assert got == [("A", 1, 120.5), ("B", 1, 120.5)]


def test_optional_columns(spark, rows):
    assert sinks.drop_if_present(rows, "x", "absent").columns == ["pattern", "person_id", "date"]
    assert sinks.default_date(rows.drop("date")).first()["date"] == dt.date(2022, 2, 1)
    assert sinks.default_date(rows).select("date").distinct().count() == 2


def test_filters_and_columns_reach_the_scan(spark):
    from dripline.plans.registry import QUERIES

    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = QUERIES["date_range_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "GreaterThan(value,0.0)" in plan
    assert "props" not in plan and "event_type" not in plan
