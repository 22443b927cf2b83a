"""Edge cases of the EDA, scoring, quality and version rules."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dripline.functions import scalars as S
from dripline.operators import diagnostics, eda, evaluate, grid, quality, scan
from dripline.sources import sinks, tables


def events(spark, rows):
    data = [(i, p, dt.datetime.fromisoformat(t), k) for i, (p, t, k) in enumerate(rows)]
    df = spark.createDataFrame(data, "event_id long, person_id long, ts timestamp_ntz, type string")
    return df.withColumn("date", F.to_date("ts"))


def test_gap_of_exactly_a_minute_stays_in_the_group(spark):
    ev = events(
        spark,
        [
            (1, "2024-01-01 10:00:00", "hot"), (1, "2024-01-01 10:01:00", "hot"), (1, "2024-01-01 10:02:01", "cold"),
            (1, "2024-01-01 23:59:40", "hot"), (1, "2024-01-02 00:00:30", "cold"), (1, "2024-01-04 09:00:00", "hot"),
            (2, "2024-01-01 10:02:02", "hot"),
        ],
    )
    groups = eda.gap_groups(ev)
    got = {r["event_id"]: r["grp"] for r in groups.collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 3, 6: 0}
    counts = {r["consistent"]: r["n"] for r in eda.group_consistency(groups).collect()}
    assert counts == {True: 4, False: 1}
    gaps = {r["event_id"]: r["gap_min"] for r in eda.next_gap_minutes(ev).collect()}
    assert gaps[0] == 1.0 and gaps[3] == pytest.approx(50 / 60) and gaps[5] is None and gaps[6] is None


def test_a_person_with_half_of_all_events_is_scanned_in_pieces(spark):
    rng = np.random.default_rng(2)
    start = dt.datetime(2024, 1, 5)
    hot = [(k, 1, start + dt.timedelta(seconds=int(s))) for k, s in enumerate(rng.integers(0, 86_000, 6000))]
    rest = [(6000 + k, int(p), start + dt.timedelta(minutes=int(m))) for k, (p, m) in enumerate(zip(rng.integers(2, 300, 6000), rng.integers(0, 40_000, 6000)))]
    rows = hot + rest
    df = spark.createDataFrame([(*r, "hot") for r in rows], "event_id long, person_id long, ts timestamp_ntz, type string").withColumn("date", F.to_date("ts"))
    want, gaps = {}, {}
    for p in {r[1] for r in rows}:
        mine = sorted((r[2], r[0]) for r in rows if r[1] == p)
        grp = 0
        for k, (t, e) in enumerate(mine):
            grp += k > 0 and t - mine[k - 1][0] > dt.timedelta(minutes=1)
            want[e] = grp
            gaps[e] = (mine[k + 1][0] - t).total_seconds() / 60 if k + 1 < len(mine) else None
    assert {r["event_id"]: r["grp"] for r in eda.gap_groups(df).collect()} == want
    assert {r["event_id"]: r["gap_min"] for r in eda.next_gap_minutes(df).collect()} == pytest.approx(gaps)
    placed = scan.pieces(df, [F.col("person_id"), F.col("ts"), F.col("event_id")])
    assert max(r["count"] for r in placed.groupBy("_piece", "person_id").count().collect()) <= 0.05 * len(rows)


def test_night_band_wraps_midnight(spark):
    hours = spark.range(24).withColumnRenamed("id", "h")
    got = {r["h"]: r["b"] for r in hours.select("h", eda.band_of(F.col("h")).alias("b")).collect()}
    assert [h for h, b in got.items() if b == "night"] == [0, 1, 2, 3, 4, 22, 23]
    assert got[9] is None and got[8] == "morning" and got[13] == "lunch" and got[17] == "evening"


def test_histogram_keeps_the_maximum_and_constant_values(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.9,), (10.0,)], "v double")
    assert {r["bin"]: r["n"] for r in eda.histogram(df, "v", 10).collect()} == {0: 1, 1: 1, 9: 2}
    one = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert {r["bin"]: r["n"] for r in eda.histogram(one, "v", 10).collect()} == {0: 2}


def test_facets_combine(spark):
    rows = [("V1", "H1", "Male", 25, 91.0), ("V2", "H10", "Female", 25, 85.0), ("V3", "H2", "Male", 60, 79.9)]
    df = spark.createDataFrame(rows, "id string, family_id string, gender string, age int, accuracy double")
    pick = lambda **k: {r["id"] for r in eda.facet_filter(df, **k).collect()}
    assert pick(search="h1") == {"V1", "V2"}
    assert pick(accuracy="80-90") == {"V2"} and pick(accuracy="<80", age="60+") == {"V3"}
    assert pick(search="h1", gender="Male") == {"V1"}


def test_incomplete_days_and_blocks_are_left_out(spark, slots_of):
    dense = grid.dense_grid(slots_of([(1, 1, 3, 10), (2, 1, 4, 10)]))
    short = dense.filter("not (person_id = 2 and slot = 47)")
    assert [r["person_id"] for r in grid.day_vectors(short).collect()] == [1]
    s = slots_of([(1, 1, 3, 10), (1, 5, 3, 30), (1, 5, 4, 20), (2, 1, 3, 10), (2, 4, 3, 5)])
    got = grid.five_day_shapes(grid.calendar_grid(s), "2024-01-01").collect()
    assert [(r["person_id"], r["block"]) for r in got] == [(1, 0)]
    assert got[0]["vec"][3] == 1.0 and got[0]["vec"][4] == 0.5


def test_sparse_shapes_equal_those_of_the_calendar_grid(spark, slots_of):
    """Random persons with gaps of whole blocks, incomplete first and last blocks, and blocks before the start."""
    rng = np.random.default_rng(4)
    rows = {(p, int(d), int(s)) for p in range(12) for d, s in zip(rng.integers(1, 31, 6), rng.integers(0, 48, 6))}
    rows |= {(50, 1, 5), (50, 30, 5), (51, 6, 0), (51, 10, 47), (52, 2, 3), (52, 6, 3)}
    s = slots_of([(p, d, k, 1 + p + d + k) for p, d, k in sorted(rows)])
    for start in (grid.first_day(s), F.lit("2024-01-09").cast("date")):
        want = sorted(map(tuple, grid.five_day_shapes(grid.with_blocks(grid.calendar_grid(s), start).drop("block"), start).collect()))
        assert sorted(map(tuple, grid.sparse_five_day_shapes(s, start).collect())) == want
        assert any(not any(vec) for *_, vec in want)


def test_days_are_placed_by_their_number_not_their_bytes(spark, slots_of):
    """A task has so many days however small their bytes, and a join on the day keeps that placement."""
    s = slots_of([(p, d, 3, 5) for p in range(9) for d in range(1, 5)])
    dense = grid.dense_grid(grid.placed_by_day(s, 40 * grid.DAY_ROWS))
    assert dense.rdd.getNumPartitions() == 40
    days = grid.placed_by_day(s.groupBy(*grid.DAY).agg(F.max("slot").alias("m")), 40 * grid.DAY_ROWS)
    assert dense.join(days.hint("merge"), grid.DAY).rdd.getNumPartitions() == 40


def test_projection_computes_its_vectors_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        seen.add(1)
        return [float(i), float(i * i % 7), 1.0]

    out = diagnostics.project_2d(spark.range(40).select("id", vector("id").alias("vec")), ["id"])
    assert out.count() == 40 and len(out.collect()) == 40
    assert seen.value == 40


def test_quantiles_equal_numpy_with_weights_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v), int(w)) for g in "AB" for v, w in zip(rng.integers(0, 30, 50), rng.integers(1, 5, 50))]
    rows += [("C", 7.0, 3)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    for weight in (None, "w"):
        got = {r["g"]: r for r in evaluate.quartiles(df, "v", ["g"], weight).collect()}
        for g in "ABC":
            x = [v for gg, v, w in rows if gg == g for _ in range(w if weight else 1)]
            q1, q3 = np.percentile(x, [25, 75])
            assert (got[g]["q1"], got[g]["q3"]) == (pytest.approx(q1), pytest.approx(q3))
    flat = evaluate.quartiles(df, "v", []).first()
    assert flat["q1"] == pytest.approx(np.percentile([r[1] for r in rows], 25))


def test_quantiles_of_values_over_twelve_decades(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "FEW_VALUES", 500)
    left = []
    around = evaluate._around_ranks
    monkeypatch.setattr(evaluate, "_around_ranks", lambda *a, **k: left.append(a) or around(*a, **k))
    x = 10 ** np.random.default_rng(5).uniform(-6, 6, 20_000)
    df = spark.createDataFrame([("A", float(v)) for v in x], "g string, v double")
    got = evaluate.quantiles(df, "v", ["g"], {"a": 0.01, "b": 0.25, "c": 0.75}).first()
    assert [got[c] for c in "abc"] == pytest.approx(np.percentile(x, [1, 25, 75]).tolist())
    assert 2 <= len(left) <= 6  # passes until the rest is small


@pytest.mark.parametrize(
    "days,want",
    [(365, (356, 5, 4)), (31, (22, 5, 4)), (29, (20, 5, 4)), (28, (19, 4, 5)), (5, (3, 1, 1)), (6, (4, 1, 1))],
)
def test_date_split(spark, days, want):
    start = dt.date(2024, 1, 1)
    rows = [("A", 1, start + dt.timedelta(d), h) for d in range(days) for h in (1, 2)]
    df = spark.createDataFrame(rows, "pattern string, person_id long, date date, hour int")
    got = evaluate.split_by_date(df).groupBy("split").agg(F.countDistinct("date").alias("n"))
    n = {r["split"]: r["n"] for r in got.collect()}
    assert set(n) == {"train", "valid", "holdout"} and tuple(n[s] for s in ("train", "valid", "holdout")) == want


def test_few_dates_are_split_by_row_hash(spark):
    rows = [("A", 1, dt.date(2024, 1, 1 + d % 4), d % 24, d % 2 * 30) for d in range(96)]
    df = spark.createDataFrame(rows, "pattern string, person_id long, date date, hour int, minute int").distinct()
    n = {r["split"]: r["count"] for r in evaluate.split_by_date(df).groupBy("split").count().collect()}
    assert set(n) == {"train", "valid"} and n["train"] > n["valid"]


def test_accuracy_skips_zero_targets_and_is_strict(spark):
    df = spark.createDataFrame([("a", 100.0, 90.0), ("a", 100.0, 91.0), ("a", 0.0, 5.0), ("z", 0.0, 1.0)], "k string, actual double, pred double")
    got = {r["k"]: r for r in evaluate.regression_metrics(df, ["k"]).collect()}
    assert got["a"]["accuracy"] == 50.0 and got["z"]["accuracy"] == 0.0 and got["z"]["r2"] is None


def test_ensemble_grid_equals_direct_computation(spark):
    rng = np.random.default_rng(0)
    y, b, p = rng.random(30), rng.random(30), rng.random(30)
    df = spark.createDataFrame([("k", *map(float, t)) for t in zip(y, b, p)], "k string, actual double, base double, personal double")
    got = {r["alpha"]: r["r2"] for r in evaluate.ensemble_grid(df, ["k"]).collect()}
    for a in evaluate.ALPHAS:
        want = 1 - ((y - a * b - (1 - a) * p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
        assert got[a] == pytest.approx(want)
    tie = spark.createDataFrame([("k", 0.1, 0.5), ("k", 0.2, 0.5), ("k", 0.3, 0.4)], "k string, alpha double, r2 double")
    assert evaluate.best_alpha(tie, ["k"]).first()["alpha"] == 0.1


def test_adoption_needs_a_gain(spark):
    rows = [(0.5, 0.55, 10.0, 10.0), (0.5, 0.5, 10.0, 15.0), (0.5, 0.54, 10.0, 14.9), (None, None, 1.0, 1.0)]
    df = spark.createDataFrame([(i, 0.4, *r) for i, r in enumerate(rows)], "k int, alpha double, personal_r2 double, ensemble_r2 double, personal_acc double, ensemble_acc double")
    got = {r["k"]: (r["use_ensemble"], r["alpha"]) for r in evaluate.adopt_ensemble(df).collect()}
    assert got[0][0] == (0.55 - 0.5 >= 0.05) and got[1] == (True, 0.4) and got[2] == (False, 0.0) and got[3] == (False, 0.0)


def test_rollback_is_strict(spark):
    rows = [(1, "A", 1, 0.50, 70.0), (1, "A", 2, 0.50, 68.0), (1, "A", 3, 0.47, 68.0), (1, "A", 4, 0.60, 60.0)]
    df = spark.createDataFrame(rows, "user_id long, pattern string, version int, r2 double, accuracy double")
    got = {r["version"]: r["rollback"] for r in quality.compare_versions(df).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}
    assert quality.current_versions(df).first()["version"] == 2
    assert sinks.next_version(df).first()["next_version"] == 5


@pytest.mark.parametrize("n,flag", [(13, False), (14, True)])
def test_decline_run_needs_fourteen_entries(spark, n, flag):
    first = [("s", dt.date(2024, 1, 1), 1.0, 90.0)]
    falls = [("s", dt.date(2024, 1, 2) + dt.timedelta(i), 0.9 - i / 100, 80.0 - i) for i in range(n)]
    df = spark.createDataFrame(first + falls, "scope string, date date, r2 double, accuracy double")
    last = quality.decline_runs(df).orderBy(F.col("date").desc()).first()
    assert (last["decline_days"], last["restart"]) == (n, flag)


def test_decline_run_resets_when_one_metric_recovers(spark):
    rows = [("s", dt.date(2024, 1, d), r, a) for d, r, a in [(1, 0.9, 90.0), (2, 0.8, 80.0), (3, 0.7, 85.0), (4, 0.6, 70.0)]]
    df = spark.createDataFrame(rows, "scope string, date date, r2 double, accuracy double")
    assert [r["decline_days"] for r in quality.decline_runs(df).orderBy("date").collect()] == [0, 1, 0, 1]


def test_ranges_reject_nulls_and_outliers(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (5, 10.1), (5, None)], "output_seq int, ratio_to_prev_day double")
    rules = {k: quality.RANGES[k] for k in df.columns}
    assert quality.keep_valid(df, rules).count() == 1
    got = {r["feature"]: (r["below"], r["above"], r["missing"]) for r in quality.range_violations(df, rules).collect()}
    assert got == {"output_seq": (1, 0, 0), "ratio_to_prev_day": (0, 1, 1)}


def test_gates(spark):
    stats = spark.createDataFrame([("A", 0.6, 10, 0.95), ("B", 0.7, 500, 0.1), ("C", 0.59, 900, 1.0), ("D", None, 0, 0.0)], "scope string, silhouette double, clustered long, coverage double")
    assert {r["scope"]: r["passed"] for r in quality.cluster_gate(stats).collect()} == {"A": True, "B": False, "C": False, "D": False}
    m = spark.createDataFrame([("x", 0.6, 60.0, 30.0)], "scope string, r2 double, accuracy double, rmse double")
    got = {r["metric"]: r["passed"] for r in quality.gates(m, quality.BASE_LIMITS, ("rmse",)).collect()}
    assert got == {"r2": True, "accuracy": True, "rmse": False}


def test_variance_inflation_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random(200), rng.random(200)
    c = a + 0.05 * rng.random(200)
    df = spark.createDataFrame([("s", *map(float, t)) for t in zip(a, b, c)], "g string, a double, b double, c double")
    want = np.diag(np.linalg.inv(np.corrcoef([a, b, c])))
    got = {r["feature"]: r for r in diagnostics.vif_by_scope(df, ["a", "b", "c"], "g").filter("scope = 'all'").collect()}
    assert [got[f]["vif"] for f in "abc"] == pytest.approx(want.tolist())
    assert got["a"]["high"] and not got["b"]["high"]
    kept = diagnostics.replace_by_components(df, ["a", "c"])
    assert kept.columns == ["g", "b", "PC1"]
    x = np.column_stack([(v - v.mean()) / v.std() for v in (a, c)])
    first = np.abs(x @ np.linalg.eigh(np.cov(x.T))[1][:, -1])
    assert np.abs([r["PC1"] for r in kept.collect()]) == pytest.approx(first)


def test_components_2d_are_centred(spark):
    rng = np.random.default_rng(5)
    x = rng.random((50, 4)) + 3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vec array<double>")
    got = {r["id"]: (r["x"], r["y"]) for r in diagnostics.project_2d(df, ["id"]).collect()}
    c = x - x.mean(0)
    basis = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.abs([got[i] for i in range(50)]) == pytest.approx(np.abs(c @ basis.T))


def test_importance_tables(spark):
    imp = spark.createDataFrame([("A", "f1", 90.0), ("A", "f2", 9.9), ("A", "f3", 0.1)], "scope string, feature string, gain double")
    got = {r["feature"]: r["keep"] for r in diagnostics.importance_shares(imp, ["scope"]).collect()}
    assert got == {"f1": True, "f2": True, "f3": False}
    vifs = spark.createDataFrame([("A", "f1", 3.0)], "scope string, feature string, vif double")
    joined = {r["feature"]: (r["rank"], r["vif"]) for r in diagnostics.importance_with_vif(imp, vifs, 2).collect()}
    assert joined == {"f1": (1, 3.0), "f2": (2, 0.0)}


def test_label_json(spark):
    text = '{"Wav":{"SignalToNoiseRatio":"12dB"},"Other":{"SpeechStart":"0.1","SpeechEnd":"1.2"},"Speaker":{"Age":"20s","Gender":"Male"},"Environment":{"NoiseEnviron":"home","RecordingEnviron":"indoor"}}'
    df = spark.createDataFrame([(1, text), (2, "{broken")], "id int, json string")
    got = {r["id"]: r for r in tables.parse_labels(df).collect()}
    assert (got[1]["snr"], got[1]["speech_end"], got[1]["noise_env"]) == (12, 1.2, "home")
    assert got[2]["snr"] is None


def test_version_key_and_gender(spark):
    df = spark.createDataFrame([(7, "A", dt.date(2024, 3, 5), 2, "male"), (8, "B", dt.date(2024, 3, 5), 1, "Female")], "u long, c string, d date, v int, g string")
    got = df.select(S.version_key(F.col("u"), F.col("c"), F.col("d"), F.col("v")), S.gender_flag(F.col("g"))).collect()
    assert [tuple(r) for r in got] == [("7_A_20240305_v2", 1), ("8_B_20240305_v1", 0)]
