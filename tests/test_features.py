"""Feature rules against a row-by-row reference on hand-made days."""

import random
import statistics

import pytest

from dripline.operators import features

NAMES = [c for c in features.FEATURES if c != "output_seq"]


def naive(rows, wrap=False):
    """Follow one person's days in order; previous means the last day on which anybody dispensed."""
    use = [r for r in rows if r[3] > 0]
    dates = sorted({d for _, d, _, _ in use})
    out = {}
    for person in {p for p, *_ in use}:
        by_day = {d: sorted((s, a) for p, dd, s, a in use if p == person and dd == d) for d in dates}
        for i, d in enumerate(dates):
            prev = by_day[dates[i - 1]] if i else (by_day[dates[-1]] if wrap else [])
            total = sum(a for _, a in prev)
            for n, (s, a) in enumerate(by_day[d], 1):
                row = dict.fromkeys(NAMES, 0.0)
                if total > 0:
                    before = [x for _, x in by_day[d][: n - 1]]
                    amounts = [x for _, x in prev]
                    row["prev_sum"] = sum(before)
                    row["ratio_to_prev_day"] = (sum(before) + a) / total
                    row["ratio_prev_to_total"] = sum(x for t, x in prev if t <= s) / total
                    row["time_diff_prev_outputs"] = (s - by_day[d][n - 2][0]) * 1800.0 if n > 1 else 0.0
                    row["prev_day_total"] = total
                    row["prev_day_mean"] = total / len(prev)
                    row["prev_day_std"] = statistics.stdev(amounts) if len(prev) > 1 else 0.0
                    if n >= 2 and len(prev) >= n:
                        row["slope_prev_day_n_n_minus_1"] = amounts[n - 1] - amounts[n - 2]
                    if n >= 3 and len(prev) >= n - 1:
                        row["slope_prev_day_n_minus_1_n_minus_2"] = amounts[n - 2] - amounts[n - 3]
                    if len(prev) >= 2:
                        mx, my = (len(prev) + 1) / 2, total / len(prev)
                        num = sum((k - mx) * (x - my) for k, x in enumerate(amounts, 1))
                        row["avg_change_rate"] = num / sum((k - mx) ** 2 for k in range(1, len(prev) + 1))
                    row["prev_output"] = before[-1] if before else 0.0
                    row["prev_prev_output"] = before[-2] if len(before) > 1 else 0.0
                out[person, d, s] = (n, row)
    return out


def check(df, want):
    got = {(r["person_id"], r["date"].day, r["hour"] * 2 + r["minute"] // 30): r for r in df.collect()}
    assert got.keys() == want.keys()
    for key, (n, row) in want.items():
        assert got[key]["output_seq"] == n
        for name in NAMES:
            assert got[key][name] == pytest.approx(row[name], abs=1e-6), (key, name)


def test_random_days_match_the_row_by_row_reference(slots_of):
    rng = random.Random(5)
    cells = {(p, d, s) for p in (1, 2, 3) for d in range(1, 8) for s in rng.sample(range(48), rng.randint(0, 7))}
    rows = [(p, d, s, rng.choice([0, 120, 140, 260, 500, 1000])) for p, d, s in sorted(cells)]
    check(features.feature_table(slots_of(rows)), naive(rows))
    check(features.feature_table(slots_of(rows), wrap=True), naive(rows, wrap=True))


def test_missing_calendar_day_keeps_the_older_day_as_previous(slots_of):
    rows = [(1, 1, 10, 100), (1, 4, 10, 50)]
    out = {r["date"].day: r for r in features.feature_table(slots_of(rows)).collect()}
    assert out[4]["prev_day_total"] == 100.0 and out[4]["ratio_prev_to_total"] == 1.0


def test_no_dispense_on_previous_day_zeroes_every_feature(slots_of):
    rows = [(1, 1, 5, 100), (2, 2, 5, 10), (1, 3, 4, 10), (1, 3, 9, 20)]
    late = [r for r in features.feature_table(slots_of(rows)).collect() if r["date"].day == 3]
    assert [r["output_seq"] for r in sorted(late, key=lambda r: r["hour"])] == [1, 2]
    assert all(r[n] == 0.0 for r in late for n in NAMES)


def test_upto_now_includes_the_equal_slot_and_reaches_one_at_the_last(slots_of):
    rows = [(1, 1, 10, 30), (1, 1, 20, 70), (1, 2, 10, 5), (1, 2, 47, 5)]
    out = {r["hour"]: r for r in features.feature_table(slots_of(rows)).collect() if r["date"].day == 2}
    assert out[5]["ratio_prev_to_total"] == pytest.approx(0.3)
    assert out[23]["ratio_prev_to_total"] == 1.0


def test_person_set_is_fixed_by_the_day_before_start(slots_of):
    rows = [(1, 1, 1, 10), (1, 2, 1, 10), (2, 2, 1, 10), (3, 1, 1, 10), (3, 3, 1, 10)]
    out = features.features_for_known_persons(slots_of(rows), "2024-01-02", "2024-01-01")
    assert sorted((r["person_id"], r["date"].day) for r in out.collect()) == [(1, 2), (3, 3)]
    few = features.features_for_known_persons(slots_of(rows), "2024-01-02", "2024-01-01", n=1)
    assert {r["person_id"] for r in few.collect()} == {1}


def test_sequence_numbers_are_zero_on_empty_slots(slots_of):
    rows = [(1, 1, 1, 0), (1, 1, 2, 10), (1, 1, 3, 0), (1, 1, 4, 5)]
    out = {r["slot"]: r["output_seq"] for r in features.with_sequence(slots_of(rows)).collect()}
    assert out == {1: 0, 2: 1, 3: 0, 4: 2}


def test_one_exchange_by_person_after_the_slot_sums(spark):
    from dripline.plans import inputs

    plan = inputs.feature_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pattern#") == 3  # slot sums twice (the second is reused), persons once
    main = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert len(main) == 1
    assert "SortMergeJoin" not in plan


def test_feature_override_needs_two_names():
    assert features.feature_columns(["prev_sum"]) == features.MODEL_FEATURES
    assert features.feature_columns(["prev_sum", "time_sin"]) == ["prev_sum", "time_sin"]


def test_result_does_not_depend_on_partitioning(spark):
    from dripline.plans import inputs

    base = "/root/testdata/sf0.001"
    a = {tuple(r) for r in inputs.feature_rows(spark, base).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = {tuple(r) for r in inputs.feature_rows(spark, base).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
