"""Clustering, silhouette and warping against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dripline.functions import arrays as A
from dripline.functions.dtw import cumulative_rows, dtw_by_length, dtw_rows, dtw_table, short_form
from dripline.operators import shape, tiles
from dripline.operators.components import components


def brute_dbscan(x, w, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near @ w >= least
    label, count = np.full(len(x), -1), 0
    for i in range(len(x)):
        if label[i] >= 0 or not core[i]:
            continue
        label[i], stack = count, [i]
        while stack:
            u = stack.pop()
            if core[u]:
                for k in np.flatnonzero(near[u] & (label < 0)):
                    label[k] = count
                    stack.append(k)
        count += 1
    return label, core


def brute_silhouette(x, w, label):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = {}
    for i in np.flatnonzero(label >= 0):
        size = {c: w[label == c].sum() for c in set(label[label >= 0])}
        mean = {c: (d[i][label == c] * w[label == c]).sum() for c in size}
        own = label[i]
        if size[own] == 1 or len(size) == 1:
            out[i] = 0.0
            continue
        a = mean[own] / (size[own] - 1)
        b = min(mean[c] / size[c] for c in size if c != own)
        out[i] = (b - a) / max(a, b) if max(a, b) else 0.0
    return out


def brute_dtw(a, b):
    t = np.full((len(a) + 1, len(b) + 1), np.inf)
    t[0, 0] = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i, j] = (x - y) ** 2 + min(t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])
    return np.sqrt(t[-1, -1])


def sparse(n, seed, nonzero=4):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 48))
    for row in x:
        row[rng.choice(12, rng.integers(1, nonzero + 1), replace=False)] = rng.random()
    x *= rng.random((n, 48))
    x /= x.max(axis=1, keepdims=True)
    return np.unique(x, axis=0)


def table(spark, x, w, pattern="A"):
    rows = [(pattern, [float(v) for v in row], int(k), int(i)) for i, (row, k) in enumerate(zip(x, w))]
    return spark.createDataFrame(rows, "pattern string, vec array<double>, weight long, row_key long")


@pytest.mark.parametrize("eps,least", [(0.5, 3), (0.9, 4), (1.2, 10)])
def test_density_clusters_match_brute_force(spark, monkeypatch, eps, least):
    monkeypatch.setattr(tiles.compare_tiles, "__defaults__", ("row_key", 40))  # many tiles per bucket
    x = sparse(180, 3)
    w = np.random.default_rng(1).integers(1, 4, len(x))
    label, core = brute_dbscan(x, w, eps, least)
    got = sorted(shape.dbscan(table(spark, x, w), {"A": (eps, least)}).collect(), key=lambda r: r["row_key"])
    assert [r["core"] for r in got] == core.tolist()
    assert [r["label"] for r in got] == label.tolist()


def test_border_row_joins_the_lowest_cluster_that_reaches_it(spark):
    x = np.zeros((7, 48))
    x[:, 0] = 1.0
    x[:, 1] = [0.0, 0.1, 0.2, 0.5, 0.8, 0.9, 1.0]  # row 3 is reachable from both ends, itself not core
    label, core = brute_dbscan(x, np.ones(7, int), 0.31, 4)
    got = sorted(shape.dbscan(table(spark, x, np.ones(7)), {"A": (0.31, 4)}).collect(), key=lambda r: r["row_key"])
    assert [r["label"] for r in got] == label.tolist()


def test_patterns_are_clustered_apart_with_their_own_parameters(spark):
    x = sparse(60, 9)
    w = np.ones(len(x), int)
    both = table(spark, x, w, "A").unionByName(table(spark, x, w, "B"))
    got = shape.dbscan(both, {"A": (0.5, 3), "B": (0.9, 5)}).collect()
    for p, (eps, least) in {"A": (0.5, 3), "B": (0.9, 5)}.items():
        rows = sorted((r for r in got if r["pattern"] == p), key=lambda r: r["row_key"])
        assert [r["label"] for r in rows] == brute_dbscan(x, w, eps, least)[0].tolist()


def test_silhouette_matches_brute_force(spark):
    x = sparse(120, 4)
    w = np.random.default_rng(2).integers(1, 4, len(x))
    label = np.arange(len(x)) % 4 - 1
    df = table(spark, x, w).withColumn("label", (F.col("row_key") % 4 - 1).cast("int"))
    got = {r["row_key"]: r["silhouette"] for r in shape.silhouette_samples(df).collect()}
    want = brute_silhouette(x, w, label)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_one_cluster_has_silhouette_zero(spark):
    x = sparse(20, 5)
    df = table(spark, x, np.ones(len(x))).withColumn("label", F.lit(0))
    assert {r["silhouette"] for r in shape.silhouette_samples(df).collect()} == {0.0}
    assert shape.squared_silhouette(df, "A") == 0.0


def test_warping_distance_matches_the_plain_recurrence():
    x, y = sparse(12, 6), sparse(12, 7)
    n = min(len(x), len(y))
    got = dtw_rows(x[:n], y[:n])
    assert got == pytest.approx([brute_dtw(a, b) for a, b in zip(x, y)][:n])
    assert dtw_rows(x, x) == pytest.approx(np.zeros(len(x)))


def test_representative_is_the_member_with_the_smallest_mean_distance(spark):
    x = sparse(40, 8)
    w = np.random.default_rng(3).integers(1, 4, len(x))
    df = table(spark, x, w).withColumn("label", F.lit(0))
    best = spark.createDataFrame([("A", 0)], "pattern string, label int")
    d = np.array([[brute_dtw(a, b) for b in x] for a in x])
    mean = (d @ w) / w.sum()
    got = shape.medoids(df, best, tile=16).first()
    assert got["row_key"] == int(mean.argmin())
    assert got["mean_dtw"] == pytest.approx(mean.min(), abs=1e-8)


def test_tied_representatives_resolve_to_the_first_row(spark):
    x = np.zeros((2, 48))
    x[0, 3] = x[1, 9] = 1.0  # both inner spikes: distance 0
    df = table(spark, x, [1, 1]).withColumn("label", F.lit(0))
    best = spark.createDataFrame([("A", 0)], "pattern string, label int")
    assert shape.medoids(df, best).first()["row_key"] == 0


def test_outlier_fence_is_strict_and_weighted(spark):
    x = sparse(50, 11)
    w = np.random.default_rng(4).integers(1, 5, len(x))
    centre = spark.createDataFrame([("A", [float(v) for v in x[0]])], "pattern string, vec array<double>")
    got = {r["row_key"]: r for r in shape.warping_outliers(table(spark, x, w), centre).collect()}
    d = dtw_rows(cumulative_rows(np.repeat(x[:1], len(x), 0)), cumulative_rows(x))
    q1, q3 = np.percentile(np.repeat(d, w), [25, 75])
    for i in range(len(x)):
        assert got[i]["dtw_cum"] == pytest.approx(d[i])
        assert got[i]["outlier"] == (d[i] > q3 + 0.5 * (q3 - q1) + 1e-12)


def test_normalisers_handle_constant_vectors(spark):
    df = spark.createDataFrame([([2.0, 2.0],), ([0.0, 0.0],), ([1.0, 3.0],)], "v array<double>")
    got = df.select(A.minmax(F.col("v")), A.cumulative_minmax(F.col("v")), A.max_norm(F.col("v"))).collect()
    assert [list(map(list, r)) for r in got] == [
        [[0.0, 0.0], [0.0, 1.0], [1.0, 1.0]],
        [[0.0, 0.0], [0.0, 0.0], [0.0, 0.0]],
        [[0.0, 1.0], [0.0, 1.0], [1.0 / 3.0, 1.0]],
    ]


def test_components_follow_a_long_chain_and_a_hub(spark):
    edges = [("A", i, i + 1) for i in range(100)] + [("A", 200, 200 + i) for i in range(1, 50)] + [("B", 5, 3)]
    got = {(r[0], r[1]): r[2] for r in components(spark.createDataFrame(edges, "pattern string, a long, b long"), ["pattern"]).collect()}
    assert all(got["A", i] == 0 for i in range(101))
    assert all(got["A", 200 + i] == 200 for i in range(1, 50))
    assert got["A", 200] == 200 and got["B", 5] == got["B", 3] == 3


def test_sweep_rules_and_small_inputs(spark):
    assert shape.next_params(0.9, 3, "no_clusters") == (pytest.approx(1.08), 3)
    assert shape.next_params(1.4, 3, "no_clusters") == (1.5, 3)
    assert shape.next_params(0.9, 3, "clusters", silhouette_ok=False) == (0.9, 4)
    assert shape.next_params(0.9, 10, "clusters", silhouette_ok=False) == (pytest.approx(0.81), 10)
    assert shape.next_params(0.9, 5, "clusters", covered_ok=False) == (pytest.approx(0.99), 4)
    labels, log = shape.sweep(table(spark, sparse(30, 2), np.ones(30)[: len(sparse(30, 2))]))
    assert labels.count() == len(sparse(30, 2)) and log[0][1] == 1  # a small pattern is clustered like any other
    assert all(entry[-1] for entry in log)


def test_equal_days_collapse_into_one_weighted_vector(spark):
    v = [1.0] + [0.0] * 47
    rows = [("A", p, dt.date(2024, 1, d), v) for p in (1, 2) for d in (1, 2)]
    df = spark.createDataFrame(rows, "pattern string, person_id long, date date, vec array<double>")
    got = shape.distinct_vectors(df).collect()
    assert len(got) == 1 and got[0]["weight"] == 4


@pytest.mark.parametrize("spread", [0.02, 0.12, 0.3])
def test_silhouette_bounds_hold_the_exact_mean_and_close(spark, spread):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(90):
        label = k % 3
        v = np.zeros(48)
        v[10 + 12 * label] = 1.0
        v[11 + 12 * label] = 0.5 + spread * rng.random()
        v[rng.integers(0, 48)] += spread
        rows.append(("A", [float(x) for x in v / v.max()], int(rng.integers(1, 4)), k, label))
    df = spark.createDataFrame(rows, "pattern string, vec array<double>, weight int, row_key long, label int").cache()
    exact = shape.silhouette_overall(shape.silhouette_samples(df)).first()["silhouette"]
    widths = []
    for level in range(shape.LAST_LEVEL + 1):
        got, compared = shape.silhouette_interval(df, level)
        low, high = got.select("low", "high").first()
        assert low - 1e-9 <= exact <= high + 1e-9
        widths.append(high - low)
    assert widths[-1] < 1e-9 and widths[0] < 1.0
    log = []
    verdict = shape.gate_by_interval(df, log).first()
    assert verdict["passed"] == (round(exact, 6) >= shape.MIN_SILHOUETTE)
    assert log[0][2] < 90 * 90


def test_short_forms_never_exceed_the_warping_distance(spark):
    x = sparse(40, 21)
    short = spark.createDataFrame([([float(v) for v in row],) for row in x], "vec array<double>")
    short = [np.array(r[0]) for r in short.select(short_form(F.col("vec"))).collect()]
    assert max(len(s) for s in short) < 20
    low = dtw_by_length(short, short)
    full = np.array([[brute_dtw(a, b) for b in x] for a in x])
    assert low == pytest.approx(np.array([[brute_dtw(a, b) for b in short] for a in short]))
    assert (low <= full + 1e-12).all()


def test_few_members_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(shape, "FIRST_COMPARED", 4)
    x = sparse(300, 22)
    w = np.random.default_rng(5).integers(1, 4, len(x))
    df = table(spark, x, w).withColumn("label", F.lit(0))
    log = []
    got = shape.medoids(df, spark.createDataFrame([("A", 0)], "pattern string, label int"), tile=64, log=log).first()
    mean = dtw_table(x, x) @ w / w.sum()
    assert got["row_key"] == int(mean.argmin())
    assert got["mean_dtw"] == pytest.approx(mean.min(), abs=1e-8)
    assert log[0][0] == len(x) and log[0][1] <= len(x) // 2


@pytest.mark.parametrize("eps,least", [(0.5, 3), (0.9, 4), (1.2, 10)])
def test_density_clusters_in_portions_match_brute_force(spark, monkeypatch, eps, least):
    monkeypatch.setattr(shape, "FIRST_PORTION", 3)
    x = sparse(180, 3)
    w = np.random.default_rng(1).integers(1, 4, len(x))
    label, core = brute_dbscan(x, w, eps, least)
    got = sorted(shape.dbscan(table(spark, x, w), {"A": (eps, least)}).collect(), key=lambda r: r["row_key"])
    assert [r["core"] for r in got] == core.tolist()
    assert [r["label"] for r in got] == label.tolist()


def test_rows_that_found_enough_neighbours_leave_the_search(spark, monkeypatch):
    monkeypatch.setattr(shape, "FIRST_PORTION", 8)
    rng = np.random.default_rng(6)
    x = np.zeros((400, 48))
    x[:, 0], x[:, 1:6] = 1.0, rng.random((400, 5)) * 0.3  # one bucket, one cluster
    compared = []
    plain = tiles.compare_tiles

    def counted(left, right, *rest, **more):
        compared.append(left.count() * right.count())
        return plain(left, right, *rest, **more)

    monkeypatch.setattr(shape, "compare_tiles", counted)
    got = shape.dbscan(table(spark, x, np.ones(400, int)), {"A": (0.31, 3)}).collect()
    label, core = brute_dbscan(x, np.ones(400, int), 0.31, 3)
    assert [r["label"] for r in sorted(got, key=lambda r: r["row_key"])] == label.tolist()
    assert sum(compared) < 400 * 400


def test_one_cluster_needs_no_comparison(spark, monkeypatch):
    given = []
    plain = shape.compare_within

    def counted(rows, *rest, **more):
        given.append(rows.count())
        return plain(rows, *rest, **more)

    monkeypatch.setattr(shape, "compare_within", counted)
    df = table(spark, sparse(30, 5), np.ones(30)).withColumn("label", F.when(F.col("row_key") > 3, 0).otherwise(-1))
    got = shape.silhouette_samples(df).collect()
    assert given == [0]
    assert len(got) == df.filter("label = 0").count() and {r["silhouette"] for r in got} == {0.0}


def test_silhouette_copies_packed_tiles_only(spark, monkeypatch):
    """Every row was copied to a task for each tile of its pattern; now a tile is one small blob."""
    x = sparse(150, 6)
    x[70:74] = x[:4] + 1e-5
    w = np.random.default_rng(3).integers(1, 4, len(x))
    df = table(spark, x, w).withColumn("label", F.when(F.col("row_key") < 100, 0).otherwise(F.col("row_key") % 7 - 1).cast("int"))
    monkeypatch.setattr(tiles, "_cogroup", None)
    monkeypatch.setattr(tiles, "PACKED_TILE", 20)
    monkeypatch.setattr(shape, "COLUMNS", 8)
    monkeypatch.setattr(shape, "STRIP", 4)
    got = {r["row_key"]: r["silhouette"] for r in shape.silhouette_samples(df).collect()}
    label = np.array([0 if i < 100 else i % 7 - 1 for i in range(len(x))])
    want = brute_silhouette(x, w, label)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    tile = tiles.packed(df.select("pattern", "row_key", "vec", "weight", "label"), ["pattern"], ["weight", "label"], "label").collect()
    assert len(tile) <= 8 and sum(len(tiles.unpacked(r["blob"])["row_key"]) for r in tile) == len(x)
    whole = {k: v for r in tile for k, v in zip(*(tiles.unpacked(r["blob"])[c] for c in ("row_key", "vec")))}
    assert all((whole[k] == x[k]).all() for k in range(len(x)))


@pytest.mark.parametrize("clusters", [1, 9])
def test_days_without_a_common_slot_are_not_compared(clusters, monkeypatch):
    """Sums of distances equal those of all pairs, though only pairs with a common slot are compared."""
    rng = np.random.default_rng(clusters)

    def tile(x):
        label = np.sort(rng.integers(0, clusters, len(x)))
        return {"vec": x, "label": label, "weight": rng.integers(1, 4, len(x)), "row_key": np.arange(len(x))}

    def brute(a, b):
        d = np.sqrt(((a["vec"][:, None] - b["vec"][None]) ** 2).sum(-1)) * b["weight"]
        return np.stack([d[:, b["label"] == c].sum(1) for c in np.unique(b["label"])], axis=1)

    x, y = (sparse(n, 8, nonzero=3) for n in (200, 230))
    x, y = (v / v.max(axis=1, keepdims=True) for v in (x, y))
    y[:9], y[9:12] = x[:9], x[9:12] * (1 + 1e-8)
    empty = x.copy()
    empty[::50] = 0.0
    compared = []
    table = shape._distance_table

    def counted(a, b, rows, columns):
        compared.append(len(rows) * len(columns))
        return table(a, b, rows, columns)

    monkeypatch.setattr(shape, "_distance_table", counted)
    for one, other in ((tile(x), tile(y)), (tile(empty), tile(y)), (tile(7 * x), tile(y)), (tile(x), tile(np.abs(rng.normal(size=(40, 48)))))):
        compared.clear()
        (_, to_right), (_, to_left) = shape._distance_sums(None, one, other)
        assert to_right == pytest.approx(brute(one, other), rel=1e-12) and to_left == pytest.approx(brute(other, one), rel=1e-12)
        if len(other["vec"]) == 230:
            assert sum(compared) < 200 * 230 / 2
        ((_, within),) = shape._distance_sums(None, one, one)
        assert within == pytest.approx(brute(one, one), rel=1e-9, abs=1e-9)
