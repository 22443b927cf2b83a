"""Learning operators: gradients, fits, streaming forms."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dripline.operators import classify, evaluate, personal, regress, voice
from dripline.session import scratch_path
from dripline.streaming import slots as streaming


def shapes(spark, n=20, patterns=("A", "B")):
    rng = np.random.default_rng(0)
    rows = []
    for k, p in enumerate(patterns):
        for i in range(n):
            v = np.exp(-((np.arange(48) - 10 - 20 * k) ** 2) / 18) + 0.05 * rng.random(48)
            rows.append((p, i, 0, [float(x) for x in v / v.max()]))
    return spark.createDataFrame(rows, "pattern string, person_id long, block int, vec array<double>")


def test_gradient_matches_finite_differences():
    w = classify.initial_weights(1)
    x = np.random.default_rng(2).random((3, 48))
    grads = classify.gradient_sum(w, x)
    loss = lambda: ((classify._forward(w, x)[-1] - x) ** 2).sum()
    rng = np.random.default_rng(3)
    for layer, g in zip(w, grads):
        at = tuple(rng.integers(0, s) for s in layer.shape)
        old = layer[at]
        layer[at] = old + 1e-6
        up = loss()
        layer[at] = old - 1e-6
        down = loss()
        layer[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_training_does_not_depend_on_partitions_and_separates_patterns(spark):
    df = shapes(spark).cache()
    one = classify.train(df.coalesce(1), epochs=3)
    many = classify.train(df.repartition(5), epochs=3)
    assert all(np.allclose(a, b, atol=1e-9) for p in one for a, b in zip(one[p], many[p]))
    models = classify.train(df, epochs=40, rate=0.01)
    errors = classify.reconstruction_errors(df, models).cache()
    limits, ok = classify.choose_thresholds(errors)
    acc = {r["pattern"]: r for r in classify.pattern_accuracy(classify.predict(errors, limits)).collect()}
    assert all(r["accuracy"] + r["unknown"] == pytest.approx(1.0) and r["accuracy"] > 0.6 for r in acc.values())


def test_training_equals_numpy_over_all_epochs(spark):
    df = shapes(spark, 15)
    got = classify.train(df.repartition(3))
    for p in "AB":
        x = np.array([r["vec"] for r in df.filter(F.col("pattern") == p).collect()])
        w = classify.initial_weights(42)
        m, v = [[np.zeros_like(a) for a in w] for _ in range(2)]
        for t in range(1, classify.EPOCHS + 1):
            for k, g in enumerate(classify.gradient_sum(w, x)):
                g = g / x.size
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 1e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        loss = lambda weights: ((classify._forward(weights, x)[-1] - x) ** 2).mean()
        assert loss(got[p]) == pytest.approx(loss(w), abs=1e-8)


def test_thresholds_fall_back_to_the_first_step(spark):
    rows = [("A", i, "A", float(i % 10 == 0)) for i in range(20)] + [("B", i, "A", 9.0) for i in range(20)]
    errors = spark.createDataFrame(rows, "pattern string, person_id long, model string, mse double")
    limits, ok = classify.choose_thresholds(errors)
    assert not ok
    assert limits.first()["threshold"] == pytest.approx(0.1 + 1.5 * 0.3)


def boosted(x, y, p, rows=200):
    bins = np.stack([np.searchsorted(np.quantile(x[:rows, j], np.arange(1, 32) / 32), x[:, j]) for j in range(x.shape[1])], axis=1)
    who, train = np.zeros(len(y), dtype=int), np.arange(len(y)) < rows
    arrays = {k: np.array([p[k]]) for k in ("depth", "trees", "rate", "lam")} | {k: p[k] for k in ("alpha", "subsample")}
    return bins, *personal.boost(bins, y, who, train, arrays, np.array([y[:rows].mean()]), 0)


def test_boosting_learns_and_adjusts():
    rng = np.random.default_rng(1)
    x = rng.random((300, 4))
    y = np.where(x[:, 0] > 0.5, 10.0, 1.0) + x[:, 1]
    p = {**personal.PERSONAL, "trees": 60}
    bins, pred, nodes = boosted(x, y, p)
    assert 1 - ((y[200:] - pred[200:]) ** 2).sum() / ((y[200:] - y[200:].mean()) ** 2).sum() > 0.9
    packed = {c: v.astype(personal._TYPES[c]).tobytes() for c, v in zip(personal._TYPES, nodes[1:])}
    again = personal.tree_sums({"start": y[:200].mean(), "rate": p["rate"], **packed}, bins)
    assert again == pytest.approx(pred)
    low = personal.adjusted(p, 0.1, 10.0)
    assert (low["depth"], low["trees"]) == (6, 72)
    assert low["rate"] == pytest.approx(0.1 / 1.5) and low["lam"] == pytest.approx(1.2)
    assert personal.adjusted(p, 0.9, 90.0) == p


def gains_by_hand(bins, grad, alpha, lam):
    """Gain of every cut of one node."""
    soft = lambda g: np.sign(g) * max(abs(g) - alpha, 0.0)
    score = lambda g, n: soft(g) ** 2 / (n + lam)
    out = {}
    for f in range(bins.shape[1]):
        for c in np.unique(bins[:, f])[:-1]:
            left = bins[:, f] <= c
            out[f, c] = score(grad[left].sum(), left.sum()) + score(grad[~left].sum(), (~left).sum()) - score(grad.sum(), len(grad))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_splits_of_many_nodes_equal_trying_every_cut(seed):
    rng = np.random.default_rng(seed)
    bins, grad = rng.integers(0, 6, (80, 3)), rng.normal(size=80)
    node = rng.integers(-1, 7, 80)
    lam = rng.random(8)
    orders = np.argsort(bins, axis=0, kind="stable").T
    feature, cut = personal.best_splits(orders, bins, grad, node, 8, 0.1, lam)
    for k in range(8):
        rows = node == k
        gains = gains_by_hand(bins[rows], grad[rows], 0.1, lam[k])
        best = max(gains.values(), default=0.0)
        assert gains[feature[k], cut[k]] == pytest.approx(best) if best > 1e-9 else feature[k] == -1


def test_stacked_persons_equal_persons_alone():
    rng = np.random.default_rng(4)
    x, who = rng.integers(0, 20, (120, 3)), np.repeat(np.arange(3), 40)
    y, train = rng.random(120) * 10, np.tile(np.arange(40) < 30, 3)
    p = {"depth": np.array([2, 3, 5]), "trees": np.array([5, 9, 3]), "rate": np.array([0.3, 0.1, 0.2]), "lam": np.array([1.0, 2.0, 0.5])}
    fixed = {"alpha": 0.1, "subsample": 1.0}
    start = np.array([y[(who == k) & train].mean() for k in range(3)])
    pred, nodes = personal.boost(x, y, who, train, {**p, **fixed}, start, 0)
    for k in range(3):
        m = who == k
        alone, own = personal.boost(x[m], y[m], np.zeros(40, dtype=int), train[m], {**{c: v[k : k + 1] for c, v in p.items()}, **fixed}, start[k : k + 1], 0)
        assert pred[m] == pytest.approx(alone) and (nodes[0] == k).sum() == len(own[0])


def personal_rows(spark, days, per_day):
    start = dt.date(2024, 1, 1)
    rng = np.random.default_rng(0)
    rows = [
        ("A", 1, start + dt.timedelta(d), h, 0, 100.0 + 50 * (h % 2) + rng.random(), 120.0, float(h % 2), float(h))
        for d in range(days)
        for h in range(per_day)
    ]
    return spark.createDataFrame(
        rows, "pattern string, person_id long, date date, hour int, minute int, amount double, base double, f1 double, f2 double"
    )


def test_personal_models_score_validation_and_holdout(spark):
    df = evaluate.split_by_date(personal_rows(spark, 30, 8))
    got = personal.personal_predictions(df, ["f1", "f2"], trees=60).collect()
    assert {r["split"] for r in got} == {"valid", "holdout"}
    assert len(got) == 9 * 8
    assert all(abs(r["personal"] - r["actual"]) < 10 for r in got)
    few = evaluate.split_by_date(personal_rows(spark, 5, 1))
    got = personal.personal_predictions(few, ["f1", "f2"], trees=5).collect()
    assert sorted(r["split"] for r in got) == ["holdout", "valid"]
    assert all((r["personal"], r["tries"], r["status"]) == (120.0, 0, "skipped") for r in got)


def test_small_patterns_are_scored_by_the_shared_model(spark):
    many = personal_rows(spark, 20, 8)
    df = many.union(personal_rows(spark, 5, 8).withColumn("pattern", F.lit("B"))).cache()
    models = regress.fit_patterns(df, ["f1", "f2"], rounds=2)
    shared = regress.fit_global(df, ["f1", "f2"], rounds=2)
    got = regress.predict_patterns(models, df, ["f1", "f2"], shared=shared).groupBy("pattern", "status").count()
    assert {tuple(r) for r in got.collect()} == {("A", "fitted", 160), ("B", "skipped", 40)}
    none = regress.predict_patterns({}, df, ["f1", "f2"])
    assert none.count() == 200 and none.filter("pred is not null").count() == 0


def test_global_fit_importance_and_folds(spark):
    df = personal_rows(spark, 20, 8).withColumn("f3", F.lit(1.0)).cache()
    names = ["f1", "f2", "f3"]
    model = regress.fit_global(df, names, rounds=3, depth=3)
    m = evaluate.regression_metrics(regress.predict(model, df, names).withColumn("actual", F.col("amount")), ["pattern"]).first()
    assert m["r2"] > 0.9
    gains = {r["feature"]: r["gain"] for r in regress.gain_importance(model, df, names, "all").collect()}
    assert "f3" not in gains and all(g > 0 for g in gains.values())
    cv = regress.cross_validate(df, names, k=3, rounds=2)
    assert cv.count() == df.count() and cv.select("fold").distinct().count() == 3


def test_weak_models_are_refitted_and_good_ones_kept(spark):
    good = personal_rows(spark, 20, 8)
    noise = good.withColumn("pattern", F.lit("B")).withColumn("amount", F.rand(3) * 1000 + 1)
    df = good.union(noise).union(good.limit(5).withColumn("pattern", F.lit("C"))).cache()
    names = ["f1", "f2"]
    models, log = regress.train_patterns(df, names, rounds=2, tries=2, limits={"r2": 0.5, "accuracy": 50.0})
    assert models.keys() == {"A", "B"}
    status = {(p, k): s for p, k, _, _, s in log}
    assert status == {("C", 0): "small", ("A", 1): "good", ("B", 1): "again", ("B", 2): "weak"}
    again, log = regress.train_patterns(df, names, models, rounds=1, tries=1, limits={"r2": 0.5, "accuracy": 50.0})
    assert again["A"] is models["A"] and again["B"] is not models["B"]
    assert {(p, k, s) for p, k, _, _, s in log} == {("C", 0, "small"), ("A", 0, "kept"), ("B", 0, "refit"), ("B", 1, "weak")}


def test_frames_and_mahalanobis(spark):
    rows = [(1, [[0.0] * 14, [1.0] * 14, [3.0] * 14]), (2, [[0.0] * 14])]
    df = spark.createDataFrame(rows, "recording int, frames array<array<double>>")
    got = voice.frame_statistics(voice.recording_frames(df), ["recording"]).collect()
    assert [r["recording"] for r in got] == [1]
    assert got[0]["mfcc_mean_1"] == 2.0 and got[0]["mfcc_std_14"] == 1.0
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2)) @ np.array([[2.0, 0.5], [0.0, 1.0]])
    pts = spark.createDataFrame([(i, 0, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, cluster int, a double, b double")
    inv = np.linalg.inv(np.cov(x.T))
    want = [float(np.sqrt((v - x.mean(0)) @ inv @ (v - x.mean(0)))) for v in x]
    d = {r["id"]: r["distance"] for r in voice.mahalanobis(pts, ["a", "b"]).collect()}
    assert [d[i] for i in range(80)] == pytest.approx(want)
    flagged = voice.drop_farthest(voice.mahalanobis(pts, ["a", "b"])).filter("outlier").collect()
    assert [r["id"] for r in flagged] == [int(np.argmax(want))]


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "a double")
    x = np.array([1.0, 2.0, 6.0])
    got = [r["features"][0] for r in voice.standardised(df, ["a"]).collect()]
    assert got == pytest.approx(((x - x.mean()) / x.std()).tolist())


def test_stream_of_several_files_equals_the_batch(spark, tmp_path):
    from dripline.operators.grid import slot_sums
    from dripline.sources.tables import usage_events

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = tmp_path / "in"
    ev.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(src))
    out = scratch_path(spark, "out")
    run = streaming.write_updates(
        streaming.slot_stream(streaming.event_stream(spark, str(src), files_per_batch=1), late="40 days"), out, scratch_path(spark, "cp")
    )
    run.awaitTermination()
    got = {tuple(r) for r in streaming.current_slots(spark, out).collect()}
    want = {tuple(r) for r in slot_sums(usage_events(spark, "/root/testdata/sf0.001")).collect()}
    assert got == want and run.lastProgress["batchId"] > 0


def test_shuffled_files_keep_late_events_at_the_default(spark, tmp_path):
    from dripline.operators.grid import slot_sums
    from dripline.sources.tables import usage_events

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = tmp_path / "in"
    ev.orderBy(F.xxhash64("event_id")).coalesce(1).write.option("maxRecordsPerFile", 200).parquet(str(src))
    out, progress = scratch_path(spark, "out"), scratch_path(spark, "cp")
    run = streaming.write_slots(streaming.event_stream(spark, str(src), files_per_batch=1), out, progress)
    run.awaitTermination()
    assert run.lastProgress["batchId"] >= 4
    want = {tuple(r) for r in slot_sums(usage_events(spark, "/root/testdata/sf0.001")).collect()}
    assert {tuple(r) for r in streaming.merged_slots(spark, out).collect()} == want
    assert {tuple(r) for r in streaming.merged_slots(spark, out, late=False).collect()} != want
    assert spark.read.parquet(f"{out}/late").count() > 0
    # A further file goes on where the checkpoint ends; its events are behind all marks.
    ev.limit(50).coalesce(1).write.mode("append").parquet(str(src))
    streaming.write_slots(streaming.event_stream(spark, str(src)), out, progress).awaitTermination()
    total = lambda df, c: df.agg(F.sum(F.col(c).cast("decimal(18,2)"))).first()[0]
    assert total(streaming.merged_slots(spark, out), "amount") == total(ev, "value") + total(ev.limit(50), "value")


def test_stream_scoring(spark, tmp_path):
    df = shapes(spark)
    src = str(tmp_path / "shapes")
    df.write.parquet(src)
    models = classify.train(df, epochs=2)
    limits = classify.thresholds(classify.reconstruction_errors(df, models), 1.5).cache()
    out = scratch_path(spark, "scored")
    stream = spark.readStream.schema(df.schema).parquet(src)
    streaming.score_shapes(stream, models, limits, out, scratch_path(spark, "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == df.count()


def test_partitions_of_a_fit_end_at_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert regress.fit_partitions(spark, 0) == 1
    assert regress.fit_partitions(spark, regress.FIT_ROWS + 1) == 2
    assert regress.fit_partitions(spark, 72_000_000) == regress.FIT_WAVES * cores
