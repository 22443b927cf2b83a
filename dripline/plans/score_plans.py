"""Named queries over predictions: metrics, fences, splits, samples, ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from dripline.functions import scalars as S
from dripline.operators import eda, evaluate, features
from dripline.plans import inputs as I
from dripline.plans.catalog import hash01, query, with_ctes
from dripline.sources.tables import usage_events

KEYS = ["pattern", "person_id", "date", "slot"]

_R2 = "CASE WHEN var_pop(actual) > 0 THEN 1 - SUM((actual - {p}) * (actual - {p})) / (var_pop(actual) * COUNT(*)) END"
_ACC = "COALESCE(AVG(CASE WHEN actual <> 0 THEN CASE WHEN abs(actual - {p}) / actual < 0.1 THEN 1.0 ELSE 0.0 END END) * 100, 0)"
_RMSE = "sqrt(AVG((actual - {p}) * (actual - {p})))"


def _six(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query(
    "regression_metrics",
    with_ctes(
        f"""SELECT pattern, round({_R2.format(p='base')}, 6) AS r2, round({_RMSE.format(p='base')}, 6) AS rmse,
            round(AVG((actual - base) * (actual - base)), 4) AS mse, round({_ACC.format(p='base')}, 6) AS accuracy
            FROM preds GROUP BY pattern""",
        "preds",
    ),
)
def regression_metrics(spark, base):
    p = I.predictions(spark, base).withColumn("pred", F.col("base"))
    m = _six(evaluate.regression_metrics(p, ["pattern"]), "r2", "rmse", "accuracy")
    return m.withColumn("mse", F.round("mse", 4))


@query(
    "percent_errors",
    with_ctes(
        """SELECT pattern, person_id, date, slot, round((actual - personal) / actual * 100, 6) AS pct,
           round(abs((actual - personal) / actual * 100), 6) AS abs_pct FROM preds""",
        "preds",
    ),
)
def percent_errors(spark, base):
    pct = S.percent_error(F.col("actual"), F.col("personal"))
    return I.predictions(spark, base).select(*KEYS, F.round(pct, 6).alias("pct"), F.round(F.abs(pct), 6).alias("abs_pct"))


@query(
    "error_counts",
    with_ctes(
        """SELECT COALESCE(pattern, 'all') AS pattern, COUNT(*) FILTER (WHERE abs((actual - personal) / actual * 100) >= 10) AS high,
           COUNT(*) FILTER (WHERE abs((actual - personal) / actual * 100) < 10) AS low FROM preds GROUP BY ROLLUP (pattern)""",
        "preds",
    ),
)
def error_counts(spark, base):
    return evaluate.error_counts(I.predictions(spark, base).withColumn("pred", F.col("personal")))


_ERR = {"err": "SELECT *, round(abs(actual - base), 4) AS e FROM preds"}


@query(
    "error_histogram",
    with_ctes(
        """SELECT bin, COUNT(*) AS n FROM (SELECT CAST(least(floor((e - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin
           FROM (SELECT e, MIN(e) OVER () AS lo, MAX(e) OVER () AS hi FROM err)) GROUP BY bin""",
        "preds",
        extra=_ERR,
    ),
)
def error_histogram(spark, base):
    return eda.histogram(_errors(spark, base), "e", 30)


def _errors(spark, base):
    return I.predictions(spark, base).withColumn("e", F.round(F.abs(F.col("actual") - F.col("base")), 4))


@query(
    "error_box",
    with_ctes(
        """SELECT pattern, round(MIN(e), 6) AS low, round(quantile_cont(e, 0.25), 6) AS q1, round(quantile_cont(e, 0.5), 6) AS median,
           round(quantile_cont(e, 0.75), 6) AS q3, round(MAX(e), 6) AS high FROM err GROUP BY pattern""",
        "preds",
        extra=_ERR,
    ),
)
def error_box(spark, base):
    return _six(evaluate.box_summary(_errors(spark, base), "e", "pattern"), "low", "q1", "median", "q3", "high")


@query(
    "quartiles",
    with_ctes(
        """SELECT pattern, round(quantile_cont(e, 0.25), 6) AS q1, round(quantile_cont(e, 0.75), 6) AS q3 FROM err GROUP BY pattern""",
        "preds",
        extra=_ERR,
    ),
)
def quartiles(spark, base):
    return _six(evaluate.quartiles(_errors(spark, base), "e", ["pattern"]), "q1", "q3")


@query(
    "iqr_fence",
    with_ctes(
        """SELECT pattern, person_id, date, slot, round(f.fence, 6) AS fence, e > f.fence AS outlier FROM err JOIN (
           SELECT pattern, quantile_cont(e, 0.75) + 0.5 * (quantile_cont(e, 0.75) - quantile_cont(e, 0.25)) AS fence
           FROM err GROUP BY pattern) f USING (pattern)""",
        "preds",
        extra=_ERR,
    ),
)
def iqr_fence(spark, base):
    return _six(evaluate.flag_outliers(_errors(spark, base), "e", ["pattern"]).select(*KEYS, "fence", "outlier"), "fence")


@query("date_split", with_ctes("SELECT person_id, date, split FROM splits", "splits"))
def date_split(spark, base):
    return I.split_predictions(spark, base).select("person_id", "date", "split").distinct()


@query(
    "folds",
    with_ctes(
        f"SELECT person_id, date, slot, CAST(floor({hash01('person_id', 'date', 'slot')} * 5) AS INTEGER) AS fold FROM preds", "preds"
    ),
)
def folds(spark, base):
    f = evaluate.with_folds(I.predictions(spark, base), ["person_id", "date", "slot"])
    return f.select("person_id", "date", "slot", "fold")


@query(
    "fold_means",
    with_ctes(
        f"""SELECT pattern AS scope, round(AVG(r2), 6) AS r2, round(AVG(rmse), 6) AS rmse, round(AVG(accuracy), 6) AS accuracy,
            round(stddev_pop(r2), 6) AS r2_spread FROM (
            SELECT pattern, fold, {_R2.format(p='base')} AS r2, {_RMSE.format(p='base')} AS rmse, {_ACC.format(p='base')} AS accuracy
            FROM (SELECT *, floor({hash01('person_id', 'date', 'slot')} * 5) AS fold FROM preds) GROUP BY pattern, fold) GROUP BY pattern""",
        "preds",
    ),
)
def fold_means(spark, base):
    f = evaluate.with_folds(I.predictions(spark, base), ["person_id", "date", "slot"])
    f = f.withColumn("scope", F.col("pattern")).withColumn("pred", F.col("base"))
    return _six(evaluate.fold_means(evaluate.regression_metrics(f, ["scope", "fold"])), "r2", "rmse", "accuracy", "r2_spread")


@query(
    "sample_persons",
    with_ctes(
        f"""SELECT DISTINCT pattern, person_id FROM (SELECT pattern, person_id, row_number() OVER (PARTITION BY pattern
            ORDER BY {hash01('person_id')}, person_id) AS r FROM (SELECT DISTINCT pattern, person_id FROM slots)) WHERE r <= 20""",
        "slots",
    ),
)
def sample_persons(spark, base):
    return evaluate.sample_persons(I.slots(spark, base), 20).select("pattern", "person_id").distinct()


@query(
    "weighted_training_rows",
    with_ctes(
        """SELECT learner, person_id, date, hour, minute, 1.0::DOUBLE AS weight FROM (SELECT *, person_id AS learner FROM drawn)
           UNION ALL SELECT t.learner, d.person_id, d.date, d.hour, d.minute, 0.2::DOUBLE FROM drawn d JOIN takers t
           ON t.pattern = d.pattern AND t.draw = d.draw AND t.learner <> d.person_id""",
        "slots",
        extra={
            "drawn": f"""SELECT *, floor({hash01('pattern', 'person_id', 'date', 'hour', 'minute')} * 5) AS draw FROM (
                SELECT pattern, person_id, date, CAST(slot // 2 AS INTEGER) AS hour, CAST((slot % 2) * 30 AS INTEGER) AS minute FROM slots WHERE amount > 0)""",
            "takers": f"""SELECT pattern, person_id AS learner, floor({hash01('pattern', 'person_id')} * 5) AS draw
                FROM (SELECT DISTINCT pattern, person_id FROM drawn)""",
        },
    ),
)
def weighted_training_rows(spark, base):
    """Training rows of every person: own ones, and a fifth of the pattern's others at a fifth of the weight."""
    rows = features.nonzero(I.slots(spark, base)).select(
        "pattern", "person_id", "date", S.slot_hour(F.col("slot")).alias("hour"), S.slot_minute(F.col("slot")).alias("minute")
    )
    return evaluate.weighted_training_rows(rows).drop("pattern")


@query(
    "prediction_sample",
    with_ctes(
        f"""SELECT person_id, date, slot, actual FROM preds ORDER BY {hash01('person_id', 'date', 'slot')}, person_id, date, slot LIMIT 100""",
        "preds",
    ),
)
def prediction_sample(spark, base):
    out = evaluate.prediction_sample(I.predictions(spark, base), ["person_id", "date", "slot"])
    return out.select("person_id", "date", "slot", "actual")


_VALID = {
    "vp": "SELECT p.*, s.split FROM preds p JOIN splits s ON s.person_id = p.person_id AND s.date = p.date",
    "agrid": f"""SELECT pattern, person_id, alpha, CASE WHEN var_pop(actual) > 0 THEN 1 - SUM((actual - alpha * base - (1 - alpha) * personal) ** 2)
        / (var_pop(actual) * COUNT(*)) END AS r2 FROM vp CROSS JOIN (SELECT CAST(range / 10.0 AS DOUBLE) AS alpha FROM range(1, 10))
        WHERE split = 'valid' GROUP BY ALL""",
    "best": """SELECT pattern, person_id, alpha, r2 FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY r2 DESC, alpha) AS r
        FROM agrid WHERE r2 IS NOT NULL) WHERE r = 1""",
    "sc": "SELECT v.pattern, v.person_id, v.split, b.alpha, "
    + ", ".join(
        f"{_R2.format(p=e)} AS {n}_r2, {_RMSE.format(p=e)} AS {n}_rmse, {_ACC.format(p=e)} AS {n}_acc"
        for n, e in (("base", "base"), ("personal", "personal"), ("ensemble", "(b.alpha * base + (1 - b.alpha) * personal)"))
    )
    + " FROM vp v JOIN best b ON b.person_id = v.person_id WHERE split IN ('valid', 'holdout') GROUP BY ALL",
}


def _scores(spark, base):
    split = I.split_predictions(spark, base)
    valid = split.filter("split = 'valid'")
    by = ["pattern", "person_id"]
    best = evaluate.best_alpha(evaluate.ensemble_grid(valid, by), by)
    return evaluate.ensemble_scores(split.filter("split in ('valid', 'holdout')"), best, by)


@query("ensemble_grid", with_ctes("SELECT pattern, person_id, alpha, round(r2, 6) + 0.0 AS r2 FROM agrid", "preds", "splits", extra=_VALID))
def ensemble_grid(spark, base):
    valid = I.split_predictions(spark, base).filter("split = 'valid'")
    g = evaluate.ensemble_grid(valid, ["pattern", "person_id"])
    return g.withColumn("r2", F.round("r2", 6) + 0.0)


@query(
    "ensemble_grid_fine",
    with_ctes(
        """SELECT pattern, alpha, round(r2, 6) + 0.0 AS r2 FROM (SELECT pattern, alpha,
           1 - SUM((actual - alpha * base - (1 - alpha) * personal) ** 2) / (var_pop(actual) * COUNT(*)) AS r2
           FROM preds CROSS JOIN (SELECT CAST(range / 100.0 AS DOUBLE) AS alpha FROM range(101)) GROUP BY ALL)""",
        "preds",
    ),
)
def ensemble_grid_fine(spark, base):
    g = evaluate.ensemble_grid(I.predictions(spark, base), ["pattern"], evaluate.FINE_ALPHAS)
    return g.withColumn("r2", F.round("r2", 6) + 0.0)


@query("ensemble_best", with_ctes("SELECT pattern, person_id, alpha, round(r2, 6) + 0.0 AS r2 FROM best", "preds", "splits", extra=_VALID))
def ensemble_best(spark, base):
    by = ["pattern", "person_id"]
    valid = I.split_predictions(spark, base).filter("split = 'valid'")
    best = evaluate.best_alpha(evaluate.ensemble_grid(valid, by), by)
    return best.withColumn("r2", F.round("r2", 6) + 0.0)


@query(
    "ensemble_adopt",
    with_ctes(
        """SELECT pattern, person_id, u AS use_ensemble, CASE WHEN u THEN alpha ELSE 0.0 END AS alpha FROM (SELECT *,
           COALESCE(ensemble_r2 - personal_r2 >= 0.05, false) OR COALESCE(ensemble_acc - personal_acc >= 5, false) AS u
           FROM sc WHERE split = 'valid')""",
        "preds", "splits", extra=_VALID,
    ),
)
def ensemble_adopt(spark, base):
    valid = _scores(spark, base).filter("split = 'valid'")
    return evaluate.adopt_ensemble(valid).select("pattern", "person_id", "use_ensemble", "alpha")


_METRICS = [f"{m}_{k}" for m in ("base", "personal", "ensemble") for k in ("r2", "rmse", "acc")]
_SUMMARY = (
    "SELECT pattern, person_id, "
    + ", ".join(f"MAX(CASE WHEN split = '{s}' THEN {m} END) AS {s}_{m}" for s in ("valid", "holdout") for m in _METRICS)
    + " FROM sc GROUP BY pattern, person_id"
)
_WIDE = [f"{s}_{m}" for s in ("valid", "holdout") for m in _METRICS]


@query(
    "ensemble_summary",
    with_ctes(
        f"SELECT pattern, person_id, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _WIDE)} FROM ({_SUMMARY})",
        "preds", "splits", extra=_VALID,
    ),
)
def ensemble_summary(spark, base):
    s = evaluate.summary_table(_scores(spark, base), ["pattern", "person_id"])
    return s.select("pattern", "person_id", *[(F.round(c, 6) + 0.0).alias(c) for c in _WIDE])


@query(
    "pattern_means",
    with_ctes(
        f"SELECT pattern, {', '.join(f'round(AVG({c}), 5) + 0.0 AS {c}' for c in _WIDE)} FROM ({_SUMMARY}) GROUP BY pattern",
        "preds", "splits", extra=_VALID,
    ),
)
def pattern_means(spark, base):
    m = evaluate.pattern_means(evaluate.summary_table(_scores(spark, base), ["pattern", "person_id"]))
    return m.select("pattern", *[(F.round(c, 5) + 0.0).alias(c) for c in _WIDE])


@query(
    "top_hours",
    with_ctes(
        """SELECT pattern, hour, usage, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY pattern ORDER BY usage DESC, hour) AS INTEGER) AS rank
           FROM (SELECT pattern, CAST(slot // 2 AS INTEGER) AS hour, CAST(SUM(amount) AS DOUBLE) AS usage FROM slots GROUP BY ALL)) WHERE rank <= 5""",
        "slots",
    ),
)
def top_hours(spark, base):
    return evaluate.top_k(eda.hourly_totals(I.slots(spark, base)), ["pattern"], "usage", "hour", 5)
