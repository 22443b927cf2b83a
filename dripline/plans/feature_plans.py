"""Named queries over previous-day features, their quality and their diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from dripline.operators import diagnostics, evaluate, features, quality
from dripline.plans import inputs as I
from dripline.plans.catalog import _feature_body, hash01, query, with_ctes
from dripline.session import cut
from dripline.sources import sinks
from dripline.sources.tables import table, usage_events

# Values that come out of a running variance or regression are compared at 6 decimals.
ROUNDED = ["prev_day_std", "avg_change_rate"]
COLUMNS = ["pattern", "person_id", "date", "hour", "minute", "amount", "ratio_before", *features.FEATURES]


def _rounded(df):
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if c in ROUNDED else F.col(c) for c in COLUMNS])


def _feature_sql(source: str) -> str:
    cols = [f"round({c}, 6) + 0.0 AS {c}" if c in ROUNDED else c for c in COLUMNS]
    return f"SELECT {', '.join(cols)} FROM {source}"


@query(
    "output_seq",
    with_ctes(
        """SELECT pattern, person_id, date, slot, CASE WHEN amount > 0 THEN CAST(SUM(CASE WHEN amount > 0 THEN 1 ELSE 0 END)
           OVER (PARTITION BY person_id, date ORDER BY slot) AS INTEGER) ELSE 0 END AS output_seq FROM grid""",
        "grid",
    ),
)
def output_seq(spark, base):
    from dripline.operators.grid import dense_grid

    g = dense_grid(I.slots(spark, base))
    return features.with_sequence(g).select("pattern", "person_id", "date", "slot", "output_seq")


@query(
    "prev_day_stats",
    with_ctes("SELECT pattern, person_id, date, total, mean, round(std, 6) AS std, round(slope, 6) + 0.0 AS slope FROM daily", "daily"),
)
def prev_day_stats(spark, base):
    d = features.day_table(I.slots(spark, base))
    return d.select(
        "pattern", "person_id", "date", "total", "mean", F.round("std", 6).alias("std"), (F.round("slope", 6) + 0.0).alias("slope")
    )


@query("processed_days", with_ctes("SELECT date, COALESCE(CAST(prev_date AS VARCHAR), 'none') AS prev_date FROM proc", "proc"))
def processed_days(spark, base):
    days = features.processed_days(I.slots(spark, base))
    return days.withColumn("prev_date", F.coalesce(F.col("prev_date").cast("string"), F.lit("none")))


@query("processed_days_wrap", with_ctes("SELECT date, COALESCE(prev_date, MAX(date) OVER ()) AS prev_date FROM proc", "proc"))
def processed_days_wrap(spark, base):
    return features.processed_days(I.slots(spark, base), wrap=True)


@query(
    "lag_outputs",
    with_ctes(
        """SELECT pattern, person_id, date, slot, CAST(out1 AS DOUBLE) AS prev_output, CAST(out2 AS DOUBLE) AS prev_prev_output,
           CAST(gap AS DOUBLE) AS time_diff, CAST(before AS DOUBLE) AS prev_sum FROM seqd""",
        "seqd",
    ),
)
def lag_outputs(spark, base):
    """Same-day values of each dispense before the previous-day rule is applied."""
    d = features.day_table(I.slots(spark, base))
    return d.select("pattern", "person_id", "date", F.inline("outs")).select(
        "pattern", "person_id", "date", "slot",
        F.coalesce(F.col("out1").cast("double"), F.lit(0.0)).alias("prev_output"),
        F.coalesce(F.col("out2").cast("double"), F.lit(0.0)).alias("prev_prev_output"),
        F.col("gap").cast("double").alias("time_diff"),
        F.col("before").cast("double").alias("prev_sum"),
    )


@query("features_full", with_ctes(_feature_sql("feats"), "feats"))
def features_full(spark, base):
    return _rounded(I.feature_rows(spark, base))


@query(
    "features_wrap",
    with_ctes(
        _feature_sql(f"({_feature_body('procw')})"),
        "seqd", "daily", "proc",
        extra={"procw": "SELECT date, COALESCE(prev_date, MAX(date) OVER ()) AS prev_date FROM proc"},
    ),
)
def features_wrap(spark, base):
    return _rounded(features.feature_table(I.slots(spark, base), wrap=True))


@query(
    "features_known_persons",
    with_ctes(
        _feature_sql(f"({_feature_body('prock', 'seqk')}) WHERE date >= DATE '2024-01-03'"),
        "seqd", "daily",
        extra={
            "known": """SELECT pattern, person_id FROM (SELECT pattern, person_id, row_number() OVER (PARTITION BY pattern
               ORDER BY person_id) AS r FROM (SELECT DISTINCT pattern, person_id FROM slots WHERE date = DATE '2024-01-02'))
               WHERE r <= 20""",
            "seqk": "SELECT * FROM seqd WHERE date >= DATE '2024-01-02' AND person_id IN (SELECT person_id FROM known)",
            "prock": "SELECT date, LAG(date) OVER (ORDER BY date) AS prev_date FROM (SELECT DISTINCT date FROM seqk)",
        },
    ),
)
def features_known_persons(spark, base):
    """From the third day on, for the first 20 persons of each pattern that were present on the second."""
    return _rounded(features.features_for_known_persons(I.slots(spark, base), "2024-01-03", "2024-01-02", n=20))


@query(
    "first_persons",
    with_ctes(
        """SELECT pattern, person_id FROM (SELECT pattern, person_id, row_number() OVER (PARTITION BY pattern ORDER BY person_id) AS r
           FROM (SELECT DISTINCT pattern, person_id FROM slots)) WHERE r <= 10""",
        "slots",
    ),
)
def first_persons(spark, base):
    return features.first_persons(I.slots(spark, base), 10)


@query(
    "model_input",
    with_ctes(
        """SELECT person_id, date, hour, minute, ratio_before AS ratio_to_prev_day,
           round(sin(2 * pi() * (hour * 60 + minute) / 1440.0), 6) + 0.0 AS time_sin,
           round(cos(2 * pi() * (hour * 60 + minute) / 1440.0), 6) + 0.0 AS time_cos FROM feats""",
        "feats",
    ),
)
def model_input(spark, base):
    df = features.model_input(I.feature_rows(spark, base), leak_free=True)
    return df.select(
        "person_id", "date", "hour", "minute", "ratio_to_prev_day",
        (F.round("time_sin", 6) + 0.0).alias("time_sin"), (F.round("time_cos", 6) + 0.0).alias("time_cos"),
    )


_RANGE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, COUNT(*) FILTER (WHERE {c} < {lo}) AS below, COUNT(*) FILTER (WHERE {c} > {hi}) AS above,
        COUNT(*) FILTER (WHERE {c} IS NULL) AS missing FROM feats"""
    for c, (lo, hi) in quality.RANGES.items()
)


@query("range_violations", with_ctes(_RANGE_SQL, "feats"))
def range_violations(spark, base):
    return quality.range_violations(I.feature_rows(spark, base))


@query(
    "valid_feature_rows",
    with_ctes(
        "SELECT person_id, date, hour, minute, amount FROM feats WHERE "
        + " AND ".join(f"{c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in quality.RANGES.items()),
        "feats",
    ),
)
def valid_feature_rows(spark, base):
    return quality.keep_valid(I.feature_rows(spark, base)).select("person_id", "date", "hour", "minute", "amount")


@query(
    "null_counts",
    """SELECT 'event_id' AS "column", COUNT(*) FILTER (WHERE event_id IS NULL) AS nulls FROM events UNION ALL
       SELECT 'ts', COUNT(*) FILTER (WHERE ts IS NULL) FROM events UNION ALL
       SELECT 'user_id', COUNT(*) FILTER (WHERE user_id IS NULL) FROM events UNION ALL
       SELECT 'value', COUNT(*) FILTER (WHERE value IS NULL) FROM events UNION ALL
       SELECT 'quality', COUNT(*) FILTER (WHERE quality IS NULL) FROM documents LEFT JOIN labels USING (doc_id)""",
)
def null_counts(spark, base):
    ev = quality.null_counts(table(spark, base, "events").select("event_id", "ts", "user_id", "value"))
    docs = table(spark, base, "documents").select("doc_id").join(table(spark, base, "labels"), "doc_id", "left")
    return ev.unionByName(quality.null_counts(docs.select("quality")))


@query("drop_missing", "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def drop_missing(spark, base):
    docs = table(spark, base, "documents").select("doc_id").join(table(spark, base, "labels"), "doc_id", "left")
    return quality.drop_missing(docs.select("doc_id", "quality"))


@query(
    "dedup_events",
    """SELECT person_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS moment, event_id, type FROM (SELECT user_id AS person_id, ts, event_id,
       event_type AS type, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS r
       FROM events) WHERE r = 1""",
)
def dedup_events(spark, base):
    """One event per person and time stamp, the one with the lowest id."""
    ev = usage_events(spark, base).select("person_id", "ts", "event_id", "type")
    first = quality.first_per_moment(ev, ["person_id", "ts"], ["event_id"])
    return first.select("person_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("moment"), "event_id", "type")


@query(
    "min_points",
    """SELECT user_id AS person_id, event_id FROM events WHERE user_id IN
       (SELECT user_id FROM events GROUP BY user_id HAVING COUNT(*) >= 30)""",
)
def min_points(spark, base):
    return quality.with_minimum_rows(usage_events(spark, base), ["person_id"], 30).select("person_id", "event_id")


@query(
    "training_guards",
    with_ctes(
        """SELECT pattern, person_id, n, n >= 10 AS person_ok, SUM(n) OVER (PARTITION BY pattern) >= 100 AS pattern_ok
           FROM (SELECT pattern, person_id, COUNT(*) AS n FROM slots WHERE amount > 0 GROUP BY ALL)""",
        "slots",
    ),
)
def training_guards(spark, base):
    """At least ten rows per person and a hundred per pattern before a model is fitted."""
    n = features.nonzero(I.slots(spark, base)).groupBy("pattern", "person_id").agg(F.count("*").alias("n"))
    per_pattern = n.groupBy("pattern").agg((F.sum("n") >= 100).alias("pattern_ok"))
    return n.join(per_pattern, "pattern").select(
        "pattern", "person_id", "n", (F.col("n") >= 10).alias("person_ok"), "pattern_ok"
    )


_HISTORY = {
    "hist": """SELECT pattern AS scope, date,
        round(CASE WHEN var_pop(actual) > 0 THEN 1 - SUM((actual - base) * (actual - base)) / (var_pop(actual) * COUNT(*)) END, 6) AS r2,
        round(AVG(CASE WHEN abs(actual - base) / actual < 0.1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy
        FROM preds GROUP BY pattern, date"""
}


@query(
    "decline_runs",
    with_ctes(
        """SELECT scope, date, r2, accuracy, CAST(SUM(fell) OVER (PARTITION BY scope, island ORDER BY date) AS BIGINT) AS decline_days,
           SUM(fell) OVER (PARTITION BY scope, island ORDER BY date) >= 14 AS restart
           FROM (SELECT *, SUM(1 - fell) OVER (PARTITION BY scope ORDER BY date) AS island FROM (
             SELECT *, CASE WHEN r2 < COALESCE(LAG(r2) OVER w, 0) AND accuracy < COALESCE(LAG(accuracy) OVER w, 0) THEN 1 ELSE 0 END AS fell
             FROM hist WINDOW w AS (PARTITION BY scope ORDER BY date)))""",
        "preds",
        extra=_HISTORY,
    ),
)
def decline_runs(spark, base):
    return quality.decline_runs(I.daily_scores(spark, base), days=14)


@query(
    "metric_last",
    with_ctes(
        """SELECT scope, date, r2, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY date DESC) AS r FROM hist)
           WHERE r <= 30""",
        "preds",
        extra=_HISTORY,
    ),
)
def metric_last(spark, base):
    return sinks.keep_last(I.daily_scores(spark, base), ["scope"], "date", 30)


@query("metric_lookup", with_ctes("SELECT date, r2, accuracy FROM hist WHERE scope = 'B'", "preds", extra=_HISTORY))
def metric_lookup(spark, base):
    return I.daily_scores(spark, base).filter("scope = 'B'").drop("scope")


@query(
    "base_gates",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT scope, '{m}' AS metric, {m} AS value, CAST({v} AS DOUBLE) AS limit_value, {m} {op} {v} AS passed FROM mm"
            for m, v, op in (("r2", 0.6, ">="), ("accuracy", 60.0, ">="), ("rmse", 30.0, "<"))
        ),
        "preds",
        extra={
            "mm": """SELECT pattern AS scope,
            round(1 - SUM((actual - base) * (actual - base)) / (var_pop(actual) * COUNT(*)), 6) AS r2,
            round(sqrt(AVG((actual - base) * (actual - base))), 6) AS rmse,
            round(AVG(CASE WHEN abs(actual - base) / actual < 0.1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy
            FROM preds GROUP BY pattern"""
        },
    ),
)
def base_gates(spark, base):
    preds = I.predictions(spark, base).select(F.col("pattern").alias("scope"), "actual", F.col("base").alias("pred"))
    m = evaluate.regression_metrics(preds, ["scope"])
    m = m.select("scope", *[F.round(c, 6).alias(c) for c in ("r2", "accuracy", "rmse")])
    return quality.gates(m, quality.BASE_LIMITS, at_most=("rmse",))


_VERSIONS = {
    "vers": """SELECT person_id AS user_id, pattern, CAST(date_diff('day', DATE '2024-01-01', date) // 7 + 1 AS INTEGER) AS version,
        round(COALESCE(CASE WHEN var_pop(actual) > 0 THEN 1 - SUM((actual - base) * (actual - base)) / (var_pop(actual) * COUNT(*)) END, 0), 6) AS r2,
        round(AVG(CASE WHEN abs(actual - base) / actual < 0.1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy,
        MAX(date) AS created_at
        FROM preds GROUP BY 1, 2, 3""",
    "cmp": """SELECT v.*, p.r2 AS prev_r2, p.accuracy AS prev_accuracy,
        COALESCE(p.r2 - v.r2 > 0.02 OR p.accuracy - v.accuracy > 2, false) AS rollback
        FROM vers v LEFT JOIN vers p ON p.user_id = v.user_id AND p.pattern = v.pattern AND p.version = v.version - 1""",
}


@query("version_compare", with_ctes("SELECT user_id, pattern, version, r2, accuracy, prev_r2, prev_accuracy, rollback FROM cmp", "preds", extra=_VERSIONS))
def version_compare(spark, base):
    return quality.compare_versions(I.versions(spark, base)).drop("created_at")


@query(
    "current_versions",
    with_ctes("SELECT user_id, pattern, MAX(version) AS version FROM cmp WHERE NOT rollback GROUP BY ALL", "preds", extra=_VERSIONS),
)
def current_versions(spark, base):
    return quality.current_versions(I.versions(spark, base))


@query("next_version", with_ctes("SELECT user_id, pattern, MAX(version) + 1 AS next_version FROM vers GROUP BY ALL", "preds", extra=_VERSIONS))
def next_version(spark, base):
    return sinks.next_version(I.versions(spark, base))


@query(
    "user_model_map",
    with_ctes(
        """SELECT user_id, pattern, version FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, version DESC) AS r
           FROM vers) WHERE r = 1""",
        "preds",
        extra=_VERSIONS,
    ),
)
def user_model_map(spark, base):
    return quality.user_model_map(I.versions(spark, base))


@query(
    "promotions",
    with_ctes(
        """SELECT scope, version, r2, r2_spread, (lv IS NULL OR r2 - lr >= 0.02) AND r2_spread <= 0.1 AS promote FROM (
           SELECT *, LAG(version) OVER w AS lv, LAG(r2) OVER w AS lr FROM (
             SELECT pattern AS scope, version, round(AVG(r2), 6) AS r2, round(stddev_pop(r2), 6) AS r2_spread FROM vers GROUP BY ALL)
           WINDOW w AS (PARTITION BY scope ORDER BY version))""",
        "preds",
        extra=_VERSIONS,
    ),
)
def promotions(spark, base):
    per = I.versions(spark, base).groupBy(F.col("pattern").alias("scope"), "version").agg(
        F.round(F.avg("r2"), 6).alias("r2"), F.round(F.stddev_pop("r2"), 6).alias("r2_spread")
    )
    return quality.promotions(per)


@query(
    "shape_drift",
    with_ctes(
        """SELECT pattern, period, round(change, 6) AS change, change > 0.10 AS unstable, change > 0.15 AS retrain FROM (
           SELECT b.pattern, b.period + 1 AS period, SUM(abs(COALESCE(n.amount, 0) - COALESCE(b.amount, 0))) / SUM(b.amount) AS change
           FROM full48 b JOIN full48 n ON n.pattern = b.pattern AND n.period = b.period + 1 AND n.slot = b.slot
           GROUP BY b.pattern, b.period)""",
        "slots", "s48",
        extra={
            "wk": """SELECT pattern, CAST(date_diff('day', DATE '2024-01-01', date) // 7 AS INTEGER) AS period, slot,
                CAST(SUM(amount) AS DOUBLE) AS amount FROM slots GROUP BY ALL""",
            "full48": """SELECT k.pattern, k.period, s48.slot, COALESCE(w.amount, 0.0) AS amount FROM (SELECT DISTINCT pattern, period FROM wk) k
                CROSS JOIN s48 LEFT JOIN wk w ON w.pattern = k.pattern AND w.period = k.period AND w.slot = s48.slot""",
        },
    ),
)
def shape_drift(spark, base):
    """Change of each pattern's weekly shape against the week before."""
    period = F.floor(F.datediff("date", F.lit("2024-01-01").cast("date")) / 7).cast("int")
    weekly = I.slots(spark, base).groupBy("pattern", period.alias("period"), "slot").agg(F.sum("amount").cast("double").alias("amount"))
    return quality.shape_drift(weekly, ["pattern"]).withColumn("change", F.round("change", 6))


_CORR = features.FEATURES


@query(
    "corr_matrix",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM feats"
            for i, a in enumerate(_CORR)
            for b in _CORR[i + 1 :]
        ),
        "feats",
    ),
)
def corr_matrix(spark, base):
    pairs = diagnostics.correlation_pairs(I.feature_rows(spark, base), _CORR)
    return pairs.withColumn("r", F.round("r", 6) + 0.0)


@query(
    "strong_pairs",
    with_ctes(
        "SELECT a, b FROM ("
        + " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM feats" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]
        )
        + ") WHERE abs(r) > 0.7",
        "feats",
    ),
)
def strong_pairs(spark, base):
    return diagnostics.strong_pairs(diagnostics.correlation_pairs(I.feature_rows(spark, base), _CORR)).select("a", "b")


@query(
    "corr_with_target",
    with_ctes(
        "SELECT feature, r, CAST(row_number() OVER (ORDER BY r DESC, feature) AS INTEGER) AS rank FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, amount), 6) + 0.0 AS r FROM feats" for c in features.FEATURES)
        + ")",
        "feats",
    ),
)
def corr_with_target(spark, base):
    return diagnostics.correlation_with_target(I.feature_rows(spark, base), features.FEATURES, "amount")


@query("vif")
def vif(spark, base):
    return diagnostics.vif_by_scope(features.model_input(I.feature_rows(spark, base)), features.MODEL_FEATURES, "pattern")


@query("pca_high_vif")
def pca_high_vif(spark, base):
    df = cut(features.model_input(I.feature_rows(spark, base)))
    return diagnostics.replace_by_components(df, diagnostics.high_vif(df, features.MODEL_FEATURES))


@query("pca2d")
def pca2d(spark, base):
    from dripline.functions import arrays as A
    from dripline.operators.grid import DAY, sparse_day_vectors

    v = sparse_day_vectors(I.slots(spark, base)).withColumn("vec", A.minmax(F.col("vec")))
    return diagnostics.project_2d(v, DAY)
