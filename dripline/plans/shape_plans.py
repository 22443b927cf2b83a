"""Named queries over day shapes: clusters, silhouettes, representatives, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dripline.functions import arrays as A
from dripline.operators import classify, grid, quality, shape
from dripline.plans import inputs as I
from dripline.plans.catalog import query, with_ctes
from dripline.session import cut
from dripline.sources.tables import PATTERNS, table

DEFAULTS = {p: (shape.EPS, shape.MIN_SAMPLES) for p in PATTERNS}


def _days(spark, base) -> DataFrame:
    return grid.sparse_day_vectors(I.slots(spark, base))


def _labelled(spark, base) -> DataFrame:
    vectors = cut(shape.distinct_vectors(shape.normalised(_days(spark, base))))
    return cut(shape.dbscan(vectors, DEFAULTS))


def _flagged(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    samples = shape.silhouette_samples(labelled)
    centres = shape.medoids(labelled, shape.best_cluster(shape.silhouette_by_cluster(samples)))
    return centres, shape.warping_outliers(labelled, cut(centres))


# Clusters in SQL: all pairs within eps, core rows, smallest reachable core row per component.
_DENSE = {
    "nv": """SELECT pattern, person_id, date, person_id * 65536 + date_diff('day', DATE '1970-01-01', date) AS k,
        list(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0.0 END ORDER BY slot) AS v FROM vecs GROUP BY pattern, person_id, date""",
    "dv": "SELECT pattern, v, COUNT(*) AS w, MIN(k) AS k FROM nv GROUP BY pattern, v",
    "near": """SELECT a.pattern, a.k AS a, b.k AS b, b.w FROM dv a JOIN dv b ON a.pattern = b.pattern
        AND list_distance(a.v, b.v) <= 0.9""",
    "core": "SELECT pattern, a AS k FROM near GROUP BY pattern, a HAVING SUM(w) >= 3",
    "edges": """SELECT n.pattern, n.a, n.b FROM near n JOIN core x ON x.pattern = n.pattern AND x.k = n.a
        JOIN core y ON y.pattern = n.pattern AND y.k = n.b""",
    "rooted": """SELECT * FROM (WITH RECURSIVE cc(pattern, k, root) USING KEY (pattern, k) AS (
        SELECT pattern, k, k FROM core UNION
        SELECT e.pattern, e.a, MIN(cc.root) FROM cc JOIN edges e ON e.pattern = cc.pattern AND e.b = cc.k
        JOIN recurring.cc r ON r.pattern = e.pattern AND r.k = e.a WHERE cc.root < r.root GROUP BY e.pattern, e.a) SELECT * FROM cc)""",
    "numbered": """SELECT pattern, root, CAST(row_number() OVER (PARTITION BY pattern ORDER BY root) - 1 AS INTEGER) AS label
        FROM (SELECT DISTINCT pattern, root FROM rooted)""",
    "member": """SELECT d.pattern, d.v, d.w, d.k, COALESCE(n.label, -1) AS label FROM dv d LEFT JOIN (
        SELECT pattern, k, MIN(root) AS root FROM (SELECT * FROM rooted UNION ALL
          SELECT q.pattern, q.a, r.root FROM near q JOIN rooted r ON r.pattern = q.pattern AND r.k = q.b
          WHERE (q.pattern, q.a) NOT IN (SELECT (pattern, k) FROM core)) GROUP BY pattern, k) m ON m.pattern = d.pattern AND m.k = d.k
        LEFT JOIN numbered n ON n.pattern = m.pattern AND n.root = m.root""",
    "size": "SELECT pattern, label, CAST(SUM(w) AS BIGINT) AS n FROM member GROUP BY pattern, label",
    "mean_d": """SELECT a.pattern, a.k, a.w, a.label, b.label AS other, SUM(list_distance(a.v, b.v) * b.w) AS s
        FROM member a JOIN member b ON a.pattern = b.pattern WHERE a.label >= 0 AND b.label >= 0 GROUP BY ALL""",
    "ab": """SELECT m.pattern, m.k, m.w, m.label, MAX(CASE WHEN m.label = other AND z.n > 1 THEN s / (z.n - 1) END) AS a,
        MIN(CASE WHEN m.label <> other THEN s / z.n END) AS b FROM mean_d m JOIN size z ON z.pattern = m.pattern AND z.label = m.other
        GROUP BY m.pattern, m.k, m.w, m.label""",
    "sil": "SELECT *, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM ab",
    "cov": """SELECT pattern, CAST(SUM(CASE WHEN label >= 0 THEN w ELSE 0 END) AS BIGINT) AS clustered,
        SUM(CASE WHEN label >= 0 THEN w ELSE 0 END) / SUM(w) AS coverage FROM member GROUP BY pattern""",
}




def _dtw_sql(a: str, b: str) -> str:
    """Warping distance of two 48-lists: one list per row of the cost table."""
    return f"""sqrt(list_reduce({a}, lambda prev, x: list_reduce(range(1, 49), lambda acc, j: list_append(acc,
        least(acc[len(acc)], prev[j], prev[j + 1]) + (x - {b}[j]) * (x - {b}[j])), [1e300]::DOUBLE[]),
        list_concat([0.0]::DOUBLE[], list_transform(range(48), lambda z: 1e300::DOUBLE)))[49])"""


_WARPED = {
    **_DENSE,
    "ranked": """SELECT pattern, label, row_number() OVER (PARTITION BY pattern ORDER BY round(SUM(s * w) / SUM(w), 6) DESC, label) AS r
        FROM sil GROUP BY pattern, label""",
    "crowd": "SELECT m.* FROM member m JOIN ranked r ON r.pattern = m.pattern AND r.label = m.label AND r.r = 1",
    "medo": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY mean_dtw, k) AS r FROM (
        SELECT a.pattern, a.k, a.v, round(SUM({_dtw_sql('a.v', 'b.v')} * b.w) / SUM(b.w), 9) AS mean_dtw
        FROM crowd a JOIN crowd b ON b.pattern = a.pattern GROUP BY a.pattern, a.k, a.v)) WHERE r = 1""",
    "cum": """SELECT pattern, v, w, k, label, CASE WHEN c[48] > c[1] THEN list_transform(c, lambda x: (x - c[1]) / (c[48] - c[1]))
        ELSE list_transform(c, lambda x: 0.0::DOUBLE) END AS c FROM (SELECT *, list_transform(range(1, 49), lambda i: list_sum(v[1:i])) AS c FROM member)""",
    "dd": f"""SELECT u.pattern, u.k, u.w, u.v, u.label, {_dtw_sql('u.v', 'm.v')} AS dtw_plain, {_dtw_sql('u.c', 'mc.c')} AS dtw_cum
        FROM cum u JOIN medo m ON m.pattern = u.pattern JOIN cum mc ON mc.pattern = m.pattern AND mc.k = m.k""",
    "fenced": """SELECT pattern, q3 + 0.5 * (q3 - q1) AS fence FROM (SELECT n.pattern, quantile_cont(dtw_cum, 0.25) AS q1,
        quantile_cont(dtw_cum, 0.75) AS q3 FROM nv n JOIN dd ON dd.pattern = n.pattern AND dd.v = n.v GROUP BY n.pattern)""",
    "flags": "SELECT dd.*, f.fence, dtw_cum > f.fence AS outlier FROM dd JOIN fenced f ON f.pattern = dd.pattern",
}


@query(
    "dbscan_labels",
    with_ctes(
        "SELECT n.pattern, n.person_id, n.date, m.label FROM nv n JOIN member m ON m.pattern = n.pattern AND m.v = n.v", "vecs", extra=_DENSE
    ),
)
def dbscan_labels(spark, base):
    days = shape.normalised(_days(spark, base))
    return shape.label_days(days, _labelled(spark, base)).select(*grid.DAY, "label")


@query("cluster_counts", with_ctes("SELECT pattern, label, n FROM size", "vecs", extra=_DENSE))
def cluster_counts(spark, base):
    return shape.cluster_counts(_labelled(spark, base))


@query(
    "cluster_coverage",
    with_ctes("SELECT *, coverage >= 0.95 AS covered FROM cov", "vecs", extra=_DENSE),
)
def cluster_coverage(spark, base):
    return shape.coverage(_labelled(spark, base))


@query(
    "silhouette",
    with_ctes(
        """SELECT *, CAST(row_number() OVER (PARTITION BY pattern ORDER BY silhouette DESC, label) AS INTEGER) AS rank FROM (
           SELECT pattern, label, round(SUM(s * w) / SUM(w), 6) AS silhouette, CAST(SUM(w) AS BIGINT) AS n FROM sil GROUP BY pattern, label)""",
        "vecs", extra=_DENSE,
    ),
)
def silhouette(spark, base):
    samples = shape.silhouette_samples(_labelled(spark, base))
    return shape.silhouette_by_cluster(samples).withColumn("silhouette", F.round("silhouette", 6))


@query(
    "cluster_gate",
    with_ctes(
        """SELECT *, coverage >= 0.95 AS covered, silhouette >= 0.6 AS silhouette_ok,
           coverage >= 0.95 AS covered_ok, clustered >= 500 AS many_rows, silhouette >= 0.6 AND coverage >= 0.95 AS passed
           FROM (SELECT c.*, s.silhouette FROM cov c LEFT JOIN (SELECT pattern, round(SUM(s * w) / SUM(w), 6) AS silhouette
                 FROM sil GROUP BY pattern) s ON s.pattern = c.pattern)""",
        "vecs", extra=_DENSE,
    ),
)
def cluster_gate(spark, base):
    labelled = _labelled(spark, base)
    overall = shape.silhouette_overall(shape.silhouette_samples(labelled)).withColumn("silhouette", F.round("silhouette", 6))
    return quality.cluster_gate(shape.coverage(labelled).join(overall, "pattern", "left"))


@query(
    "cluster_gate_interval",
    with_ctes(
        """SELECT c.pattern, CAST(c.clustered AS BIGINT) AS clustered, c.coverage, COALESCE(s.silhouette >= 0.6 AND c.coverage >= 0.95, false) AS passed FROM cov c
           LEFT JOIN (SELECT pattern, round(SUM(s * w) / SUM(w), 6) AS silhouette FROM sil GROUP BY pattern) s ON s.pattern = c.pattern""",
        "vecs", extra=_DENSE,
    ),
)
def cluster_gate_interval(spark, base):
    """The verdict of the cluster gate from bounds; cells get finer only while it is open."""
    return shape.gate_by_interval(_labelled(spark, base)).drop("low", "high")


@query("cluster_sweep")
def cluster_sweep(spark, base):
    """Log of the parameter search, one row per pattern and try."""
    vectors = shape.distinct_vectors(shape.normalised(_days(spark, base)))
    _, log = shape.sweep(vectors)
    return spark.createDataFrame(log, shape.SWEEP_SCHEMA)


@query(
    "dtw_medoid",
    with_ctes(
        """SELECT pattern, k AS row_key, round(mean_dtw, 6) AS mean_dtw, CAST(i - 1 AS INTEGER) AS slot, x AS amount FROM (
           SELECT pattern, k, mean_dtw, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM medo)""",
        "vecs", extra=_WARPED,
    ),
)
def dtw_medoid(spark, base):
    labelled = _labelled(spark, base)
    best = shape.best_cluster(shape.silhouette_by_cluster(shape.silhouette_samples(labelled)))
    centres = shape.medoids(labelled, best).withColumn("mean_dtw", F.round("mean_dtw", 6))
    return grid.explode_vector(centres, ["pattern", "row_key", "mean_dtw"])


@query(
    "dtw_outliers",
    with_ctes(
        """SELECT pattern, k AS row_key, w AS weight, round(dtw_plain, 6) AS dtw_plain, round(dtw_cum, 6) AS dtw_cum,
           round(fence, 6) AS fence, outlier FROM flags""",
        "vecs", extra=_WARPED,
    ),
)
def dtw_outliers(spark, base):
    _, flagged = _flagged(_labelled(spark, base))
    return flagged.select(
        "pattern", "row_key", "weight", *[F.round(c, 6).alias(c) for c in ("dtw_plain", "dtw_cum", "fence")], "outlier"
    )


@query(
    "outlier_free_grid",
    with_ctes(
        """SELECT x.pattern, x.person_id, x.date, CAST(x.slot // 2 AS INTEGER) AS hour, CAST((x.slot % 2) * 30 AS INTEGER) AS minute, x.x AS amount
           FROM vecs x JOIN nv n ON n.person_id = x.person_id AND n.date = x.date
           JOIN flags f ON f.pattern = n.pattern AND f.v = n.v WHERE NOT f.outlier""",
        "vecs", extra=_WARPED,
    ),
)
def outlier_free_grid(spark, base):
    """Original amounts of the days that stay after the warping fence."""
    days = _days(spark, base)
    _, flagged = _flagged(_labelled(spark, base))
    return grid.grid_from_vectors(shape.keep_inliers(days, flagged))


@query(
    "cluster_compactness",
    with_ctes(
        """SELECT g.pattern, g.label, g.n, round(g.mean_dtw, 6) AS mean_dtw, round(g.outlier_share, 6) AS outlier_share,
           g.mean_dtw <= 0.5 * o.overall AS compact_ok, g.outlier_share <= 0.2 AS outliers_ok, g.n >= 100 AS size_ok FROM (
           SELECT pattern, label, CAST(SUM(w) AS BIGINT) AS n, SUM(dtw_cum * w) / SUM(w) AS mean_dtw,
                  SUM(CASE WHEN outlier THEN w ELSE 0 END) / SUM(w) AS outlier_share FROM flags WHERE label >= 0 GROUP BY pattern, label) g
           JOIN (SELECT pattern, SUM(dtw_cum * w) / SUM(w) AS overall FROM flags GROUP BY pattern) o ON o.pattern = g.pattern""",
        "vecs", extra=_WARPED,
    ),
)
def cluster_compactness(spark, base):
    labelled = _labelled(spark, base)
    _, flagged = _flagged(labelled)
    out = shape.compactness(labelled, flagged)
    return out.withColumn("mean_dtw", F.round("mean_dtw", 6)).withColumn("outlier_share", F.round("outlier_share", 6))


_CENTROID = {
    "cent": "SELECT pattern AS model, slot, AVG(x) AS m FROM shapes GROUP BY pattern, slot",
    "errs": """SELECT s.pattern, s.person_id, s.block, c.model, round(SUM((s.x - c.m) * (s.x - c.m)) / 48, 9) AS mse
        FROM shapes s JOIN cent c ON c.slot = s.slot GROUP BY ALL""",
    "own": """SELECT model, AVG(mse) AS mu, stddev_pop(mse) AS sd FROM errs WHERE pattern = model GROUP BY model""",
    "bestp": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, block ORDER BY mse, model) AS r FROM errs) WHERE r = 1""",
    "pred": """SELECT b.pattern, b.person_id, b.block, b.mse, CASE WHEN b.mse > o.mu + 1.5 * o.sd THEN 'Unknown' ELSE b.model END AS predicted
        FROM bestp b JOIN own o ON o.model = b.model""",
}


def _errors(spark, base) -> DataFrame:
    """Error of every five-day shape under each pattern's mean shape."""
    shapes = cut(I.shapes(spark, base))
    return classify.centroid_errors(shapes)


@query(
    "error_thresholds",
    with_ctes("SELECT model, round(mu + 1.5 * sd, 6) AS threshold FROM own", "shapes", extra=_CENTROID),
)
def error_thresholds(spark, base):
    t = classify.thresholds(_errors(spark, base), 1.5)
    return t.select("model", F.round("threshold", 6).alias("threshold"))


@query(
    "centroid_classes",
    with_ctes(
        """SELECT pattern, person_id, block, predicted, round(1 - least(1, mse), 6) AS confidence FROM pred""",
        "shapes", extra=_CENTROID,
    ),
)
def centroid_classes(spark, base):
    errors = cut(_errors(spark, base))
    out = classify.predict(errors, classify.thresholds(errors, 1.5))
    return out.select("pattern", "person_id", "block", "predicted", F.round(A.confidence(F.col("mse")), 6).alias("confidence"))


@query(
    "pattern_accuracy",
    with_ctes(
        """SELECT pattern, AVG(CASE WHEN predicted = pattern THEN 1.0 ELSE 0.0 END) AS accuracy,
           AVG(CASE WHEN predicted = 'Unknown' THEN 1.0 ELSE 0.0 END) AS unknown FROM pred GROUP BY pattern""",
        "shapes", extra=_CENTROID,
    ),
)
def pattern_accuracy(spark, base):
    errors = cut(_errors(spark, base))
    return classify.pattern_accuracy(classify.predict(errors, classify.thresholds(errors, 1.5)))


@query(
    "confusion_matrix",
    with_ctes(
        "SELECT pattern, "
        + ", ".join(f"COUNT(*) FILTER (WHERE predicted = '{p}') AS {p}" for p in PATTERNS)
        + " FROM pred WHERE predicted <> 'Unknown' GROUP BY pattern",
        "shapes", extra=_CENTROID,
    ),
)
def confusion_matrix(spark, base):
    errors = cut(_errors(spark, base))
    return classify.confusion(classify.predict(errors, classify.thresholds(errors, 1.5)), PATTERNS)


@query(
    "threshold_grid",
    with_ctes(
        """SELECT k.k, AVG(CASE WHEN b.mse > o.mu + k.k * o.sd THEN 1.0 ELSE 0.0 END) AS unknown,
           AVG(CASE WHEN b.mse > o.mu + k.k * o.sd THEN 1.0 ELSE 0.0 END) <= 0.05 AS passed
           FROM bestp b JOIN own o ON o.model = b.model CROSS JOIN (SELECT CAST(unnest([1.5, 1.8, 2.0]) AS DOUBLE) AS k) k GROUP BY k.k""",
        "shapes", extra=_CENTROID,
    ),
)
def threshold_grid(spark, base):
    return classify.threshold_grid(cut(_errors(spark, base)))


@query("autoencoder_classes")
def autoencoder_classes(spark, base):
    shapes = cut(I.shapes(spark, base))
    models = classify.train(shapes)
    errors = cut(classify.reconstruction_errors(shapes, models))
    limits, _ = classify.choose_thresholds(errors)
    return classify.predict(errors, limits)


@query("new_pattern_onboarding")
def new_pattern_onboarding(spark, base):
    """Models of three patterns first; the fourth is added later and all shapes are classified again."""
    shapes = cut(I.shapes(spark, base))
    known = shapes.filter("pattern <> 'D'")
    models = classify.train(known)
    models, limits = classify.onboard(shapes, models, "D")
    errors = cut(classify.reconstruction_errors(shapes, models))
    return classify.pattern_accuracy(classify.predict(errors, limits))


@query("unknown_regrouped")
def unknown_regrouped(spark, base):
    """Shapes no pattern claims, clustered again under one name."""
    errors = cut(_errors(spark, base))
    unknown = classify.unknown_shapes(cut(I.shapes(spark, base)), classify.predict(errors, classify.thresholds(errors, 1.5)))
    return classify.regroup(unknown).select("pattern", "row_key", "weight", "label")


@query("residual_groups")
def residual_groups(spark, base):
    """Outliers clustered again, round by round, until few persons are left or the clusters are poor."""
    vectors = shape.distinct_vectors(shape.normalised(_days(spark, base)))
    return shape.residual_rounds(vectors).select("pattern", "round", "row_key", "weight", "label")


@query(
    "vector_pairs",
    """WITH c AS (SELECT label, i, AVG(x) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
       GROUP BY label, i),
       e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
       SELECT e.vec_id, round(sqrt(SUM((e.x - c.m) * (e.x - c.m))), 5) AS dist, round(SUM((e.x - c.m) * (e.x - c.m)) / 64, 6) AS mse
       FROM e JOIN c ON c.label = e.label AND c.i = e.i GROUP BY e.vec_id""",
)
def vector_pairs(spark, base):
    """Distance and mean squared error of each vector to its label's mean vector."""
    e = table(spark, base, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    centre = classify.mean_vectors(e, "label").withColumnRenamed("mean", "centre")
    j = e.join(centre, "label")
    return j.select(
        "vec_id",
        F.round(A.euclidean(F.col("vec"), F.col("centre")), 5).alias("dist"),
        F.round(A.mean_squared_error(F.col("vec"), F.col("centre")), 6).alias("mse"),
    )
