"""Feature diagnostics: correlation, variance inflation, principal components, importance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from dripline.session import cut, scratch_path

# Limits of the diagnostics.
MAX_VIF = 15.0
STRONG = 0.7
MIN_IMPORTANCE = 0.005
VARIANCE_KEPT = 0.95


def _cross_products(df: DataFrame, columns: list[str], by: str | None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per scope (and over all rows as ``all``): means and summed cross products about the means.

    Tasks add their rows into one p×p matrix per scope; the matrices are summed on the cluster, so the driver
    receives p*p numbers per scope whatever the number of rows and tasks. Rows are shifted by the overall means
    first, which keeps the sums accurate.
    """
    p = len(columns)
    scope = F.col(by).cast("string") if by else F.lit("all")
    # Two passes follow; the narrow table is written once instead of being derived twice.
    rows = cut(df.select(scope.alias("scope"), *[F.col(c).cast("double").alias(c) for c in columns]).na.drop())
    shift = np.array([v or 0.0 for v in rows.agg(*[F.avg(c) for c in columns]).first()])

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, part in pdf.groupby("scope", sort=False):
                x = np.column_stack([np.ones(len(part)), part[columns].to_numpy() - shift])
                sums[name] = sums.get(name, 0.0) + x.T @ x
        if sums:
            yield pd.DataFrame({"scope": list(sums), "m": [m.ravel() for m in sums.values()]})

    partial = rows.mapInPandas(add, "scope string, m array<double>")
    total = partial.select("scope", F.posexplode("m").alias("pos", "v")).groupBy("scope", "pos").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in total.collect():  # (p+1)^2 numbers per scope
        found.setdefault(r["scope"], np.zeros((p + 1) ** 2))[r["pos"]] = r["v"]
    if by and found:
        found["all"] = sum(found.values())
    out = {}
    for name, flat in found.items():
        m = flat.reshape(p + 1, p + 1)
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        out[name] = (mean + shift, m[1:, 1:] - n * np.outer(mean, mean))
    return out


def _correlation(cross: np.ndarray) -> np.ndarray:
    """Correlations; NaN for a column that does not vary."""
    var = np.diag(cross).copy()
    var[var < 1e-9] = np.nan
    return cross / np.sqrt(np.outer(var, var))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long-form upper triangle of the correlation matrix."""
    cross = _cross_products(df, columns, None).get("all")
    r = _correlation(cross[1]) if cross else np.full((len(columns),) * 2, np.nan)
    rows = [
        (a, b, None if np.isnan(r[i, j]) else float(r[i, j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if j > i
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def strong_pairs(pairs: DataFrame, limit: float = STRONG) -> DataFrame:
    return pairs.filter(F.abs("r") > limit)


def correlation_with_target(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    wide = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("feature"), (F.round(c, 6) + 0.0).alias("r")) for c in columns]
    long = wide.select(F.inline(F.array(*rows)))  # one row per feature
    return long.withColumn("rank", F.row_number().over(W.orderBy(F.col("r").desc(), "feature")))


def _moments(df: DataFrame, columns: list[str], by: str | None) -> dict[str, tuple[list[str], np.ndarray]]:
    """Correlation matrix per scope (and over all rows as ``all``) of the columns that vary."""
    out = {}
    for scope, (_, cross) in _cross_products(df, columns, by).items():
        used = [i for i in range(len(columns)) if cross[i, i] > 1e-9]
        out[scope] = ([columns[i] for i in used], _correlation(cross[np.ix_(used, used)]))
    return out


def _vifs(matrix: np.ndarray) -> np.ndarray:
    return np.diag(np.linalg.pinv(matrix)) if len(matrix) else np.array([])


def vif_by_scope(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Variance inflation factor of each feature over all rows and per scope.

    The cluster reduces the rows to one p×p matrix per scope; only these are inverted on the driver.
    """
    found = _moments(df, columns, by)
    rows = [(scope, name, float(v)) for scope, (names, m) in sorted(found.items()) for name, v in zip(names, _vifs(m))]
    out = df.sparkSession.createDataFrame(rows, "scope string, feature string, vif double")
    return out.withColumn("high", F.col("vif") > MAX_VIF)


def high_vif(df: DataFrame, columns: list[str], limit: float = MAX_VIF) -> list[str]:
    names, m = _moments(df, columns, None)["all"]
    return [n for n, v in zip(names, _vifs(m)) if v > limit]


def replace_by_components(df: DataFrame, columns: list[str], kept: float = VARIANCE_KEPT) -> DataFrame:
    """Replace ``columns`` by the fewest principal components that explain ``kept`` of their variance.

    Standardisation divides by the population deviation.
    """
    if not columns:
        return df
    df = cut(df)  # three passes follow
    n = df.count()
    assembled = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df)
    scaled = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True).fit(assembled).transform(assembled)
    grow = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    model = PCA(k=len(columns), inputCol="_std", outputCol="_pc").fit(scaled)
    explained = np.cumsum(model.explainedVariance.toArray())
    k = int(np.searchsorted(explained, kept - 1e-12) + 1)
    parts = vector_to_array("_pc")
    out = model.transform(scaled).withColumn("_a", parts)
    keep = [c for c in df.columns if c not in columns]
    return out.select(*keep, *[(F.col("_a")[i] * grow).alias(f"PC{i + 1}") for i in range(k)])


def project_2d(vectors: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """First two principal components of centred vectors.

    Several passes follow; the vectors are written once, in columns since most of their numbers are equal.
    """
    path = scratch_path(vectors.sparkSession, "vectors")
    vectors.select(*keys, vec).write.parquet(path)
    rows = vectors.sparkSession.read.schema(vectors.select(*keys, vec).schema).parquet(path).withColumn("_v", array_to_vector(vec))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    # Spark's projection is not centred; subtracting the projected mean centres it.
    means = rows.agg(*[F.avg(F.col(vec)[i]).alias(f"m{i}") for i in range(model.pc.numRows)]).first()
    shift = np.array([m or 0.0 for m in means]) @ model.pc.toArray()
    a = vector_to_array("_p")
    return model.transform(rows).select(*keys, (a[0] - float(shift[0])).alias("x"), (a[1] - float(shift[1])).alias("y"))


def importance_shares(importance: DataFrame, by: list[str]) -> DataFrame:
    """Share of each feature's gain within its scope, and whether it is worth keeping."""
    total = importance.groupBy(*by).agg(F.sum("gain").alias("_t"))
    share = F.col("gain") / F.col("_t")
    return importance.join(total, by).select(
        *importance.columns, share.alias("share"), (share >= MIN_IMPORTANCE).alias("keep")
    )


def importance_with_vif(importance: DataFrame, vifs: DataFrame, k: int = 10) -> DataFrame:
    """Top features per scope beside their variance inflation (0 when unknown)."""
    w = W.partitionBy("scope").orderBy(F.col("gain").desc(), "feature")  # one row per feature and scope
    top = importance.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    joined = top.join(vifs.select("scope", "feature", "vif"), ["scope", "feature"], "left")
    return joined.na.fill({"vif": 0.0})


def union_of_tops(importance: DataFrame, per_scope: int = 5, limit: int = 8) -> DataFrame:
    """Union of the top features over the scopes: the ``limit`` with the best rank in any scope, ties to the larger gain."""
    w = W.partitionBy("scope").orderBy(F.col("gain").desc(), "feature")
    top = importance.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_scope)
    best = top.groupBy("feature").agg(F.min("_r").alias("rank"), F.max("gain").alias("gain"))
    return best.orderBy("rank", F.col("gain").desc(), "feature").limit(limit).select("feature", "rank")
