"""Voice branch: frame statistics, speaker vectors, mixtures and their outliers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from dripline.functions import arrays as A
from dripline.operators import diagnostics, evaluate

# Voice limits.
COEFFICIENTS = 14
MIN_SNR = 5
MIN_ENERGY = 1e-3
MIXTURES = 10
TOP_SHARE = 0.01
MATCH = 85.0

MEANS = [f"mfcc_mean_{i}" for i in range(1, COEFFICIENTS + 1)]
STDS = [f"mfcc_std_{i}" for i in range(1, COEFFICIENTS + 1)]


def quiet_enough(df: DataFrame, snr: str = "snr") -> DataFrame:
    """Recordings above the noise limit."""
    return df.filter(F.col(snr) > MIN_SNR)


def frame_energy(frame: Column) -> Column:
    return F.aggregate(frame, F.lit(0.0), lambda s, x: s + F.abs(x))


def loud_frames(frames: Column) -> Column:
    """Frames of a recording whose summed absolute coefficients exceed the energy limit."""
    return F.filter(frames, lambda f: frame_energy(f) > MIN_ENERGY)


def recording_frames(recordings: DataFrame, frames: str = "frames") -> DataFrame:
    """One row per kept frame; a recording without any disappears."""
    keys = [c for c in recordings.columns if c != frames]
    return recordings.select(*keys, F.explode(loud_frames(F.col(frames))).alias("frame"))


def frame_statistics(frames: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Mean and population deviation of each coefficient per recording.

    Merged by partial aggregation, so the frames of a recording are never collected.
    """
    loud = frames.filter(frame_energy(F.col(frame)) > MIN_ENERGY)
    return loud.groupBy(*keys).agg(
        *[F.avg(F.col(frame)[i]).alias(n) for i, n in enumerate(MEANS)],
        *[F.stddev_pop(F.col(frame)[i]).alias(n) for i, n in enumerate(STDS)],
    )


def user_vectors(recordings: DataFrame, user: str = "user_id") -> DataFrame:
    """Mean of a user's recording vectors."""
    return recordings.groupBy(user).agg(*[F.avg(c).alias(c) for c in (*MEANS, *STDS)])


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scaled feature vector in ``features``; divides by the population deviation.

    Spark's scaler uses the sample deviation, so its output is stretched by sqrt(n / (n - 1)).
    """
    assembled = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df)
    model = StandardScaler(inputCol="_raw", outputCol="_s", withMean=True, withStd=True).fit(assembled)
    n = df.count()
    grow = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    from pyspark.ml.functions import array_to_vector, vector_to_array

    stretched = F.transform(vector_to_array("_s"), lambda x: x * grow)
    return model.transform(assembled).withColumn("features", array_to_vector(stretched)).drop("_raw", "_s")


def mixture_clusters(scaled: DataFrame, k: int = MIXTURES) -> DataFrame:
    model = GaussianMixture(featuresCol="features", predictionCol="cluster", probabilityCol="_p", k=k, seed=42).fit(scaled)
    return model.transform(scaled).drop("_p")


def kmeans_clusters(scaled: DataFrame, k: int = MIXTURES) -> DataFrame:
    return KMeans(featuresCol="features", predictionCol="cluster", k=k, seed=42).fit(scaled).transform(scaled)


def mahalanobis(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """Distance of each row to its own cluster under the cluster's covariance.

    One mean and one inverse covariance per cluster leave the cluster; both are p and p×p numbers. A cluster
    with fewer rows than dimensions has a singular covariance and uses the pseudo-inverse.
    """
    sizes = {str(r[cluster]): r["n"] for r in df.groupBy(cluster).agg(F.count("*").alias("n")).collect()}
    parts = diagnostics._cross_products(df, columns, cluster)
    models = {
        name: (mean, np.linalg.pinv(cross / max(sizes[name] - 1, 1), rcond=1e-9))
        for name, (mean, cross) in parts.items()
        if name in sizes
    }
    shared = df.sparkSession.sparkContext.broadcast(models)
    keep = [c for c in df.columns if c != "features"]
    types = dict(df.dtypes)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = np.zeros(len(pdf))
            x, names = pdf[columns].to_numpy(float), pdf[cluster].astype(str).to_numpy()
            for name in set(names):
                mean, inverse = shared.value[name]
                at = names == name
                diff = x[at] - mean
                d[at] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", diff, inverse, diff), 0.0))
            yield pdf.assign(distance=d)

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", distance double"
    return df.select(*keep).mapInPandas(score, schema)


def drop_farthest(scored: DataFrame, cluster: str = "cluster", share: float = TOP_SHARE) -> DataFrame:
    """Flag the farthest ``share`` of each cluster."""
    limit = evaluate.quantiles(scored, "distance", [cluster], {"limit": 1 - share})
    return scored.join(limit, cluster).withColumn("outlier", F.col("distance") > F.col("limit"))


def similarity(a: Column, b: Column) -> Column:
    """Cosine similarity in percent."""
    return A.cosine(a, b) * 100


def auth_result(score: Column) -> Column:
    return F.when(score >= MATCH, "success").otherwise("failure")


def ranked_candidates(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of each attempt, most similar first; an attempt has one candidate per family member."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "candidate")))
    return scores.groupBy(*keys).agg(pairs.alias("c")).select(
        *keys, F.posexplode("c").alias("pos", "v")
    ).select(*keys, F.col("pos"), F.col("v.candidate").alias("candidate"), (-F.col("v.s")).alias("similarity"))
