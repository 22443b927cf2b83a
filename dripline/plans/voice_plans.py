"""Named queries of the voice branch; every embedding is a frame of its label's recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from dripline.functions import arrays as A
from dripline.operators import classify, voice
from dripline.plans import inputs as I
from dripline.plans.catalog import query
from dripline.session import cut
from dripline.sources.tables import table

_FRAMES = """SELECT CAST(label AS BIGINT) AS user_id, vec_id // 100 AS recording, vec_id, i, x FROM (
  SELECT label, vec_id, CAST(unnest(embedding[1:14]) AS DOUBLE) AS x, generate_subscripts(embedding[1:14], 1) AS i FROM embeddings)"""
_KEPT = f"""SELECT * FROM (SELECT *, SUM(abs(x)) OVER (PARTITION BY vec_id) AS energy FROM ({_FRAMES})) WHERE energy > 0.001"""
_STATS = f"SELECT user_id, recording, i, AVG(x) AS m, stddev_pop(x) AS s FROM ({_KEPT}) GROUP BY ALL"
_COLS = [*voice.MEANS, *voice.STDS]


def _wide(keys: str, source: str, digits: int) -> str:
    cells = [f"round(MAX(m) FILTER (WHERE i = {n}), {digits}) + 0.0 AS mfcc_mean_{n}" for n in range(1, 15)]
    cells += [f"round(MAX(s) FILTER (WHERE i = {n}), {digits}) + 0.0 AS mfcc_std_{n}" for n in range(1, 15)]
    return f"SELECT {keys}, {', '.join(cells)} FROM ({source}) GROUP BY {keys}"


def _rounded(df, keys):
    return df.select(*keys, *[(F.round(c, 6) + 0.0).alias(c) for c in _COLS])


@query("frame_stats", _wide("user_id, recording", _STATS, 6))
def frame_stats(spark, base):
    """Coefficient statistics per recording; the frames arrive as an array per recording."""
    frames = I.frames(spark, base)
    return _rounded(voice.frame_statistics(frames, ["user_id", "recording"]), ["user_id", "recording"])


@query(
    "user_voice_mean",
    _wide("user_id", f"SELECT user_id, i, AVG(m) AS m, AVG(s) AS s FROM ({_STATS}) GROUP BY ALL", 6),
)
def user_voice_mean(spark, base):
    per = voice.frame_statistics(I.frames(spark, base), ["user_id", "recording"])
    return _rounded(voice.user_vectors(per), ["user_id"])


@query(
    "loud_frames",
    f"""SELECT vec_id, round(energy, 6) AS energy FROM (SELECT vec_id, SUM(abs(x)) AS energy FROM ({_FRAMES}) GROUP BY vec_id) WHERE energy > 0.001""",
)
def loud_frames(spark, base):
    e = I.frames(spark, base).select("vec_id", voice.frame_energy(F.col("frame")).alias("energy"))
    return e.filter(F.col("energy") > voice.MIN_ENERGY).withColumn("energy", F.round("energy", 6))


@query(
    "speech_window",
    """SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(w) AS x, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos FROM (
       SELECT vec_id, embedding[(label * 2 + 1):(label * 2 + 20)] AS w FROM embeddings))""",
)
def speech_window(spark, base):
    """Samples between the start and end of speech; ten samples per second here."""
    e = table(spark, base, "embeddings")
    start = F.col("label") / 5.0
    w = A.speech_window(F.col("embedding"), start, start + 2.0, F.lit(10))
    return e.select("vec_id", F.posexplode(w).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


_SIMILAR = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  c AS (SELECT label AS candidate, i, AVG(x) AS m FROM e GROUP BY label, i),
  sim AS (SELECT e.vec_id, e.label, c.candidate, round(SUM(x * m) / (sqrt(SUM(x * x)) * sqrt(SUM(m * m))) * 100, 4) AS similarity
          FROM e JOIN c ON c.i = e.i AND c.candidate % 3 = e.label % 3 GROUP BY ALL)"""


def _similarities(spark, base):
    """Similarity of each attempt to the voices of its family (labels with equal remainder by three)."""
    e = table(spark, base, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    voices = classify.mean_vectors(e, "label").select(
        F.col("label").alias("candidate"), (F.col("label") % 3).alias("family"), "mean"
    )
    attempts = e.withColumn("family", F.col("label") % 3)
    # Only members of the attempt's own family are compared.
    return attempts.join(voices, "family").select(
        "vec_id", "label", "candidate", F.round(voice.similarity(F.col("vec"), F.col("mean")), 4).alias("similarity")
    )


@query(
    "auth_results",
    f"{_SIMILAR} SELECT vec_id, similarity, CASE WHEN similarity >= 85 THEN 'success' ELSE 'failure' END AS result FROM sim WHERE candidate = label",
)
def auth_results(spark, base):
    own = _similarities(spark, base).filter("candidate = label")
    return own.select("vec_id", "similarity", voice.auth_result(F.col("similarity")).alias("result"))


@query(
    "candidate_order",
    f"""{_SIMILAR} SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, candidate) - 1 AS INTEGER) AS pos,
        candidate, similarity FROM sim""",
)
def candidate_order(spark, base):
    return voice.ranked_candidates(_similarities(spark, base), ["vec_id"])


def _vectors(spark, base):
    """One vector of 28 values per recording of a speaker: means and deviations of the 14 coefficients."""
    frames = I.frames(spark, base)
    per = voice.frame_statistics(frames, ["user_id", "recording"])
    return cut(per.fillna(0.0, _COLS))


@query("gmm_clusters")
def gmm_clusters(spark, base):
    return voice.mixture_clusters(voice.standardised(_vectors(spark, base), _COLS)).select("user_id", "recording", "cluster")


@query("kmeans_clusters")
def kmeans_clusters(spark, base):
    return voice.kmeans_clusters(voice.standardised(_vectors(spark, base), _COLS)).select("user_id", "recording", "cluster")


@query("mahalanobis_top1")
def mahalanobis_top1(spark, base):
    clusters = voice.mixture_clusters(voice.standardised(_vectors(spark, base), _COLS), k=10)
    scored = voice.mahalanobis(cut(clusters.drop("features")), _COLS)
    return voice.drop_farthest(scored).select("user_id", "recording", "cluster", "distance", "outlier")
