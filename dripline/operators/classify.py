"""Pattern classification of five-day shapes by reconstruction error."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from dripline.functions import arrays as A
from dripline.operators import shape
from dripline.operators.quality import MAX_UNKNOWN
from dripline.session import cut

# Layer sizes, learning rate, epochs and threshold steps.
LAYERS = [48, 24, 12, 24, 48]
RELU_AFTER = (0, 2)
LEARNING_RATE = 1e-3
EPOCHS = 150
STD_STEPS = [1.5, 1.8, 2.0]

KEYS = ["pattern", "person_id", "block"]

Weights = list[np.ndarray]


def mean_vectors(rows: DataFrame, by: str, vec: str = "vec") -> DataFrame:
    """Element-wise mean vector per key; partial sums keep a frequent key cheap."""
    long = rows.select(by, F.posexplode(vec).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("m"))
    cells = F.array_sort(F.collect_list(F.struct("i", "m")))  # one entry per vector element
    return long.groupBy(by).agg(F.transform(cells, lambda s: s["m"]).alias("mean"))


def centroid_errors(shapes: DataFrame) -> DataFrame:
    """Mean squared error of each shape to each pattern's mean shape."""
    centres = mean_vectors(shapes, "pattern").select(F.col("pattern").alias("model"), "mean")
    models = centres.agg(F.collect_list(F.struct("model", "mean"))).scalar()  # one entry per named pattern
    return shapes.select(*KEYS, "vec", F.explode(models).alias("_m")).select(
        *KEYS, F.col("_m.model").alias("model"), F.round(A.mean_squared_error(F.col("vec"), F.col("_m.mean")), 9).alias("mse")
    )


def initial_weights(seed: int) -> Weights:
    """Uniform weights and biases within 1/sqrt(inputs)."""
    rng = np.random.default_rng(seed)
    out: Weights = []
    for n_in, n_out in zip(LAYERS, LAYERS[1:]):
        bound = 1.0 / math.sqrt(n_in)
        out += [rng.uniform(-bound, bound, (n_in, n_out)), rng.uniform(-bound, bound, n_out)]
    return out


def _forward(weights: Weights, x: np.ndarray) -> list[np.ndarray]:
    """Outputs of every layer, the input first."""
    outs = [x]
    for layer in range(len(LAYERS) - 1):
        z = outs[-1] @ weights[2 * layer] + weights[2 * layer + 1]
        outs.append(np.maximum(z, 0.0) if layer in RELU_AFTER else z)
    return outs


def gradient_sum(weights: Weights, x: np.ndarray) -> Weights:
    """Gradient of the summed (not averaged) squared error over the rows of ``x``."""
    outs = _forward(weights, x)
    delta = 2.0 * (outs[-1] - x)
    grads: Weights = []
    for layer in reversed(range(len(LAYERS) - 1)):
        if layer in RELU_AFTER:
            delta = delta * (outs[layer + 1] > 0)
        grads = [outs[layer].T @ delta, delta.sum(axis=0), *grads]
        delta = delta @ weights[2 * layer].T
    return grads


def _unflatten(flat: np.ndarray) -> Weights:
    out: Weights = []
    at = 0
    for n_in, n_out in zip(LAYERS, LAYERS[1:]):
        out.append(flat[at : at + n_in * n_out].reshape(n_in, n_out))
        at += n_in * n_out
        out.append(flat[at : at + n_out])
        at += n_out
    return out


def _flatten(weights: Weights) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def packed_blocks(shapes: DataFrame) -> DataFrame:
    """(pattern, n, block): the vectors of a pattern in one partition as one array of numbers, once for all epochs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            for p, part in pdf.groupby("pattern", sort=False):
                x = np.stack(part["vec"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([len(x)]), pa.array([x.tobytes()])], ["pattern", "n", "block"])

    return shapes.select("pattern", "vec").mapInArrow(pack, "pattern string, n long, block binary")


def train(shapes: DataFrame, epochs: int = EPOCHS, seed: int = 42, rate: float = LEARNING_RATE) -> dict[str, Weights]:
    """One autoencoder per pattern, full-batch Adam on the mean squared error.

    Shapes are packed once into blocks that stay on their executors (and are packed again from the checkpoint if one is
    lost). An epoch is one small job: a task adds up the gradients of its blocks, a tree adds the tasks' sums, nothing
    is shuffled by key, and the driver receives one gradient per named pattern.
    """
    spark = shapes.sparkSession
    blocks = cut(packed_blocks(shapes))
    n = {r["pattern"]: r["n"] for r in blocks.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    held = blocks.rdd.map(lambda r: (r["pattern"], np.frombuffer(r["block"]).reshape(-1, LAYERS[0]))).persist(StorageLevel.MEMORY_AND_DISK)
    models = {p: _flatten(initial_weights(seed)) for p in sorted(n)}
    first = {p: np.zeros_like(w) for p, w in models.items()}
    second = {p: np.zeros_like(w) for p, w in models.items()}

    def merged(a: dict, b: dict) -> dict:
        return {p: a.get(p, 0.0) + b.get(p, 0.0) for p in a.keys() | b.keys()}

    for epoch in range(1, epochs + 1) if n else ():
        shared = spark.sparkContext.broadcast(models)

        def add(sums: dict, block: tuple) -> dict:
            p, x = block
            return merged(sums, {p: _flatten(gradient_sum(_unflatten(shared.value[p]), x))})

        total = held.treeAggregate({}, add, merged)
        shared.unpersist()
        step = rate * math.sqrt(1 - 0.999**epoch) / (1 - 0.9**epoch)
        damp = 1e-8 * math.sqrt(1 - 0.999**epoch)
        for p in models:
            grad = total[p] / (n[p] * LAYERS[-1])
            first[p] = 0.9 * first[p] + 0.1 * grad
            second[p] = 0.999 * second[p] + 0.001 * grad**2
            models[p] = models[p] - step * first[p] / (np.sqrt(second[p]) + damp)
    held.unpersist()
    return {p: _unflatten(w) for p, w in models.items()}


def reconstruction_errors(shapes: DataFrame, models: dict[str, Weights]) -> DataFrame:
    """Reconstruction error of each shape under each pattern's model, long form.

    The models are a few thousand numbers per named pattern and travel with the task.
    """
    keys = [c for c in shapes.columns if c != "vec"]
    shared = shapes.sparkSession.sparkContext.broadcast({p: _flatten(w) for p, w in models.items()})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"].to_numpy())
            for name, flat in shared.value.items():
                mse = ((_forward(_unflatten(flat), x)[-1] - x) ** 2).mean(axis=1)
                yield pdf[keys].assign(model=name, mse=mse)

    types = ", ".join(f"{n} {t}" for n, t in shapes.dtypes if n in keys)
    return shapes.mapInPandas(score, f"{types}, model string, mse double")


def thresholds(errors: DataFrame, k: float) -> DataFrame:
    """Mean plus k population deviations of each pattern's errors under its own model."""
    own = errors.filter(F.col("pattern") == F.col("model"))
    return own.groupBy("model").agg((F.avg("mse") + k * F.stddev_pop("mse")).alias("threshold"))


def predict(errors: DataFrame, limits: DataFrame) -> DataFrame:
    """Pattern with the smallest error, or Unknown above that pattern's threshold."""
    keys = [c for c in errors.columns if c not in ("model", "mse")]
    best = errors.groupBy(*keys).agg(F.min(F.struct("mse", "model")).alias("b"))
    best = best.select(*keys, F.col("b.model").alias("model"), F.col("b.mse").alias("mse"))
    # One threshold per named pattern.
    return best.join(F.broadcast(limits), "model").select(
        *keys, F.when(F.col("mse") > F.col("threshold"), "Unknown").otherwise(F.col("model")).alias("predicted"), "mse"
    )


def pattern_accuracy(predicted: DataFrame) -> DataFrame:
    hit = (F.col("predicted") == F.col("pattern")).cast("double")
    miss = (F.col("predicted") == "Unknown").cast("double")
    return predicted.groupBy("pattern").agg(F.avg(hit).alias("accuracy"), F.avg(miss).alias("unknown"))


def confusion(predicted: DataFrame, labels: list[str]) -> DataFrame:
    """Counts of true against predicted pattern, Unknown left out."""
    known = predicted.filter("predicted <> 'Unknown'")
    return known.groupBy("pattern").agg(*[F.count_if(F.col("predicted") == p).alias(p) for p in labels])


def threshold_grid(errors: DataFrame, steps: list[float] = STD_STEPS) -> DataFrame:
    """Unknown ratio over all shapes for each k; every k is judged in one pass."""
    own = errors.filter(F.col("pattern") == F.col("model"))
    spread = own.groupBy("model").agg(F.avg("mse").alias("mu"), F.stddev_pop("mse").alias("sd"))
    keys = [c for c in errors.columns if c not in ("model", "mse")]
    best = errors.groupBy(*keys).agg(F.min(F.struct("mse", "model")).alias("b")).select(
        F.col("b.model").alias("model"), F.col("b.mse").alias("mse")
    )
    over = best.join(F.broadcast(spread), "model").agg(
        *[F.avg((F.col("mse") > F.col("mu") + k * F.col("sd")).cast("double")).alias(f"u{i}") for i, k in enumerate(steps)]
    )
    rows = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"u{i}").alias("unknown")) for i, k in enumerate(steps)])
    return over.select(F.inline(rows)).withColumn("passed", F.col("unknown") <= MAX_UNKNOWN)


def choose_thresholds(errors: DataFrame, steps: list[float] = STD_STEPS) -> tuple[DataFrame, bool]:
    """Thresholds of the first k that keeps the Unknown ratio low, else those of the first k and ``False``
    (the patterns should be clustered again)."""
    tried = {r["k"]: r["passed"] for r in threshold_grid(errors, steps).collect()}  # one row per k
    passing = [k for k in steps if tried.get(float(k))]
    return thresholds(errors, passing[0] if passing else steps[0]), bool(passing)


def onboard(
    shapes: DataFrame, models: dict[str, Weights], pattern: str, epochs: int = EPOCHS, k: float = STD_STEPS[0]
) -> tuple[dict[str, Weights], DataFrame]:
    """Add a model and a threshold for a pattern that had none; the other models stay as they are."""
    fresh = train(shapes.filter(F.col("pattern") == pattern), epochs)
    merged = {**models, **fresh}
    return merged, thresholds(reconstruction_errors(shapes, merged), k)


def unknown_shapes(shapes: DataFrame, predicted: DataFrame) -> DataFrame:
    keys = [c for c in KEYS if c in shapes.columns]
    return shapes.join(predicted.filter("predicted = 'Unknown'"), keys, "left_semi")


def regroup(shapes: DataFrame, name: str = "new", eps: float = shape.EPS, least: int = shape.MIN_SAMPLES) -> DataFrame:
    """Cluster unclaimed shapes together, whatever pattern they came from."""
    key = F.col("person_id") * F.lit(65536) + F.col("block")
    vectors = shapes.select(F.lit(name).alias("pattern"), "vec", key.alias("row_key")).groupBy("pattern", "vec").agg(
        F.count("*").alias("weight"), F.min("row_key").alias("row_key")
    )
    return shape.dbscan(vectors, {name: (eps, least)})
