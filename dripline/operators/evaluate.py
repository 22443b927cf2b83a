"""Scores of predictions: regression metrics, splits, folds, ensembles, fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dripline.functions import scalars as S
from dripline.operators.quality import ENSEMBLE_GAIN
from dripline.session import cut

# Ensemble weights, coarse and fine.
ALPHAS = [round(0.1 * i, 1) for i in range(1, 10)]
FINE_ALPHAS = [round(0.01 * i, 2) for i in range(101)]


def r2(actual: Column, pred: Column) -> Column:
    """R² from mergeable moments; null for a constant target."""
    spread = F.var_pop(actual) * F.count(actual)
    return F.when(spread > 0, 1 - F.sum((actual - pred) * (actual - pred)) / spread)


def mse(actual: Column, pred: Column) -> Column:
    return F.avg((actual - pred) * (actual - pred))


def accuracy(actual: Column, pred: Column, tolerance: float = 0.1) -> Column:
    """Percent of non-zero targets predicted within ``tolerance``; 0 when every target is zero."""
    close = F.when(actual != 0, (F.abs(actual - pred) / actual < tolerance).cast("double"))
    return F.coalesce(F.avg(close) * 100, F.lit(0.0))


def regression_metrics(preds: DataFrame, by: list[str]) -> DataFrame:
    a, p = F.col("actual"), F.col("pred")
    return preds.groupBy(*by).agg(
        r2(a, p).alias("r2"), F.sqrt(mse(a, p)).alias("rmse"), mse(a, p).alias("mse"), accuracy(a, p).alias("accuracy")
    )


def error_counts(preds: DataFrame, by: str = "pattern") -> DataFrame:
    """Predictions off by at least 10 % and below, per pattern and overall."""
    err = F.abs(S.percent_error(F.col("actual"), F.col("pred")))
    rolled = preds.filter(F.col("actual") != 0).rollup(by).agg(
        F.count_if(err >= 10).alias("high"), F.count_if(err < 10).alias("low"), F.grouping(by).alias("g")
    )
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col(by)).alias(by), "high", "low")


def box_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    return quantiles(df, value, [by], {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


#: Values of a part that are put in order at once, and passes at most (a pass divides a range of values by 1,024).
FEW_VALUES, MOST_PASSES = 10_000, 40


def quantiles(
    df: DataFrame, value: str, by: list[str], wanted: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, at any size; ``weight`` counts a row several times.

    Only the values around the wanted ranks matter. While a part holds more than ``FEW_VALUES`` of them, equal-width
    buckets are counted and only those that hold a wanted rank are kept, as parts of their own, so each pass reads what
    the pass before left. The rest is put in order and read. Groups are only ever counted by partial aggregation.
    """
    n_rows = F.sum(weight) if weight else F.count("*")
    keys = [*by, "_g"]
    tied = df.select("*", F.lit(0).alias("_g")).groupBy(*keys, F.col(value).cast("double").alias("_v"))
    counts = cut(tied.agg(n_rows.alias("_c")))  # several passes follow
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ends = [f((F.col("_n") - 1) * q).cast("long") for q in wanted.values() for f in (F.floor, F.ceil)]
    ranks = sizes.select(*keys, "_n", F.array_distinct(F.array(*ends)).alias("_ranks"))
    rows = counts.withColumn("_base", F.lit(0).cast("long"))
    part = keys
    for level in range(MOST_PASSES):
        if (rows.groupBy(*part).count().agg(F.max("count")).first()[0] or 0) <= FEW_VALUES:
            break
        rows = cut(_around_ranks(rows, ranks, keys, part, f"_b{level}"))
        part = [*part, f"_b{level}"]
    before = F.sum("_c").over(W.partitionBy(*part).orderBy("_v").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("_start", F.col("_base") + F.coalesce(before, F.lit(0))).join(sizes, keys)

    def at(q: float) -> Column:
        rank = (F.col("_n") - 1) * q
        low, high = F.floor(rank), F.ceil(rank)

        def value_at(r: Column) -> Column:
            return F.max(F.when((F.col("_start") <= r) & (r < F.col("_start") + F.col("_c")), F.col("_v")))

        return value_at(low) + (value_at(high) - value_at(low)) * F.max(rank - low)

    return placed.groupBy(*keys).agg(*[at(q).alias(name) for name, q in wanted.items()]).drop("_g")


def _around_ranks(
    rows: DataFrame, ranks: DataFrame, keys: list[str], part: list[str], name: str, buckets: int = 1024
) -> DataFrame:
    """Rows of those equal-width buckets of each part that contain a wanted rank, with the count before them."""
    ends = rows.groupBy(*part).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / buckets
    bucket = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(buckets - 1))).otherwise(0)
    put = rows.join(ends, part).withColumn(name, bucket.cast("int")).drop("_lo", "_hi")
    sums = put.groupBy(*part, name).agg(F.sum("_c").alias("_k"), F.first("_base").alias("_base"))
    # At most ``buckets`` rows per part.
    over = W.partitionBy(*part).orderBy(name).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.col("_base") + F.coalesce(F.sum("_k").over(over), F.lit(0)))
    holds = F.exists("_ranks", lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_k")))
    hits = sums.join(ranks, keys).filter(holds).select(*part, name, "_base")
    return put.drop("_base").join(hits, [*part, name])


def quartiles(df: DataFrame, value: str, by: list[str], weight: str | None = None) -> DataFrame:
    return quantiles(df, value, by, {"q1": 0.25, "q3": 0.75}, weight)


def upper_fence(
    df: DataFrame, value: str, by: list[str], factor: float = 0.5, weight: str | None = None
) -> DataFrame:
    """Q3 + ``factor``·IQR per group."""
    q = quartiles(df, value, by, weight)
    return q.withColumn("fence", F.col("q3") + factor * (F.col("q3") - F.col("q1")))


def flag_outliers(
    df: DataFrame, value: str, by: list[str], factor: float = 0.5, weight: str | None = None
) -> DataFrame:
    """Mark rows strictly above their group's fence."""
    fence = upper_fence(df, value, by, factor, weight).select(*by, "fence")
    joined = df.join(fence, by) if by else df.withColumn("fence", fence.scalar())
    return joined.withColumn("outlier", F.col(value) > F.col("fence"))


def split_by_date(df: DataFrame) -> DataFrame:
    """Train / valid / holdout per person by date rank.

    29 dates or more: the last 4 are held out, the 5 before them validate, all earlier ones train. 5 to 28: 70 %
    (at least 3) / 15 % (at least 1) / rest. Fewer than 5: rows are split 70 / 30 by a hash of their keys.
    """
    keys = ["pattern", "person_id"]
    dates = df.select(*keys, "date").distinct()
    w = W.partitionBy(*keys)
    ranked = dates.withColumn("_r", F.row_number().over(w.orderBy("date"))).withColumn("_n", F.count("*").over(w))
    n, r = F.col("_n"), F.col("_r")
    train = F.greatest(F.floor(n * 0.7), F.lit(3))
    valid = F.greatest(F.floor(n * 0.15), F.lit(1))
    long_split = F.when(r <= n - 9, "train").when(r <= n - 4, "valid").otherwise("holdout")
    short_split = F.when(r <= train, "train").when(r <= train + valid, "valid").otherwise("holdout")
    ranked = ranked.withColumn("split", F.when(n >= 29, long_split).when(n >= 5, short_split)).drop("_r", "_n")
    joined = df.join(ranked, [*keys, "date"])
    cells = [F.col(c) for c in (*keys, "date", "hour", "minute") if c in df.columns]
    by_hash = F.when(S.hashed_fraction(*cells) < 0.7, "train").otherwise("valid")
    return joined.withColumn("split", F.coalesce("split", by_hash))


def with_folds(df: DataFrame, keys: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Deterministic shuffled folds."""
    return df.withColumn("fold", F.floor(S.hashed_fraction(*[F.col(c) for c in keys], seed=seed) * k).cast("int"))


def sample_persons(df: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """Rows of ``n`` persons per pattern, drawn without replacement by hash order."""
    people = df.select("pattern", "person_id").distinct()
    order = S.hashed_fraction(F.col("person_id"), seed=seed)
    rank = F.row_number().over(W.partitionBy("pattern").orderBy(order, "person_id"))
    picked = people.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")
    return df.join(picked, ["pattern", "person_id"], "left_semi")


def with_draws(df: DataFrame, draws: int = 5, seed: int = 42) -> DataFrame:
    """Rows with ``draw``: a hash deals the rows of a pattern to equal, disjoint draws."""
    cells = [F.col(c) for c in ("pattern", "person_id", "date", "hour", "minute")]
    return df.withColumn("draw", F.floor(S.hashed_fraction(*cells, seed=seed) * draws).cast("int"))


def person_draws(df: DataFrame, draws: int = 5, seed: int = 42) -> DataFrame:
    """(pattern, person_id, draw): which of the draws of its pattern each person learns from."""
    people = df.select("pattern", "person_id").distinct()
    return people.withColumn("draw", F.floor(S.hashed_fraction(F.col("pattern"), F.col("person_id"), seed=seed) * draws).cast("int"))


def weighted_training_rows(df: DataFrame, draws: int = 5, weight: float = 0.2, seed: int = 42) -> DataFrame:
    """(learner, row columns, weight) for every person: own rows with weight 1, one draw of the others' with 0.2.

    With five draws a person learns from a fifth of the pattern's other rows. The draws are disjoint and made once, so
    rows and persons meet in an equi join by draw; rows are multiplied only by the persons that take them.
    """
    rows = with_draws(df, draws, seed)
    takers = person_draws(df, draws, seed).withColumnRenamed("person_id", "learner")
    others = rows.join(takers, ["pattern", "draw"]).filter("learner <> person_id").withColumn("weight", F.lit(weight))
    own = rows.withColumn("learner", F.col("person_id")).withColumn("weight", F.lit(1.0))
    columns = ["learner", *df.columns, "weight"]
    return own.select(columns).unionByName(others.select(columns))


def prediction_sample(df: DataFrame, keys: list[str], n: int = 100, seed: int = 42) -> DataFrame:
    """Fixed sample of ``n`` rows in hash order."""
    return df.orderBy(S.hashed_fraction(*[F.col(c) for c in keys], seed=seed), *keys).limit(n)


def _blend(a: float) -> Column:
    return F.col("base") * a + F.col("personal") * (1 - a)


def ensemble_grid(preds: DataFrame, by: list[str], alphas: list[float] = ALPHAS) -> DataFrame:
    """R² of α·base + (1-α)·personal for each weight of the grid.

    Squared error is quadratic in α, so six sums per key hold the whole grid: rows are read once and not
    multiplied by the number of weights.
    """
    y, b, p = F.col("actual"), F.col("base"), F.col("personal")
    d, e = b - p, y - p
    sums = preds.groupBy(*by).agg(
        (F.var_pop(y) * F.count(y)).alias("spread"),
        F.sum(e * e).alias("ee"), F.sum(e * d).alias("ed"), F.sum(d * d).alias("dd"),
    )
    spread = F.col("spread")
    alpha = F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha")
    a = F.col("alpha")
    err = F.col("ee") - 2 * a * F.col("ed") + a * a * F.col("dd")
    return sums.select("*", alpha).select(*by, "alpha", F.when(spread > 0, 1 - err / spread).alias("r2"))


def best_alpha(grid: DataFrame, by: list[str]) -> DataFrame:
    """Weight with the highest R²; the smallest one on ties."""
    best = F.max_by("alpha", F.struct(F.col("r2"), -F.col("alpha"))).alias("alpha")
    return grid.filter("r2 is not null").groupBy(*by).agg(best, F.max("r2").alias("r2"))


def ensemble_scores(preds: DataFrame, alphas: DataFrame, by: list[str]) -> DataFrame:
    """Base, personal and ensemble metrics per key and split, wide."""
    df = preds.join(alphas.select(*by, "alpha"), by).withColumn(
        "ensemble", F.col("alpha") * F.col("base") + (1 - F.col("alpha")) * F.col("personal")
    )
    y = F.col("actual")
    aggs = []
    for name in ("base", "personal", "ensemble"):
        p = F.col(name)
        aggs += [
            r2(y, p).alias(f"{name}_r2"),
            F.sqrt(mse(y, p)).alias(f"{name}_rmse"),
            accuracy(y, p).alias(f"{name}_acc"),
        ]
    return df.groupBy(*by, "split", "alpha").agg(*aggs)


def adopt_ensemble(scores: DataFrame) -> DataFrame:
    """Use the ensemble when R² gains 0.05 or accuracy 5 points on validation; otherwise α is 0."""
    gain = (F.col("ensemble_r2") - F.col("personal_r2") >= ENSEMBLE_GAIN) | (
        F.col("ensemble_acc") - F.col("personal_acc") >= ENSEMBLE_GAIN * 100
    )
    use = F.coalesce(gain, F.lit(False))
    return scores.withColumn("use_ensemble", use).withColumn("alpha", F.when(use, F.col("alpha")).otherwise(0.0))


def summary_table(scores: DataFrame, by: list[str]) -> DataFrame:
    """One row per key with validation and holdout metrics side by side."""
    names = [f"{m}_{k}" for m in ("base", "personal", "ensemble") for k in ("r2", "rmse", "acc")]
    picks = [
        F.max(F.when(F.col("split") == split, F.col(n))).alias(f"{split}_{n}")
        for split in ("valid", "holdout")
        for n in names
    ]
    return scores.groupBy(*by).agg(*picks)


def pattern_means(summary: DataFrame, by: str = "pattern", skip: tuple[str, ...] = ("person_id",)) -> DataFrame:
    """Mean of every numeric summary column per pattern."""
    numeric = [n for n, t in summary.dtypes if t in ("double", "int", "bigint", "float") and n not in (by, *skip)]
    return summary.groupBy(by).agg(*[F.avg(n).alias(n) for n in numeric])


def fold_means(fold_metrics: DataFrame, by: str = "scope") -> DataFrame:
    return fold_metrics.groupBy(by).agg(
        F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.avg("accuracy").alias("accuracy"),
        F.stddev_pop("r2").alias("r2_spread"),
    )


def top_k(df: DataFrame, by: list[str], score: str, name: str, k: int) -> DataFrame:
    """``k`` best names per scope with their rank; ties by name."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(F.col(score).desc(), name)))
    return ranked.filter(F.col("rank") <= k)
