"""Day-shape clustering: density clusters, silhouette, representative day, warping outliers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dripline.functions import arrays as A
from dripline.functions.dtw import dtw_by_length, dtw_cumulative_distance, dtw_distance, dtw_table, short_form
from dripline.operators import evaluate
from dripline.operators.components import components
from dripline.operators.grid import DAY
from dripline.operators.quality import MIN_COVERAGE, MIN_SILHOUETTE, cluster_gate
from dripline.operators.tiles import STRIP, compare_tiles, compare_within, distances, matrix, row_key
from dripline.session import cut

# Density clustering defaults and search limits.
EPS, MIN_SAMPLES = 0.9, 3
EPS_RANGE, MIN_SAMPLES_RANGE = (0.3, 1.5), (3, 10)
TRIES = 5
SMALL_INPUT = 500  # only reported
FENCE_FACTOR = 0.5
#: Rows of each bucket that all rows are compared with first.
FIRST_PORTION = 512
#: Members of a pattern that are compared with all others first.
FIRST_COMPARED = 16
#: Columns of a tile whose distances to a strip of rows are formed together.
COLUMNS = 1024
#: Points at which sums of roots are taken, and the greatest ratio of squares they are interpolated over.
NODES, REACH = 96, 50.0
#: Level of silhouette cells on which a cell is one vector.
LAST_LEVEL = 5

Params = dict[str, tuple[float, int]]


def normalised(days: DataFrame) -> DataFrame:
    return days.withColumn("vec", A.minmax(F.col("vec")))


def distinct_vectors(days: DataFrame) -> DataFrame:
    """Collapse equal vectors of a pattern: weight is the number of days, row_key the first of them."""
    return days.withColumn("row_key", row_key()).groupBy("pattern", "vec").agg(
        F.count("*").alias("weight"), F.min("row_key").alias("row_key")
    )


def _param(params: Params, position: int) -> Column:
    expr = F.lit(None)
    for name, values in params.items():
        expr = F.when(F.col("pattern") == name, F.lit(values[position])).otherwise(expr)
    return expr


def _cell(eps: Column) -> Column:
    """Cell of a vector: two vectors with the same support and the same cell are closer than eps.

    With k non-zero slots, sides of eps/sqrt(k) give a diagonal of eps.
    """
    k = F.size(F.filter("vec", lambda x: x != 0))
    side = eps * (1 - 1e-9) / F.sqrt(F.greatest(k, F.lit(1)))
    return F.transform("vec", lambda x: F.when(x == 0, F.lit(-1)).otherwise(F.floor(x / side).cast("int")))


def _homes(rows: DataFrame, eps: Column) -> DataFrame:
    """The one bucket in which a row looks for its neighbours.

    Below eps = 1 a row with maximum 1 looks under the slot of its maximum: a neighbour differs there by at most
    eps, so its own value is at least 1 - eps. Otherwise rows are banded by their norm, which changes by at most
    eps between neighbours.
    """
    norm = F.sqrt(A.dot(F.col("vec"), F.col("vec")))
    slot = F.when(F.array_max("vec") == 1.0, F.array_position("vec", F.lit(1.0))).otherwise(F.lit(0))
    band = F.floor(norm / eps)
    return rows.withColumn("bucket", F.when(eps < 1.0, slot).otherwise(-1 - band).cast("int"))


def _visits(rows: DataFrame, eps: Column) -> DataFrame:
    """Every bucket in which a row can be found by a neighbour."""
    norm = F.sqrt(A.dot(F.col("vec"), F.col("vec")))
    high = F.filter(
        F.transform("vec", lambda x, i: F.when(x >= 1.0 - eps - 1e-12, i + 1)), lambda i: i.isNotNull()
    )
    slots = F.when(F.array_max("vec") == 1.0, high).otherwise(F.array(F.lit(0)))
    band = F.floor(norm / eps)
    bands = F.array(*[(-1 - (band + d)).cast("int") for d in (-1, 0, 1)])
    return rows.withColumn("bucket", F.explode(F.when(eps < 1.0, slots.cast("array<int>")).otherwise(bands)))


def _portions(seen: DataFrame) -> tuple[DataFrame, int]:
    """(``seen`` with ``portion``, number of portions): a hash deals the rows of a bucket to portions.

    The first holds about ``FIRST_PORTION`` rows of each bucket, and each next one three times all before it. A search
    that most rows end early reads the first portions with all its rows and the large ones with few.
    """
    sizes = cut(seen.groupBy("pattern", "bucket").agg(F.count("*").alias("n")))  # a few hundred buckets
    most = sizes.agg(F.max("n")).first()[0] or 1
    count = 1 + max(0, math.ceil(math.log(most / FIRST_PORTION, 4)))
    # How many first portions lie before the place of a row.
    place = F.pmod(F.xxhash64("row_key", F.lit(7)), F.lit(2**30)) / 2.0**30 * F.col("n") / FIRST_PORTION
    number = F.when(place < 1, 0).otherwise(F.least(F.floor(F.log(place) / math.log(4)) + 1, F.lit(count - 1)))
    return seen.join(F.broadcast(sizes), ["pattern", "bucket"]).withColumn("portion", number.cast("int")).drop("n"), count


def _bipartite_groups(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component number of each row and each column of a table of links; -1 without any link."""
    rows, columns = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    for start in np.flatnonzero(near.any(axis=1)):
        if rows[start] >= 0:
            continue
        rows[start], front = start, np.array([start])
        while len(front):
            across = np.flatnonzero(near[front].any(axis=0) & (columns < 0))
            columns[across] = start
            front = np.flatnonzero(near[:, across].any(axis=1) & (rows < 0))
            rows[front] = start
    return rows, columns


def _count_neighbours(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Rows near each row, and which they are where they are fewer than it takes to be core."""
    if not len(left) or not len(right):
        return pd.DataFrame({"pattern": [], "row_key": [], "near": [], "links": []})
    near = distances(matrix(left["vec"]), matrix(right["vec"])) <= left["eps"].to_numpy()[:, None]
    count = near @ right["weight"].to_numpy()
    few = count < left["least"].to_numpy()
    named = right["row_key"].notna().to_numpy()
    near, keys = near[:, named], right["row_key"].to_numpy()[named].astype(np.int64)
    links = [keys[line] if short else keys[:0] for line, short in zip(near, few)]
    return pd.DataFrame({"pattern": key[0], "row_key": left["row_key"].to_numpy(), "near": count, "links": links})


def _link(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links of core rows found in one tile pair: a spanning star per local component."""
    if not len(left) or not len(right):
        return pd.DataFrame({"pattern": [], "a": [], "b": []})
    near = distances(matrix(left["vec"]), matrix(right["vec"])) <= float(left["eps"].iloc[0])
    group = np.concatenate(_bipartite_groups(near))
    keys = np.concatenate([left["row_key"].to_numpy(), right["row_key"].to_numpy()])[group >= 0]
    low = pd.Series(keys).groupby(group[group >= 0]).transform("min")
    return pd.DataFrame({"pattern": key[0], "a": keys, "b": low.to_numpy()}).query("a != b").drop_duplicates()


def _sparse_rows(rows: DataFrame, eps: Column) -> DataFrame:
    """(pattern, row_key, near, links) of the rows of sparse cells that are not core; ``links`` are their neighbours.

    A row that has found ``least`` neighbours is core and leaves the search.
    """
    seen, portions = _portions(_visits(rows, eps).select("pattern", "bucket", "row_key", "vec", "weight"))
    seen = cut(seen)
    open_ = _homes(rows.filter("not dense and row_key is not null"), eps).select("pattern", "bucket", "row_key", "vec", "eps", "least")
    none = F.array().cast("array<bigint>")
    open_ = open_.withColumn("near", F.lit(0).cast("long")).withColumn("links", none)
    for portion in range(portions):
        found = compare_tiles(
            open_.drop("near", "links"), seen.filter(F.col("portion") == portion).drop("portion"), ["pattern", "bucket"],
            _count_neighbours, "pattern string, row_key long, near long, links array<bigint>",
        )
        more = found.groupBy("pattern", "row_key").agg(
            F.sum("near").alias("_near"), F.flatten(F.collect_list(F.when(F.size("links") > 0, F.col("links")))).alias("_links")
        )
        joined = open_.join(more, ["pattern", "row_key"], "left")
        joined = joined.withColumn("near", F.col("near") + F.coalesce("_near", F.lit(0)))
        joined = joined.withColumn("links", F.concat("links", F.coalesce("_links", none))).drop("_near", "_links")
        open_ = cut(joined.filter(F.col("near") < F.col("least")))
    return open_.select("pattern", "row_key", "near", "links")


def _core_roots(core: DataFrame, eps: Column) -> DataFrame:
    """(pattern, node, root) of all core rows that have a neighbour.

    The first portion of each bucket joins most rows of a pattern to one component, the settled one. Rows of other
    components go on to the next portions: a link between two settled rows tells nothing new, and one between a settled
    row and another is found by the other.
    """
    seen, portions = _portions(_visits(core, eps).select("pattern", "bucket", "row_key", "vec"))
    seen = cut(seen)
    every = cut(_homes(core, eps).select("pattern", "bucket", "row_key", "vec", "eps"))
    left, known, anchors = every, None, None
    for portion in range(portions):
        links = compare_tiles(
            left, seen.filter(F.col("portion") == portion).drop("portion"), ["pattern", "bucket"], _link, "pattern string, a long, b long"
        )
        if known is not None:
            links = links.unionByName(known)
        roots = cut(components(cut(links.distinct()), ["pattern"]))
        known = roots.select("pattern", F.col("node").alias("a"), F.col("root").alias("b"))
        if portion + 1 == portions:
            break
        if anchors is None:  # one row per pattern: a row of its settled component, which only grows
            sizes = roots.groupBy("pattern", "root").count()
            anchors = cut(sizes.groupBy("pattern").agg(F.max_by("root", F.struct("count", "root")).alias("anchor")))
        settled = roots.join(F.broadcast(anchors), "pattern")
        at = F.broadcast(settled.filter(F.col("node") == F.col("anchor")).select("pattern", F.col("root").alias("_at")))
        settled = roots.join(at, "pattern").filter(F.col("root") == F.col("_at")).select("pattern", F.col("node").alias("row_key"))
        left = cut(every.join(settled, ["pattern", "row_key"], "left_anti"))
    return roots


def dbscan(vectors: DataFrame, params: Params) -> DataFrame:
    """Density clusters of weighted distinct vectors per pattern: adds ``label`` (-1 is noise) and ``core``.

    A row is core when at least ``min_samples`` rows (itself counted) lie within ``eps``. Clusters are numbered by
    their first core row; a border row joins the lowest-numbered cluster that reaches it.
    """
    eps, least = _param(params, 0), _param(params, 1)
    rows = vectors.filter(F.col("pattern").isin(list(params))).withColumn("eps", eps.cast("double"))
    rows = rows.withColumn("least", least.cast("long")).withColumn("cell", _cell(F.col("eps")))
    crowds = rows.groupBy("pattern", "cell").agg(F.sum("weight").alias("crowd"))
    rows = cut(
        rows.join(crowds, ["pattern", "cell"]).withColumn("dense", F.col("crowd") >= F.col("least")).drop("cell", "crowd")
    )
    e = F.col("eps")
    # A crowded cell makes its rows core without any comparison; only the others count neighbours.
    light = _sparse_rows(rows, e)
    marked = rows.join(light.select("pattern", "row_key", "near"), ["pattern", "row_key"], "left")
    found = F.col("row_key").isNotNull() & F.col("near").isNull()
    rows = cut(marked.withColumn("core", F.col("dense") | found).drop("least", "dense", "near"))
    core = rows.filter("core").drop("core")
    of_core = cut(
        core.select("pattern", "row_key")
        .join(_core_roots(core, e).withColumnRenamed("node", "row_key"), ["pattern", "row_key"], "left")
        .withColumn("root", F.coalesce("root", "row_key"))
    )
    # A row that is not core has fewer than ``min_samples`` neighbours, so its links are a handful.
    reach = light.select("pattern", "row_key", F.explode("links").alias("b"))
    of_border = reach.join(of_core.withColumnRenamed("row_key", "b"), ["pattern", "b"]).groupBy("pattern", "row_key").agg(
        F.min("root").alias("root")
    )
    # One row per cluster reaches this window.
    numbers = of_core.select("pattern", "root").distinct().withColumn(
        "label", (F.row_number().over(W.partitionBy("pattern").orderBy("root")) - 1).cast("int")
    )
    members = of_core.unionByName(of_border).join(numbers, ["pattern", "root"]).drop("root")
    return rows.drop("eps").join(members, ["pattern", "row_key"], "left").withColumn(
        "label", F.coalesce("label", F.lit(-1))
    )


def label_days(days: DataFrame, labelled: DataFrame, columns: list[str] = ["label"]) -> DataFrame:
    """Carry results of distinct vectors back to every day with that vector.

    A vector shared by very many days is a skewed key; the right side has one row per vector, and the adaptive
    skew join splits the left side.
    """
    return days.join(labelled.select("pattern", "vec", *columns), ["pattern", "vec"])


def cluster_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("pattern", "label").agg(F.sum("weight").alias("n"))


def coverage(labelled: DataFrame) -> DataFrame:
    """Rows inside clusters and their share, with the coverage gate."""
    inside = F.sum(F.when(F.col("label") >= 0, F.col("weight")).otherwise(0))
    return (
        labelled.groupBy("pattern")
        .agg(inside.alias("clustered"), (inside / F.sum("weight")).alias("coverage"))
        .withColumn("covered", F.col("coverage") >= MIN_COVERAGE)
    )


class _Side:
    """A tile of the silhouette, with what its comparisons share; rows of a cluster lie together."""

    def __init__(self, tile: dict) -> None:
        self.x, self.weight = tile["vec"], tile["weight"].astype(float)
        self.labels, self.label = np.unique(tile["label"], return_inverse=True)
        self.square, self.used = (self.x * self.x).sum(1), self.x != 0
        self.users = [np.flatnonzero(u) for u in self.used.T]
        ones = np.ones((len(self.x), 1))
        # Squared distances as one product: |x|^2 + |y|^2 - 2xy.
        self.row = np.hstack([self.x, self.square[:, None], ones])
        self.column = np.hstack([-2.0 * self.x, ones, self.square[:, None]])
        self.mark = self.used.astype(np.float32)

    def add(self, sums: np.ndarray, rows, of: np.ndarray, table: np.ndarray) -> None:
        """Adds the columns of ``table``, its rows being ``of`` this tile, weighted and by cluster, to ``sums[rows]``."""
        label, weight = self.label[of], self.weight[of]
        first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        if len(first) == 1:
            sums[rows, label[0]] += weight @ table
        else:
            at = np.arange(len(sums))[rows]
            sums[at[:, None], label[first][None, :]] += np.add.reduceat(weight[:, None] * table, first, axis=0).T


def _root_sums(nodes: np.ndarray, side: _Side) -> np.ndarray:
    """Per cluster of ``side`` the weighted sum of the root of each node plus a row's square."""
    first = np.flatnonzero(np.r_[True, side.label[1:] != side.label[:-1]])
    return np.add.reduceat(np.sqrt(nodes[:, None] + side.square) * side.weight, first, axis=1)


def _apart_sums(one: _Side, other: _Side) -> np.ndarray:
    """Weighted distance of each row to each cluster of the other tile as if no slot were used by both.

    The distance is then the root of the sum of both squares, so the sums are a smooth function of a row's square. It is
    taken at ``NODES`` Chebyshev points and interpolated, which is exact to rounding where the squares differ by a factor
    of ``REACH`` at most; else every row is a node of its own.
    """
    low, high = min(one.square.min(), other.square.min()), max(one.square.max(), other.square.max())
    if len(one.square) <= NODES or not 0 < high <= REACH * low:
        return np.vstack([_root_sums(one.square[k : k + STRIP], other) for k in range(0, len(one.square), STRIP)])
    turn = (np.arange(NODES) + 0.5) * np.pi / NODES
    middle, half = (high + low) / 2, max((high - low) / 2, 1e-12)
    values = _root_sums(middle + half * np.cos(turn), other)
    terms = np.cos(np.outer(np.arange(NODES), turn)) @ values * (2.0 / NODES)
    terms[0] /= 2
    return np.cos(np.outer(np.arccos(np.clip((one.square - middle) / half, -1, 1)), np.arange(NODES))) @ terms


def _distance_table(a: _Side, b: _Side, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    d = a.row[rows] @ b.column[columns].T
    if d.min() < 1e-6:  # the product loses digits here, differences don't
        near = np.argwhere(d < 1e-6)
        diff = a.x[rows[near[:, 0]]] - b.x[columns[near[:, 1]]]
        d[near[:, 0], near[:, 1]] = (diff * diff).sum(1)
    return np.sqrt(d, out=d)


def _distance_sums(key, left: dict, right: dict) -> list[tuple]:
    """(clusters, weighted distance of each row to them) of both tiles; a few rows of distances exist at a time.

    Most days share no slot, and the distance of two such days depends on their squares only. So all rows are summed as
    if they were apart, and only rows that use the same slot are compared; a pair with several such slots counts in
    parts. Tiles in which most pairs share a slot are compared row by row.
    """
    same = left is right
    a = _Side(left)
    b = a if same else _Side(right)
    met = sum(len(u) * len(v) for u, v in zip(a.users, b.users))
    if met > len(a.x) * len(b.x) / 2 or not (np.isfinite(a.square).all() and np.isfinite(b.square).all()):
        to_right, to_left = np.zeros((len(a.x), len(b.labels))), np.zeros((len(b.x), len(a.labels)))
        blocks = [(np.arange(len(a.x)), np.arange(len(b.x)))]
    else:
        to_right, to_left = _apart_sums(a, b), None if same else _apart_sums(b, a)
        blocks = list(zip(a.users, b.users))
    whole = len(blocks) == 1
    for over, across in blocks:
        for i in range(0, len(over), STRIP):
            rows = over[i : i + STRIP]
            for j in range(0, len(across), COLUMNS):
                columns = across[j : j + COLUMNS]
                d = _distance_table(a, b, rows, columns)
                if not whole:
                    d -= np.sqrt(a.square[rows][:, None] + b.square[columns])
                    d /= a.mark[rows] @ b.mark[columns].T
                b.add(to_right, rows, columns, d.T)
                if not same:
                    a.add(to_left, columns, rows, d)
    return [(b.labels, to_right)] if same else [(b.labels, to_right), (a.labels, to_left)]


def _summed(key, tile: dict, added) -> pd.DataFrame:
    """Rows of a tile with their distances to each cluster over all tiles."""
    totals: dict[int, np.ndarray] = {}
    for labels, sums in added:
        for label, total in zip(labels.tolist(), sums.T):
            totals[label] = totals[label] + total if label in totals else total
    parts = [pd.DataFrame({"row_key": tile["row_key"], "other": label, "total": total}) for label, total in totals.items()]
    return pd.concat(parts).assign(pattern=key[0])[["pattern", "row_key", "other", "total"]]


def silhouette_samples(labelled: DataFrame) -> DataFrame:
    """Euclidean silhouette of each distinct clustered vector; noise is left out, one cluster gives 0.

    Only patterns with several clusters are compared: without another cluster the score is 0 whatever the distances.
    """
    every = labelled.filter("label >= 0")
    clusters = cut(every.groupBy("pattern").agg(F.countDistinct("label").alias("_n")))  # one row per pattern
    alone = every.join(F.broadcast(clusters.filter("_n = 1")), "pattern", "left_semi").filter("row_key is not null")
    rows = every.join(F.broadcast(clusters.filter("_n > 1")), "pattern", "left_semi")
    sums = compare_within(
        rows.select("pattern", "row_key", "vec", "weight", "label"),
        ["pattern"],
        _distance_sums,
        "pattern string, row_key long, other int, total double",
        merge=_summed,
        order="label",
    ).groupBy("pattern", "row_key", "other").agg(F.sum("total").alias("total"))
    sizes = rows.groupBy("pattern", F.col("label").alias("other")).agg(F.sum("weight").alias("size"))
    own = F.col("label") == F.col("other")
    mean = F.when(own, F.col("total") / (F.col("size") - 1)).otherwise(F.col("total") / F.col("size"))
    ab = (
        sums.join(sizes, ["pattern", "other"])
        .join(rows.select("pattern", "row_key", "label", "weight"), ["pattern", "row_key"])
        .withColumn("mean", F.when(own & (F.col("size") == 1), F.lit(None)).otherwise(mean))
        .groupBy("pattern", "row_key", "label", "weight")
        .agg(F.max(F.when(own, F.col("mean"))).alias("a"), F.min(F.when(~own, F.col("mean"))).alias("b"))
    )
    top = F.greatest("a", "b")
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    keys = ["pattern", "row_key", "label", "weight"]
    zero = alone.select(*keys).distinct().withColumn("silhouette", F.lit(0.0))
    return ab.select(*keys, s.alias("silhouette")).unionByName(zero)


def silhouette_by_cluster(samples: DataFrame) -> DataFrame:
    """Mean silhouette per cluster with its rank, best first."""
    mean = F.sum(F.col("silhouette") * F.col("weight")) / F.sum("weight")
    per = samples.groupBy("pattern", "label").agg(mean.alias("silhouette"), F.sum("weight").alias("n"))
    rank = F.row_number().over(W.partitionBy("pattern").orderBy(F.round("silhouette", 6).desc(), "label"))
    return per.withColumn("rank", rank)


def silhouette_overall(samples: DataFrame) -> DataFrame:
    mean = F.sum(F.col("silhouette") * F.col("weight")) / F.sum("weight")
    return samples.groupBy("pattern").agg(mean.alias("silhouette"))


def _cells(rows: DataFrame, level: int) -> DataFrame:
    """Weighted cells of each cluster: (pattern, label, weight, centre, var, row_key), finer with every level.

    The first level parts vectors by the slot of their maximum, the next by their used slots, then by ever finer steps
    of their values, and on the last level a cell is one vector.
    """
    if level >= LAST_LEVEL:
        cells = rows.select("pattern", "label", "weight", F.col("vec").alias("centre"), F.lit(0.0).alias("var"), "row_key")
        return cells.withColumn("weight", F.col("weight").cast("double"))
    if level == 0:
        cell = F.array(F.array_position("vec", F.array_max("vec")).cast("int"))
    else:
        step = 2 ** (level - 1)
        cell = F.transform("vec", lambda x: F.when(x == 0, F.lit(-1)).otherwise(F.floor(x * step).cast("int")))
    w, slots = F.col("weight"), range(A.SLOTS)
    sums = rows.groupBy("pattern", "label", cell.alias("_cell")).agg(
        F.sum(w).cast("double").alias("weight"), F.array(*[F.sum(w * F.col("vec")[i]) for i in slots]).alias("_sum"),
        F.sum(w * A.dot(F.col("vec"), F.col("vec"))).alias("_squares"), F.min("row_key").alias("row_key"),
    )
    centre = F.transform("_sum", lambda x: x / F.col("weight"))
    out = sums.withColumn("centre", centre)
    var = F.greatest(F.col("_squares") / F.col("weight") - A.dot(F.col("centre"), F.col("centre")), F.lit(0.0))
    return out.select("pattern", "label", "weight", "centre", var.alias("var"), "row_key")


def _bounded_sums(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Per row and cluster the least and greatest weighted distance to the cells of the other tile.

    The mean distance to a cell's members is at least the distance to their centre, and at most the root of the mean
    squared distance, which is the squared distance to the centre plus the variance.
    """
    if not len(left) or not len(right):
        return pd.DataFrame({"pattern": [], "row_key": [], "other": [], "lo": [], "hi": []})
    d, w = distances(matrix(left["vec"]), matrix(right["centre"])), right["weight"].to_numpy()
    far = np.sqrt(d * d + right["var"].to_numpy())
    parts = []
    for label in np.unique(right["label"]):
        mask = (right["label"] == label).to_numpy()
        parts.append(
            pd.DataFrame(
                {"row_key": left["row_key"], "other": int(label), "lo": d[:, mask] @ w[mask], "hi": far[:, mask] @ w[mask]}
            )
        )
    return pd.concat(parts).assign(pattern=key[0])[["pattern", "row_key", "other", "lo", "hi"]]


def silhouette_interval(labelled: DataFrame, level: int) -> tuple[DataFrame, int]:
    """((pattern, low, high), compared pairs): bounds of the weighted mean silhouette from cells of this level."""
    rows = labelled.filter("label >= 0")
    cells = cut(_cells(rows, level))
    pairs = rows.groupBy("pattern").count().join(cells.groupBy("pattern").agg(F.count("*").alias("cells")), "pattern")
    compared = pairs.agg(F.sum(F.col("count") * F.col("cells"))).first()[0] or 0
    sums = compare_tiles(
        rows.select("pattern", "row_key", "vec"), cells, ["pattern"], _bounded_sums, "pattern string, row_key long, other int, lo double, hi double"
    ).groupBy("pattern", "row_key", "other").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    sizes = rows.groupBy("pattern", F.col("label").alias("other")).agg(F.sum("weight").alias("size"))
    own = F.col("label") == F.col("other")
    both = sums.join(sizes, ["pattern", "other"]).join(rows.select("pattern", "row_key", "label", "weight"), ["pattern", "row_key"])

    def mean(total: str) -> Column:
        inside = F.when(F.col("size") > 1, F.col(total) / (F.col("size") - 1))
        return F.when(own, inside).otherwise(F.col(total) / F.col("size"))

    ab = both.withColumn("lo", mean("lo")).withColumn("hi", mean("hi")).groupBy("pattern", "row_key", "weight").agg(
        F.max(F.when(own, F.col("lo"))).alias("a_lo"), F.max(F.when(own, F.col("hi"))).alias("a_hi"),
        F.min(F.when(~own, F.col("lo"))).alias("b_lo"), F.min(F.when(~own, F.col("hi"))).alias("b_hi"),
    )

    def score(a: str, b: str) -> Column:
        top = F.greatest(a, b)
        return F.when(F.col(a).isNull() | F.col(b).isNull() | (top == 0), 0.0).otherwise((F.col(b) - F.col(a)) / top)

    weight = F.sum("weight")
    low, high = (F.sum(score(a, b) * F.col("weight")) / weight for a, b in (("a_hi", "b_lo"), ("a_lo", "b_hi")))
    return ab.groupBy("pattern").agg(low.alias("low"), high.alias("high")), compared


def gate_by_interval(labelled: DataFrame, log: list[tuple] | None = None) -> DataFrame:
    """The verdict of ``cluster_gate`` from bounds of the silhouette, (pattern, clustered, coverage, low, high, passed).

    Cells get finer only for the patterns whose bounds still hold the limit between them; patterns that miss the
    coverage have their verdict without any comparison. The last level compares exactly. ``log`` receives
    (level, patterns, compared pairs).
    """
    stats = coverage(labelled).collect()  # one row per pattern
    found = {r["pattern"]: (None, None, False) for r in stats}
    open_ = sorted(r["pattern"] for r in stats if r["covered"])
    for level in range(LAST_LEVEL + 1):
        if not open_:
            break
        bounds, compared = silhouette_interval(labelled.filter(F.col("pattern").isin(open_)), level)
        if log is not None:
            log.append((level, tuple(open_), compared))
        for r in bounds.collect():
            if level == LAST_LEVEL:  # exact up to rounding: rounded as the exact form is
                mean = round((r["low"] + r["high"]) / 2, 6)
                found[r["pattern"]] = (mean, mean, mean >= MIN_SILHOUETTE)
            elif r["low"] > MIN_SILHOUETTE + 1e-6 or r["high"] < MIN_SILHOUETTE - 1e-6:
                found[r["pattern"]] = (r["low"], r["high"], r["low"] > MIN_SILHOUETTE)
            else:
                continue
            open_.remove(r["pattern"])
    rows = [(r["pattern"], r["clustered"], r["coverage"], *found[r["pattern"]]) for r in stats]
    return labelled.sparkSession.createDataFrame(rows, "pattern string, clustered long, coverage double, low double, high double, passed boolean")


def squared_silhouette(labelled: DataFrame, pattern: str) -> float:
    """Silhouette under squared distance, computed from cluster sums in linear time.

    A different measure than ``silhouette_overall``; for tables too large for the exact form.
    """
    rows = labelled.filter((F.col("pattern") == pattern) & (F.col("label") >= 0)).select(
        array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("prediction"), F.col("weight").cast("double").alias("w")
    )
    if rows.select("prediction").distinct().limit(2).count() < 2:
        return 0.0
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean", weightCol="w").evaluate(rows)


def best_cluster(by_cluster: DataFrame) -> DataFrame:
    return by_cluster.filter("rank = 1").select("pattern", "label", "silhouette", "n")


def next_params(eps: float, least: int, outcome: str, silhouette_ok: bool = True, covered_ok: bool = True) -> tuple[float, int]:
    """Parameters of the next try after a failed one."""
    if outcome == "no_clusters":
        return min(eps * 1.2, EPS_RANGE[1]), least
    if not silhouette_ok:
        if least < MIN_SAMPLES_RANGE[1]:
            least += 1
        else:
            eps = max(eps * 0.9, EPS_RANGE[0])
    if not covered_ok:
        eps = min(eps * 1.1, EPS_RANGE[1])
        least = max(least - 1, MIN_SAMPLES_RANGE[0])
    return eps, least


def sweep(vectors: DataFrame, tries: int = TRIES, small: int = SMALL_INPUT) -> tuple[DataFrame, list[tuple]]:
    """Cluster every pattern until its gates pass, adjusting its parameters between tries.

    All patterns still open are clustered in the same jobs; the driver sees one row of gate values per pattern and
    try. After the last try one more run with the adjusted parameters is kept with status ``warning``. The log marks
    patterns with fewer than ``small`` rows; they are clustered like all others. Returns the labels and the log of tries.
    """
    vectors = cut(vectors)
    log: list[tuple] = []
    sizes = {r["pattern"]: r["n"] for r in vectors.groupBy("pattern").agg(F.sum("weight").alias("n")).collect()}
    open_: Params = {p: (EPS, MIN_SAMPLES) for p in sizes}
    done: list[DataFrame] = []
    for attempt in range(1, tries + 2):
        if not open_:
            break
        labelled = cut(dbscan(vectors, open_))
        scores = silhouette_overall(silhouette_samples(labelled))
        stats = cluster_gate(coverage(labelled).join(scores, "pattern", "left"))
        left: Params = {}
        closed = []
        for r in stats.collect():
            p = r["pattern"]
            eps, least = open_[p]
            last = attempt > tries
            status = "success" if r["passed"] and not last else "warning" if last else "retry"
            if last and r["clustered"] == 0:
                status = "error"
            log.append((p, attempt, eps, least, r["silhouette"], r["coverage"], r["clustered"], status, sizes[p] < small))
            if status == "retry":
                outcome = "no_clusters" if r["clustered"] == 0 else "clusters"
                left[p] = next_params(eps, least, outcome, r["silhouette_ok"], r["covered_ok"])
            else:
                closed.append(p)
        if closed:
            done.append(
                labelled.filter(F.col("pattern").isin(closed)).select("pattern", "vec", "weight", "row_key", "label")
            )
        open_ = left
    labels = vectors.select("pattern", "vec", "weight", "row_key", F.lit(-1).alias("label")).limit(0)
    for df in done:
        labels = labels.unionByName(df)
    return labels, log


SWEEP_SCHEMA = "pattern string, attempt int, eps double, min_samples int, silhouette double, coverage double, clustered long, status string, small boolean"


def _short_sums(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Weighted warping distance of each short form to the forms of the other tile."""
    d = dtw_by_length(left["short"].tolist(), right["short"].tolist())
    out = [pd.DataFrame({"row_key": left["row_key"], "low": d @ right["weight"].to_numpy()})]
    if key[1] != key[2]:
        out.append(pd.DataFrame({"row_key": right["row_key"], "low": d.T @ left["weight"].to_numpy()}))
    return pd.concat(out).assign(pattern=key[0])[["pattern", "row_key", "low"]]


def _dtw_sums(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Weighted warping distance of each row to the members of the other tile."""
    if not len(left) or not len(right):
        return pd.DataFrame({"pattern": [], "row_key": [], "total": []})
    total = dtw_table(matrix(left["vec"]), matrix(right["vec"])) @ right["weight"].to_numpy()
    return pd.DataFrame({"pattern": key[0], "row_key": left["row_key"], "total": total})


def medoids(labelled: DataFrame, best: DataFrame, tile: int = 512, log: list[tuple] | None = None) -> DataFrame:
    """Most representative day of each pattern: smallest mean warping distance inside the best cluster.

    The distances of the short forms, equal ones taken once, give every member a lower bound of its sum. The members of
    the lowest bounds are compared with all members; then all those whose bound is not above the best sum found. The
    others can't be the representative. Ties go to the first row. ``log`` receives (members, members compared in full).
    """
    members = labelled.join(F.broadcast(best.select("pattern", "label")), ["pattern", "label"], "left_semi")
    members = cut(members.select("pattern", "row_key", "vec", "weight", short_form(F.col("vec")).alias("short")))
    forms = cut(members.groupBy("pattern", "short").agg(F.sum("weight").alias("weight"), F.min("row_key").alias("row_key")))
    bounds = compare_within(forms, ["pattern"], _short_sums, "pattern string, row_key long, low double", tile=4 * tile)
    bounds = bounds.groupBy("pattern", "row_key").agg(F.sum("low").alias("low"))
    bounds = forms.drop("weight").join(bounds, ["pattern", "row_key"]).drop("row_key")
    size = members.groupBy("pattern").agg(F.sum("weight").alias("n"))
    bounded = cut(members.join(bounds, ["pattern", "short"]).join(size, "pattern").drop("short"))
    right = bounded.select("pattern", "row_key", "vec", "weight")

    def totals(rows: DataFrame) -> DataFrame:
        found = compare_tiles(
            rows.select("pattern", "row_key", "vec"), right, ["pattern"], _dtw_sums, "pattern string, row_key long, total double", tile=tile
        )
        return cut(found.groupBy("pattern", "row_key").agg(F.sum("total").alias("total")))

    rank = F.row_number().over(W.partitionBy("pattern").orderBy("low", "row_key"))
    first = cut(bounded.withColumn("_r", rank).filter(F.col("_r") <= FIRST_COMPARED).drop("_r"))
    sums = totals(first)
    least = sums.groupBy("pattern").agg(F.min("total").alias("least"))  # one row per pattern
    # Means are compared to nine digits, so the bound has to miss the best sum by more than that.
    open_ = bounded.join(F.broadcast(least), "pattern").filter(F.col("low") <= F.col("least") * (1 + 1e-9) + F.col("n") * 2e-9)
    sums = sums.unionByName(totals(open_.join(first.select("pattern", "row_key"), ["pattern", "row_key"], "left_anti")))
    if log is not None:
        log.append((bounded.count(), sums.count()))
    mean = sums.join(size, "pattern").withColumn("mean_dtw", F.round(F.col("total") / F.col("n"), 9))
    pick = mean.groupBy("pattern").agg(
        F.min_by(F.struct("row_key", "mean_dtw"), F.struct("mean_dtw", "row_key")).alias("m")
    )
    found = pick.select("pattern", "m.row_key", "m.mean_dtw")
    return found.join(right, ["pattern", "row_key"]).select("pattern", "row_key", "vec", "mean_dtw")


def warping_distances(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Plain and cumulative warping distance of each vector to its pattern's representative."""
    # One representative per named pattern.
    c = centres.select("pattern", F.col("vec").alias("_c"))
    return (
        vectors.join(F.broadcast(c), "pattern")
        .withColumn("dtw_plain", dtw_distance("vec", "_c"))
        .withColumn("dtw_cum", dtw_cumulative_distance("vec", "_c"))
        .drop("_c")
    )


def warping_outliers(vectors: DataFrame, centres: DataFrame, factor: float = FENCE_FACTOR) -> DataFrame:
    """Flag vectors whose cumulative distance lies above the fence of all days (weighted quartiles)."""
    d = cut(warping_distances(vectors, centres))
    return evaluate.flag_outliers(d, "dtw_cum", ["pattern"], factor, weight="weight")


def percentile_outliers(scored: DataFrame, value: str = "dtw_cum", q: float = 0.95) -> DataFrame:
    """Alternative rule: above the ``q`` percentile of all days."""
    limit = evaluate.quantiles(scored, value, ["pattern"], {"limit": q}, weight="weight")
    return scored.join(limit, "pattern").withColumn("outlier", F.col(value) > F.col("limit"))


def keep_inliers(days: DataFrame, flagged: DataFrame) -> DataFrame:
    """Days (with their original values) whose normalised vector is not an outlier."""
    good = flagged.filter("not outlier").select("pattern", "vec")
    inliers = normalised(days).select(*DAY, "vec").join(good, ["pattern", "vec"], "left_semi").select(*DAY)
    return days.join(inliers, DAY, "left_semi")


def compactness(labelled: DataFrame, flagged: DataFrame) -> DataFrame:
    """Checks of each cluster: mean warping distance at most half of the overall mean, outlier share at most 20 %,
    at least 100 rows."""
    both = labelled.select("pattern", "row_key", "label").join(
        flagged.select("pattern", "row_key", "weight", "dtw_cum", "outlier"), ["pattern", "row_key"]
    )
    w = F.col("weight")
    overall = both.groupBy("pattern").agg((F.sum(F.col("dtw_cum") * w) / F.sum(w)).alias("overall"))
    per = both.filter("label >= 0").groupBy("pattern", "label").agg(
        (F.sum(F.col("dtw_cum") * w) / F.sum(w)).alias("mean_dtw"),
        (F.sum(F.when(F.col("outlier"), w).otherwise(0)) / F.sum(w)).alias("outlier_share"),
        F.sum(w).alias("n"),
    )
    return per.join(overall, "pattern").select(
        "pattern", "label", "n", "mean_dtw", "outlier_share",
        (F.col("mean_dtw") <= 0.5 * F.col("overall")).alias("compact_ok"),
        (F.col("outlier_share") <= 0.2).alias("outliers_ok"),
        (F.col("n") >= 100).alias("size_ok"),
    )


def residual_rounds(vectors: DataFrame, rounds: int = 5, least_share: float = 0.05, least_silhouette: float = 0.5) -> DataFrame:
    """Cluster, set the warping outliers and the noise aside, and cluster those again.

    A pattern stops when fewer than ``least_share`` of its rows are left over or its silhouette drops below
    ``least_silhouette``. Each row gets the round and label it was settled in; rows never settled keep label -1.
    """
    rest = cut(vectors)
    sizes = {r["pattern"]: r["n"] for r in rest.groupBy("pattern").agg(F.sum("weight").alias("n")).collect()}
    out: DataFrame | None = None
    for number in range(1, rounds + 1):
        open_ = sorted(sizes)
        if not open_:
            break
        labelled = cut(dbscan(rest, {p: (EPS, MIN_SAMPLES) for p in open_}))
        samples = silhouette_samples(labelled)
        best = best_cluster(silhouette_by_cluster(samples))
        flagged = warping_outliers(labelled, cut(medoids(labelled, best)))
        # Patterns without a cluster have no representative; all their rows stay unsettled.
        state = labelled.join(flagged.select("pattern", "row_key", "outlier"), ["pattern", "row_key"], "left").withColumn(
            "settled", (F.col("label") >= 0) & ~F.coalesce("outlier", F.lit(True))
        )
        state = cut(state.select("pattern", "vec", "weight", "row_key", "label", "settled"))
        left = F.sum(F.when(~F.col("settled"), F.col("weight")).otherwise(0)).alias("left")
        stats = state.groupBy("pattern").agg(left).join(silhouette_overall(samples), "pattern", "left").collect()
        final = [
            r["pattern"]
            for r in stats
            if number == rounds
            or r["left"] < least_share * sizes[r["pattern"]]
            or r["silhouette"] is None
            or r["silhouette"] < least_silhouette
        ]
        done = state.filter(F.col("settled") | F.col("pattern").isin(final)).select(
            "pattern", "vec", "weight", "row_key", "label", F.lit(number).alias("round")
        )
        out = done if out is None else out.unionByName(done)
        rest = cut(state.filter(~F.col("settled") & ~F.col("pattern").isin(final)).select("pattern", "vec", "weight", "row_key"))
        sizes = {p: n for p, n in sizes.items() if p not in final}
    return out
