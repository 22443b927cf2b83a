"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are binned at quantiles; each tree is grown level by level from histograms of gradients. The fitted trees
are flattened into arrays, and a batch of texts walks all of them with one vectorised step per level.

The trees are fitted on at most ``MAX_TRAIN`` labelled rows, drawn by a hash of the id: a documented bound, since a few
thousand labels settle a few hundred splits. Everything else covers every row.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from dripline.llm.catalog import query
from dripline.llm.common import bucket, by_offsets, per_text, table

#: Most labelled rows that trees are fitted on.
MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE, L2, MIN_ROWS = 60, 4, 64, 0.2, 1.0, 10
FOLDS, HELD_OUT = 3, 1

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digits", "non_ascii", "spaces", "stops", "commas",
    "exclaims", "symbols", "other_marks", "distinct_words", "distinct_pairs", "top_word", "repeats", "doubled_marks",
    "log_lines", "words_per_line", "repeated_lines", "open_lines", "short_words",
)

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digits": b"0123456789", "spaces": b" \t\n\v\f\r",
    "stops": b".", "commas": b",", "exclaims": b"!?", "symbols": b"#*$%&|<>",
}


def _byte_table() -> np.ndarray:
    kinds = np.full(256, len(_CLASSES), dtype=np.int8)
    for i, members in enumerate(_CLASSES.values()):
        kinds[list(members)] = i
    kinds[128:] = len(_CLASSES) + 1
    return kinds


_KIND = _byte_table()


def _class_counts(texts: list[bytes]) -> np.ndarray:
    """Bytes of each class, other ASCII and non-ASCII in each text."""
    kinds = _KIND[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.stack([by_offsets(kinds == k, starts) for k in range(len(_CLASSES) + 2)], axis=1)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``FEATURES`` per text; empty texts give zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    if not texts:
        return out
    classes = _class_counts(texts)
    upper, lower, digits, spaces, stops, commas, exclaims, symbols, marks, wide = classes.T
    for row, text, c in zip(out, texts, wide):
        size, words = max(len(text), 1), text.split()
        n, lines = len(words), [x for x in text.split(b"\n") if x and not x.isspace()]
        if not n:
            continue
        sizes = [*map(len, words)]
        row[:4] = np.log1p(len(text)), np.log1p(n), sum(sizes) / n, max(sizes)
        row[13] = len(set(words)) / n
        row[14] = len(set(zip(words, words[1:]))) / max(n - 1, 1)
        row[15] = Counter(words).most_common(1)[0][1] / n
        row[16] = sum(map(eq, words, words[1:])) / n
        row[17] = (text.count(b"!!") + text.count(b"??")) / n
        row[18:20] = np.log1p(len(lines)), n / max(len(lines), 1)
        row[20] = 1 - len(set(lines)) / max(len(lines), 1)
        row[21] = sum(not x.endswith((b".", b"!", b"?")) for x in lines) / max(len(lines), 1)
        row[22] = sum(s <= 3 for s in sizes) / n
    total = np.maximum(classes.sum(1), 1)
    out[:, 4] = upper / np.maximum(upper + lower, 1)
    for k, values in zip((5, 6, 7, 8, 9, 10, 11, 12), (digits, wide, spaces, stops, commas, exclaims, symbols, marks)):
        out[:, k] = values / total
    return out


@dataclass
class Trees:
    """All trees in one set of arrays: node ``i`` sends a row left if ``x[feature[i]] <= cut[i]``; leaves stay put."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE
) -> Trees:
    """Boosting for the log loss. Without rows, or with one class only, the trees are a constant."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    nodes: list[list] = []  # feature, cut, left, right, value
    roots = []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else []
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1) if len(x) else None
    raw = np.full(len(y), np.log(share / (1 - share)))
    if 0 < y.sum() < len(y):
        flat = binned + np.arange(x.shape[1]) * bins
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-raw))
            grad, hess = p - y, p * (1 - p)
            roots.append(len(nodes))
            raw += _grow(nodes, np.arange(len(y)), flat, binned, cuts, grad, hess, depth, bins, rate)
    if not nodes:
        nodes, roots = [[0, 0.0, 0, 0, 0.0]], [0]
    columns = [np.array(c) for c in zip(*nodes)]
    return Trees(*columns, np.array(roots), depth, float(np.log(share / (1 - share))))


def _grow(nodes, start, flat, binned, cuts, grad, hess, depth, bins, rate) -> np.ndarray:
    """Append one tree to ``nodes``; returns what it adds to each row."""
    width = binned.shape[1]
    added = np.zeros(len(binned))
    root = len(nodes)
    nodes.append([0, 0.0, root, root, 0.0])
    level = [(root, start)]
    for d in range(depth + 1):
        below = []
        for at, rows in level:
            g, h = grad[rows].sum(), hess[rows].sum()
            nodes[at][4] = -rate * g / (h + L2)
            split = None
            if d < depth and len(rows) >= 2 * MIN_ROWS:
                index = flat[rows].ravel()
                shape = (width, bins)
                sums = [
                    np.bincount(index, np.repeat(v[rows], width), width * bins).reshape(shape).cumsum(1) for v in (grad, hess)
                ]
                count = np.bincount(index, minlength=width * bins).reshape(shape).cumsum(1)
                gain = sums[0] ** 2 / (sums[1] + L2) + (g - sums[0]) ** 2 / (h - sums[1] + L2) - g * g / (h + L2)
                gain[(count < MIN_ROWS) | (len(rows) - count < MIN_ROWS)] = 0
                f, b = np.unravel_index(np.argmax(gain), shape)
                if gain[f, b] > 1e-9 and b < len(cuts[f]):
                    split = f, b
            if split is None:
                added[rows] = nodes[at][4]
                continue
            f, b = split
            side = binned[rows, f] <= b
            left = len(nodes)
            nodes += [[0, 0.0, left, left, 0.0], [0, 0.0, left + 1, left + 1, 0.0]]
            nodes[at][:4] = [int(f), float(cuts[f][b]), left, left + 1]
            below += [(left, rows[side]), (left + 1, rows[~side])]
        level = below
    return added


def train(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    max_train: int = MAX_TRAIN,
) -> Trees:
    """Trees for ``label_col``, learned from the rows outside the held-out fold.

    Several labels of one id count as their mean, ties as 1; null labels and ids are left out.
    """
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (bucket(id_col, FOLDS) != HELD_OUT))
        .groupBy(id_col)
        .agg((F.avg(label_col) >= 0.5).cast("double").alias("_label"))
    )
    # The hash takes a little less than the bound, so that the limit behind it hardly ever cuts.
    share = min(1.0, 0.95 * max_train / max(known.count(), 1))
    drawn = known.filter(F.pmod(F.xxhash64(id_col, F.lit("draw")), F.lit(1 << 30)) < int(share * (1 << 30))).limit(max_train)
    texts = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(drawn), id_col).limit(max_train)
    rows = per_text(texts, lambda t: [statistics(t).tolist()], "x array<double>", text_col, ["_label"]).select("row._label", "x")
    got = rows.toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    order = np.lexsort([*x.T, got["_label"].to_numpy()]) if len(got) else []  # the order of arrival must not matter
    return fit_trees(x[order], got["_label"].to_numpy(dtype=float)[order])


def score(docs: DataFrame, trees: Trees, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, score, predicted) of every row by its whole text.

    Null counts as empty, and empty texts get the score of their statistics (zeros); repeated rows get equal scores;
    an empty table gives an empty result.
    """
    out = per_text(docs, lambda t: [trees.score(statistics(t))], "score double", text_col, carry)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, trees: Trees) -> DataFrame:
    """The documents predicted to be good, with the columns of ``docs``."""
    return score(docs, trees).filter("predicted = 1").select("row.*")


@query("op3_quality_trees")
def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    held = (bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return out.select("row.doc_id", "score", "predicted").select("doc_id", held, "score", "predicted")
