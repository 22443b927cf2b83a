"""Near-duplicates by chosen paths: a set similarity join over randomly branching trees.

Each distinct shingle set has a sketch of minwise tokens. A tree sends a document down the tokens it selects: the root
of each tree selects one position of the sketch, deeper nodes select positions at random, and documents with the same
token at a selected position meet in a child. Two documents stay together with a chance that grows with their
similarity; independent trees repeat the draw.

Pairs are compared by sketch, pairs that may be similar by their full sets, and no pair list leaves a node. First every
document names its smallest likely partner; nodes of many documents do this stretch by stretch, with their pivots in
every stretch. After these links only documents of different components matter. A node of few documents is compared
exhaustively. In a node of many, the members outside its largest component are compared with all others if they are
few, else the node branches. Where the largest component is bulky, such strays of all trees and levels are gathered and
meet that whole component once. What may be similar across components is confirmed group by group.

With ``TREES`` root positions a pair of similarity 0.8 misses every root with a chance of 0.2 ** 12, and its sketches
agree in fewer than ``AGREE`` of 64 positions with a chance of about 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from dripline.llm.catalog import query
from dripline.llm.common import bytes_of, lower_words, map_batches, per_text, small_side, table, written
from dripline.operators.components import components

SHINGLE, PERCENT = 4, 80
POSITIONS, TREES, BRANCH, DEPTH = 64, 12, 2, 4
#: Agreeing positions from which the full sets are compared, at a similarity of ``PERCENT``.
AGREE = 36
#: Documents of a node that are compared exhaustively, and of a tile of a node that can't be branched further.
LEAF = 1024
#: Members of a large node that are in each of its stretches.
PIVOTS = 8
#: A component with at least one in so many members of a large node is bulky there.
BULKY = 4
SEED = 42
_BLOCK = 4096
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_ROOTS = np.argsort(_RNG.random(POSITIONS))[:TREES]


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of fewer words the whole sequence is one. No words: empty."""
    words = lower_words(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    found = {digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Minwise token of each position."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, (hashes[k : k + _BLOCK, None] * _TIMES + _PLUS).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the similarity."""
    if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _marked(docs: DataFrame, shingle: int, text_col: str, id_col: str) -> DataFrame:
    """(doc, n, sig, sketch) of every row; without words sig and sketch are null."""

    def run(texts: list[bytes]) -> list:
        sets = [shingle_set(t, shingle) for t in texts]
        sigs = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return [[len(s) for s in sets], sigs, [sketch(s).tobytes() if len(s) else None for s in sets]]

    out = per_text(docs, run, "n long, sig binary, sketch binary", text_col, [id_col])
    return out.select(F.col(f"row.`{id_col}`").alias("doc"), "n", "sig", "sketch")


def _roots(nodes: DataFrame) -> DataFrame:
    """(path, key): the children of the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column(1))
            paths = [[xxhash.xxh3_64_intdigest(bytes([p]) + t.tobytes()) for t in tokens[:, p]] for p in _ROOTS]
            keys = np.tile(batch.column(0).to_numpy(), len(_ROOTS))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(paths, np.uint64).ravel().view(np.int64)), pa.array(keys)], ["path", "key"])

    return map_batches(nodes.select("key", "sketch"), run, "path long, key long")


def _tokens(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint32).reshape(len(values), POSITIONS)


def _children(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, key): every node selects positions by a hash of its own path; equal tokens there meet in a child."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[int, np.ndarray] = {}
        for batch in batches:
            tokens, keys = _tokens(batch.column(2)), batch.column(1).to_pylist()
            paths, out = [], []
            for row, path, key in zip(tokens, batch.column(0).to_pylist(), keys):
                name = path.to_bytes(8, "little", signed=True)
                if path not in chosen:
                    draws = np.random.default_rng(xxhash.xxh3_64_intdigest(name)).random(POSITIONS)
                    chosen[path] = np.flatnonzero((draws < BRANCH / POSITIONS) | (draws == draws.min()))
                for p in chosen[path]:
                    paths.append(xxhash.xxh3_64_intdigest(name + bytes([p]) + row[p].tobytes()))
                    out.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(paths, np.uint64).view(np.int64)), pa.array(out, pa.int64())], ["path", "key"])

    joined = rows.select("path", "key").join(nodes.select("key", "sketch"), "key").select("path", "key", "sketch")
    return map_batches(joined, run, "path long, key long")


def _sized(rows: DataFrame) -> DataFrame:
    """(path, key, size): members of nodes with at least two; of nodes with the same members one stays."""
    h = [F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")]
    sizes = rows.groupBy("path").agg(F.count("*").alias("size"), *h).filter("size > 1")
    sizes = sizes.groupBy("size", "x", "y").agg(F.min("path").alias("path")).select("path", "size")
    return written(rows.join(sizes, "path").select("path", "key", "size"), "nodes")


class _Runs:
    """Runs of equal keys in a sorted stream of Arrow batches."""

    def __init__(self, batches: Iterator[pa.RecordBatch], keys: int):
        self.batches, self.keys = batches, keys

    def __iter__(self) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in self.batches:
            if not len(batch):
                continue
            change = np.zeros(len(batch), dtype=bool)
            for c in range(self.keys):
                x = batch.column(c).to_numpy()
                change[1:] |= x[1:] != x[:-1]
                change[0] |= not held or held[-1].column(c)[-1].as_py() != x[0]
            starts = np.flatnonzero(change)
            edges = [0, *starts.tolist(), len(batch)] if not len(starts) or starts[0] else [*starts.tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                if change[a] and held:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield pa.Table.from_batches(held)


def agreeing(n: np.ndarray, tokens: np.ndarray, label: np.ndarray, percent: int, agree: int) -> np.ndarray:
    """Agreeing positions of documents of a node that may be similar and have different labels, else 0, as a matrix."""
    fits = (percent * np.maximum(n[:, None], n) <= 100 * np.minimum(n[:, None], n)) & (label[:, None] != label)
    out = np.zeros(fits.shape, dtype=np.uint8)
    step = max(1, 65_536 // max(len(n), 1))
    for k in range(0, len(n), step):
        part = fits[k : k + step]
        if part.any():
            count = np.count_nonzero(tokens[k : k + step, None] == tokens, axis=2)
            out[k : k + step] = np.where(part & (count >= agree), count, 0)
    return out


def _in_leaves(leaves: DataFrame, nodes: DataFrame, labels: DataFrame | None, fn, schema: str) -> DataFrame:
    """``fn(keys, n, tokens, labels)`` on every leaf that holds more than one label."""
    rows = leaves.select("path", "key")
    if labels is None:
        rows = rows.withColumn("label", F.col("key"))
    else:
        rows = rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        mixed = rows.groupBy("path").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        rows = rows.join(mixed.select("path"), "path", "left_semi")
    full = rows.join(nodes.select("key", "n", "sketch"), "key").select("path", "key", "n", "sketch", "label")
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf in _Runs(batches, 1):
            keys, n, label = (leaf.column(c).to_numpy() for c in ("key", "n", "label"))
            a, b = fn(keys, n, _tokens(leaf.column("sketch")), label)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # By a hash of the path: Spark takes the partitions of a join by path for these, and may then cut them into pieces.
    placed = full.repartition(tasks, F.xxhash64("path")).sortWithinPartitions("path", "key")
    return map_batches(placed, run, schema)


def _stars(leaves: DataFrame, nodes: DataFrame, percent: int, agree: int) -> DataFrame:
    """(a, b): each document that may be similar to others, with one of them; the smaller comes first.

    That is the smallest of those that agree as similar documents do, else the one that agrees most.
    """

    def run(keys, n, tokens, label):
        count = agreeing(n, tokens, label, percent, agree)  # rows come by ascending key
        use = np.flatnonzero(count.any(axis=1))
        likely = 100 * count[use].astype(np.int32) >= percent * POSITIONS
        one = np.where(likely.any(axis=1), likely.argmax(axis=1), count[use].argmax(axis=1))
        return keys[np.minimum(one, use)], keys[np.maximum(one, use)]

    return _in_leaves(leaves, nodes, None, run, "a long, b long").distinct()


def _groups(leaves: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, agree: int) -> DataFrame:
    """(gid, key): documents joined by pairs that may be similar, of different components; equal groups once."""

    def run(keys, n, tokens, label):
        maybe = agreeing(n, tokens, label, percent, agree) > 0
        use = np.flatnonzero(maybe.any(axis=1))
        maybe, group = maybe[np.ix_(use, use)], np.arange(len(use))
        while len(use):  # the smallest place reachable
            lower = np.minimum(group, np.where(maybe, group, len(use)).min(axis=1))
            if (lower == group).all():
                break
            group = lower
        a = np.empty(len(use), dtype=np.int64)
        for g in np.unique(group):
            a[group == g] = np.array([xxhash.xxh3_64_intdigest(keys[use[group == g]].tobytes())], np.uint64).view(np.int64)
        return a, keys[use]

    out = _in_leaves(leaves, nodes, labels, run, "a long, b long")
    return out.select(F.col("a").alias("gid"), F.col("b").alias("key")).distinct()


def _sets(docs: DataFrame, nodes: DataFrame, keys: DataFrame, shingle: int, text_col: str, id_col: str) -> DataFrame:
    """(key, set): full sets of the named nodes, each from one of its documents."""
    wanted = written(nodes.join(keys, "key", "left_semi").select("key", "sig", F.col("first").alias("doc")), "wanted")
    ids = small_side(wanted.select("doc").distinct())
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("text")).alias("d")
    rows = rows.join(ids.alias("w"), F.col("d.doc").eqNullSafe(F.col("w.doc")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle).tobytes() for t in bytes_of(batch.column(0))]
            sigs = [xxhash.xxh3_128_digest(s) if s else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], ["sig", "set"])

    found = map_batches(rows, run, "sig binary, set binary")
    return written(found.join(small_side(wanted.select("key", "sig")), "sig").select("key", "set").dropDuplicates(["key"]), "sets")


def _confirmed(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs (a, b), by full sets; a very frequent ``a`` is copied to several tiles."""
    counts = stars.groupBy("a").count().filter(F.col("count") > LEAF)
    hot = small_side(counts.select("a", F.ceil(F.col("count") / LEAF).cast("int").alias("tiles")))
    rows = stars.join(hot, "a", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("b"), F.col("tiles")).cast("int")).select("a", "tile", F.col("b").alias("key"))
    placed = rows.withColumn("lead", F.lit(0)).unionByName(rows.select("a", "tile").distinct().withColumn("key", F.col("a")).withColumn("lead", F.lit(1)))
    placed = placed.join(sets, "key").select("a", "tile", "lead", "key", "set")
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for batch in batches:
            found = []
            for a, _, lead, key, data in zip(*[c.to_pylist() for c in batch.columns]):
                mine = np.frombuffer(data, np.uint64)
                if lead:
                    pivot = mine
                elif similar(pivot, mine, percent):
                    found.append((a, key))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], ["a", "b"])

    placed = placed.repartition(tasks, "a", "tile").sortWithinPartitions("a", "tile", F.desc("lead"))
    return map_batches(placed, run, "a long, b long")


def links_in_group(keys: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join whatever similar pairs of different labels join.

    A document is compared with all others at once, through the lists of the documents that hold each shingle.
    Documents of the largest component need no turn of their own: every pair between components has an end elsewhere.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    holders, bounds = owner[order], np.append(0, np.cumsum(np.bincount(shingle)))
    starts = np.append(0, np.cumsum(sizes))
    _, group = np.unique(label, return_inverse=True)
    done = np.zeros(len(sets), dtype=bool)
    links = []
    while True:
        count = np.bincount(group)
        open_ = np.flatnonzero(~done & (group != count.argmax()))
        if not len(open_):
            return links
        i = open_[0]
        done[i] = True
        own = shingle[starts[i] : starts[i + 1]]
        both = np.bincount(np.concatenate([holders[bounds[s] : bounds[s + 1]] for s in own]), minlength=len(sets))
        hits = np.flatnonzero((100 * both >= percent * (sizes + sizes[i] - both)) & (group != group[i]))
        for j in hits:
            if group[j] != group[i]:
                links.append((int(keys[i]), int(keys[j])))
                group[group == group[j]] = group[i]


def _settled(groups: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, group by group."""
    rows = groups.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")).join(sets, "key")
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("gid", "key", "label", "set").repartition(tasks, "gid").sortWithinPartitions("gid", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _Runs(batches, 1):
            members = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
            found = links_in_group(group.column("key").to_numpy(), group.column("label").to_numpy(), members, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in (0, 1)], ["a", "b"])

    return map_batches(rows, run, "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    """(key, label) of every linked node."""
    return components(links, []).select(F.col("node").alias("key"), F.col("root").alias("label"))


def _stretches(big: DataFrame) -> DataFrame:
    """(path, key): large nodes cut into stretches by a hash, with the first member of the node in every stretch.

    A document is in the stretches of its largest node only: the pivots of its other large nodes are mostly the same
    documents, and what they would add is found among the strays of those nodes.
    """
    parts = F.ceil(F.col("size") / LEAF).cast("int")
    own = big.groupBy("key").agg(F.max(F.struct("size", "path")).alias("top")).select("top.path", "key", "top.size")
    rows = own.select("path", "key", F.pmod(F.xxhash64("key"), parts).cast("int").alias("part"))
    firsts = big.groupBy("path").agg(F.min("key").alias("key"), F.max(parts).alias("parts"))
    firsts = firsts.select("path", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return rows.unionByName(firsts).select(F.xxhash64("path", "part").alias("path"), "key").distinct()


def _pivots(big: DataFrame) -> DataFrame:
    """(path, key): the smallest member of each of ``PIVOTS`` shares of a large node, in every stretch of the node.

    One of them is likely to be similar to most of the documents that are similar to many.
    """
    parts = F.ceil(F.col("size") / LEAF).cast("int")
    share = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(PIVOTS)).alias("share")
    rows = big.groupBy("path", share).agg(F.min("key").alias("key"), F.max(parts).alias("parts"))
    rows = rows.select("path", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return rows.select(F.xxhash64("path", "part").alias("path"), "key")


def _met(strays: DataFrame, others: DataFrame) -> DataFrame:
    """(path, key): the strays of a path, in tiles, meet all its stretches; each meeting is a leaf.

    Both carry ``path``, ``key`` and the numbers ``strays`` and ``size`` of the path.
    """
    half = LEAF // 2
    tiles, parts = (F.ceil(F.col(c) / half).cast("int") for c in ("strays", "size"))
    tile = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["path", "key", "t", "p"]
    rows = strays.withColumn("t", tile(tiles)).withColumn("p", every(parts)).select(columns)
    rows = rows.unionByName(others.withColumn("p", tile(parts)).withColumn("t", every(tiles)).select(columns))
    return rows.select(F.xxhash64("path", "t", "p").alias("path"), "key").distinct()


def _split(big: DataFrame, labels: DataFrame, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, (label, key) of strays, members to branch) of large nodes.

    Nodes with few members outside their largest component don't branch, on the last level no node does. If that
    component is bulky, its label is given with those strays, else they meet every stretch of the node.
    """
    rows = big.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")).select("path", "key", "size", "label")
    rows = written(rows, "labelled")
    top = rows.groupBy("path", "label").count().groupBy("path").agg(F.max_by("label", F.struct("count", "label")).alias("top"), F.max("count").alias("c"), F.sum("count").alias("all"))
    bulky = ((F.col("c") > 1) & (BULKY * F.col("c") >= F.col("all"))).alias("bulky")
    top = small_side(top.select("path", "top", (F.col("all") - F.col("c")).alias("strays"), bulky).filter("strays > 0"))
    here = F.lit(last) | (F.col("strays") <= LEAF)
    astray = F.col("label") != F.col("top")
    few = rows.join(top.filter(here & ~F.col("bulky")), "path")
    pooled = rows.join(top.filter(here & F.col("bulky")), "path").filter(astray).select(F.col("top").alias("label"), "key")
    return _met(few.filter(astray), few), pooled, rows.join(top.filter(~here), "path", "left_semi").select("path", "key")


def _pools(strays: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, key): the strays (label, key) of a component meet each other and all of the component."""
    strays = written(strays.distinct(), "strays")
    sizes = strays.groupBy("label").agg(F.count("*").alias("strays"))
    sizes = small_side(sizes.join(labels.groupBy("label").count(), "label").select("label", "strays", (F.col("strays") + F.col("count")).alias("size")))
    rows, members = (x.join(sizes, "label").select(F.col("label").alias("path"), "key", "strays", "size") for x in (strays, labels))
    return _met(rows, rows.unionByName(members))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(id, n_shingles, component_id): documents linked if their sets of word shingles reach the similarity.

    Texts without words (null, empty, white space) have an empty set and are linked with nothing. Equal sets are one
    node, however many rows share it; sets are compared by 64-bit hashes of their shingles. Rows that repeat an id are
    rows of their own with the component of their text. Rows without an id link but never name a component; one of
    such rows only has a null id. Long texts are read whole; an empty table gives an empty result.
    """
    agree = AGREE * percent // PERCENT

    def sets_of(keys: DataFrame) -> DataFrame:
        return _sets(docs, nodes, keys, shingle, text_col, id_col)

    marked = written(_marked(docs, shingle, text_col, id_col), "sketches")
    nodes = marked.filter("sig is not null").groupBy("sig").agg(F.min("doc").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.withColumn("key", F.monotonically_increasing_id()), "sets")
    live = _sized(_roots(nodes))
    small, big = live.filter(F.col("size") <= LEAF).select("path", "key"), live.filter(F.col("size") > LEAF)
    crowded = not big.isEmpty()
    stars = written(_stars(small.unionByName(_stretches(big).unionByName(_pivots(big)).distinct()) if crowded else small, nodes, percent, agree), "stars")
    sets = sets_of(stars.select(F.col("a").alias("key")).union(stars.select("b")).distinct())
    links = written(_confirmed(stars, sets, percent), "links")
    known = written(_labels(links), "known")
    leaves, strays = [small], []
    for depth in range(DEPTH if crowded else 0):
        met, pooled, rows = _split(big, known, depth == DEPTH - 1)
        leaves.append(met)
        strays.append(pooled)
        if depth == DEPTH - 1 or rows.isEmpty():
            break
        live = _sized(_children(rows, nodes))
        leaves.append(live.filter(F.col("size") <= LEAF).select("path", "key"))
        big = live.filter(F.col("size") > LEAF)
    if strays:
        leaves.append(_pools(_all(strays), known))
    groups = written(_groups(_all(leaves), nodes, known, percent, agree), "groups")
    if not groups.isEmpty():
        if crowded:  # else every member of a group is in a star already
            sets = sets.unionByName(sets_of(groups.select("key").distinct().join(sets, "key", "left_anti")))
        known = _labels(links.unionByName(written(_settled(groups, known, sets, percent), "links")))
    linked = nodes.join(known, "key").select("sig", "first", "label")
    named = linked.groupBy("label").agg(F.min("first").alias("component"))
    linked = linked.join(named, "label").select("sig", "component")
    named = written(nodes.join(linked, "sig", "left").select("sig", F.coalesce("component", "first").alias("component")), "named")
    own = F.when(F.col("sig").isNull(), F.col("doc")).otherwise(F.col("component")).alias("component_id")
    return marked.select("doc", "n", "sig").join(named, "sig", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), own)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("op11_chosen_paths")
def op11_chosen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
