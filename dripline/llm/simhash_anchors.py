"""SimHash near-duplicates by anchor points.

Two fingerprints within ``d`` bits differ in at most ``d // p`` bits in one of ``p`` equal parts. The anchors of a
part are the words of a Hamming code over all but one of its bits: a perfect code, so every value lies within its
covering radius 1 of exactly one anchor, its home. A fingerprint is sent to every anchor within radius + threshold of
each part; of two fingerprints that agree to within the threshold in a part, the second reaches the home of the first.
Homes are compared with everything at their anchor, by the whole fingerprint.

Only distinct fingerprints are sent. An anchor returns a few links per fingerprint, never its pairs; an anchor with
very many homes is cut into tiles of homes, and the others stream past each tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from dripline.llm.catalog import query
from dripline.llm.common import lower_words, map_batches, per_text, small_side, table, written
from dripline.operators.components import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
#: Homes of one anchor in one task; more are cut into tiles.
TILE_HOMES = 16_384
#: Pairs compared at once, and rows of one anchor held at once.
PAIR_BLOCK, HELD_ROWS = 2_000_000, 500_000
_HASH_BLOCK = 65_536
ROWS_PER_TASK = 2_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is set in over half of the hashes of the word shingles. No words: zero."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), _HASH_BLOCK):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[k : k + _HASH_BLOCK], ends[k : k + _HASH_BLOCK])]
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, fp): the fingerprint of every whole text as a signed 64-bit number."""

    def run(texts: list[bytes]) -> list:
        return [np.array([fingerprint(t, shingle) for t in texts], dtype="<u8").view("<i8")]

    return per_text(docs, run, "fp long", text_col, carry)


class Anchors:
    """Anchors of fingerprints for pairs within ``max_bits``."""

    def __init__(self, max_bits: int = MAX_BITS):
        self.parts = next((p for p in (2, 4, 8) if max_bits < 2 * p), 0)
        if not self.parts:
            raise ValueError("at most 15 bits")
        self.width = 64 // self.parts
        self.length = self.width - 1  # 31, 15 or 7: the lengths of Hamming codes
        self.reach = max_bits // self.parts  # 0 or 1
        places = np.arange(1, self.length + 1)
        self.syndromes = np.zeros((-(-self.length // 8), 256), dtype=np.int64)
        for place in places:
            byte, bit = divmod(place - 1, 8)
            self.syndromes[byte, (np.arange(256) >> bit) & 1 == 1] ^= place
        pairs = (self.length - 1) // 2 if self.reach else 0
        # masks[s] lead from a value with syndrome s to the anchors near it: first its home, then those two flips away.
        self.masks = np.zeros((self.length + 1, 1 + pairs), dtype=np.int64)
        for s in places:
            self.masks[s, 0] = 1 << (s - 1)
            if pairs:
                two = [(i, i ^ s) for i in places if i < i ^ s]
                self.masks[s, 1:] = [1 << (i - 1) | 1 << (j - 1) for i, j in two]

    def of(self, fps: np.ndarray, homes_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, fingerprint, whether it is the home) for each anchor of each fingerprint."""
        out = []
        raw = fps.view(np.uint64)
        for part in range(self.parts):
            value = ((raw >> np.uint64(part * self.width)) & np.uint64((1 << self.length) - 1)).astype(np.int64)
            syndrome = np.zeros(len(value), dtype=np.int64)
            for byte, known in enumerate(self.syndromes):
                syndrome ^= known[(value >> (8 * byte)) & 255]
            near = self.masks[syndrome][:, : 1 if homes_only else None]
            home = np.zeros(near.shape, dtype=bool)
            home[:, 0] = True
            # An anchor itself has no other anchor within two flips.
            use = (home | (syndrome > 0)[:, None]).ravel()
            anchor = (value[:, None] ^ near) | (part << 32)
            out.append((anchor.ravel()[use], np.repeat(fps, near.shape[1])[use], home.ravel()[use]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _sent(fps: DataFrame, max_bits: int, homes_only: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(max_bits)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(values), 20_000):
                cols = anchors.of(values[k : k + 20_000], homes_only)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "fp", "home"])

    return map_batches(fps, run, "anchor long, fp long, home boolean")


def links_at(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int) -> np.ndarray:
    """Links among rows sorted by anchor, homes first: for each fingerprint its first near home, and what joins homes.

    Of all near pairs at an anchor only these are returned; they connect exactly what the pairs connect.
    """
    n = len(anchor)
    if n < 2:
        return np.empty((0, 2), dtype=np.int64)
    change = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    end = np.repeat(np.append(change[1:], n), np.diff(np.append(change, n)))
    homes = np.flatnonzero(home & (end - np.arange(n) > 1))
    found = []
    counts = end[homes] - homes - 1
    total = np.cumsum(counts)
    k = 0
    while k < len(homes):
        stop = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + PAIR_BLOCK, "right")))
        p = np.repeat(homes[k:stop], counts[k:stop])
        q = np.arange(len(p)) - np.repeat(np.cumsum(counts[k:stop]) - counts[k:stop], counts[k:stop]) + p + 1
        near = np.bitwise_count((fp[p] ^ fp[q]).view(np.uint64)) <= max_bits  # of signed numbers it takes the absolute value
        p, q = p[near], q[near]
        if len(p):
            # Sorted by p within equal q after a stable sort: the first p of each q is its smallest near home.
            order = np.argsort(q, kind="stable")
            p, q = p[order], q[order]
            head = np.concatenate([[True], q[1:] != q[:-1]])
            first = p[head][np.cumsum(head) - 1]
            pairs = np.concatenate([np.stack([q[head], p[head]], 1), np.unique(np.stack([p, first], 1), axis=0)])
            found.append(fp[pairs[pairs[:, 0] != pairs[:, 1]]])
        k = stop
    links = np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64)
    return np.unique(links[links[:, 0] != links[:, 1]], axis=0)


def _links(sent: DataFrame, max_bits: int, keys: list[str], tasks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]

        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            links = links_at(*rows, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            if len(keys) > 1:  # tiles of one anchor are groups of their own
                group = group | (batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64) << 36)
            new = [group, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)]
            rows = [np.concatenate(x) for x in zip(held, new)]
            if not len(rows[0]):
                continue
            last = len(rows[0]) - int(np.argmax((rows[0] != rows[0][-1])[::-1])) if rows[0][0] != rows[0][-1] else 0
            if last:
                yield out([x[:last] for x in rows])
            held = [x[last:] for x in rows]
            if len(held[0]) > HELD_ROWS:  # all homes came first: compare, then only they are needed
                yield out(held)
                held = [x[held[2]] for x in held]
        yield out(held)

    placed = sent.repartition(tasks, *keys).sortWithinPartitions(*keys, F.desc("home"))
    return map_batches(placed.select("anchor", "fp", "home", *keys[1:]), run, "a long, b long")


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within ``max_bits``."""
    spark = fps.sparkSession
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        fps.count() * len(Anchors(max_bits).masks) // ROWS_PER_TASK,
    )
    hot = _sent(fps, max_bits, True).groupBy("anchor").count().filter(F.col("count") > TILE_HOMES)
    hot = small_side(hot.select("anchor", F.ceil(F.col("count") / TILE_HOMES).cast("int").alias("tiles")))
    sent = _sent(fps, max_bits)
    if hot.isEmpty():
        return _links(sent, max_bits, ["anchor"], tasks)
    tiled = (
        sent.join(hot, "anchor", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("home", F.col("home") & (F.pmod(F.xxhash64("fp"), F.col("tiles")) == F.col("tile")))
    )
    return _links(tiled, max_bits, ["anchor", "tile"], tasks)


def _grouped(docs: DataFrame, shingle: int, max_bits: int, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """((doc, fp) of every row, (fp, root, component_id) of every fingerprint)."""
    marked = fingerprints(docs, shingle, text_col, [id_col])
    fps = written(marked.select(F.col(f"row.`{id_col}`").alias("doc"), "fp"), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc").alias("first")), "nodes")
    roots = components(near_links(nodes.select("fp"), max_bits), [])
    linked = nodes.join(roots, nodes.fp == roots.node).select("fp", "first", "root")
    named = linked.groupBy("root").agg(F.min("first").alias("component"))
    linked = linked.join(named, "root").select("fp", "root", "component")
    labels = nodes.join(linked, "fp", "left")
    labels = labels.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "first").alias("component_id"))
    return fps, written(labels, "labels")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id reachable over links of at most ``max_bits``.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like any other. Equal
    fingerprints are one node, however many rows share it; rows with a null id link but never name a component (a
    component of such rows only has a null id). Long texts are read whole; an empty table gives an empty result.
    """
    fps, labels = _grouped(docs, shingle, max_bits, text_col, id_col)
    return fps.join(labels.drop("root"), "fp").select(F.col("doc").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component, with the columns of ``docs``: that of the smallest id, null ids last.

    Rows whose id is theirs alone are decided by it: only the ids that go are joined with the texts. Rows that share an
    id, or have none, are decided by id and fingerprint, and one of the rows equal in both stays.
    """
    fps, labels = _grouped(docs, SHINGLE, MAX_BITS, text_col, id_col)
    pairs = fps.groupBy("doc", "fp").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc").isNull().alias("nameless"), "doc", "fp")
    heads = pairs.join(labels.select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("h"))
    heads = written(heads.select(F.col("h.doc").alias("doc"), F.col("h.fp").alias("fp")), "heads")
    counts = pairs.groupBy("doc").agg(F.sum("n").alias("rows"))
    shared = written(counts.filter("rows > 1 or doc is null").select("doc"), "shared-ids")
    gone = counts.filter("rows = 1 and doc is not null").select("doc").join(heads, "doc", "left_anti")
    away = small_side(gone.unionByName(shared).filter("doc is not null").withColumnRenamed("doc", id_col))
    kept = docs.filter(F.col(f"`{id_col}`").isNotNull()).join(away, id_col, "left_anti").select(docs.columns)
    if shared.isEmpty():
        return kept
    ids = small_side(shared)
    unsure = docs.join(ids, F.col(f"`{id_col}`").eqNullSafe(ids["doc"]), "left_semi")
    marked = fingerprints(unsure, SHINGLE, text_col).withColumn("doc", F.col(f"row.`{id_col}`"))
    chosen = heads.select(F.col("doc").alias("d"), F.col("fp").alias("f"))
    chosen = marked.join(chosen, F.col("doc").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f"))).dropDuplicates(["doc", "fp"])
    return kept.unionByName(chosen.select("row.*"))


def fingerprint_text(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", fingerprint_text().alias("fingerprint"), "component_id")
