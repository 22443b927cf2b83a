"""Exact top-k inner products by a uniform threshold in three phases.

The components of all vectors are dealt to nodes; a node knows only its part of every score. Scores of a node are
counted from its smallest one, so that none is negative. Phase one gathers the highest partial scores of each node and
resolves the vectors named there: the k-th best exact score is a safe cutoff. If the partial scores of a vector all
stay below their node's equal share of the cutoff, its score does too. Phase two collects every partial score that
reaches its share; with all partial scores of a vector known, its score is known, else it has an upper bound. Phase
three resolves those whose bound reaches the raised cutoff.

Equal vectors are compared once: the smallest k + 1 of their ids stand for them, more can't be in a result.
Queries and vectors are packed into blocks. A task holds one block of queries while the vector blocks of its group pass
by, so blocks are copied once per opposite group, nothing is broadcast, and pairs leave a task only as packed lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dripline.llm.catalog import query
from dripline.llm.common import map_batches, table, written

K, EVERY, NODES, SCALE = 5, 50, 2, 256
#: Vectors of one block, queries and bytes of one at most, queries scored at once, and entries a node gives in phase one.
BLOCK, QUERY_BLOCK, BLOCK_BYTES, STRIP, FIRST = 4096, 32_768, 16 << 20, 256, 32
#: Vector blocks of one group, about, and pairs resolved at once.
GROUP, PAIRS = 8, 65_536
_LONG = np.iinfo(np.int64)
_PACKED = "qb int, grp int, cb int, kind int, strip int, node int, type string, ids binary, part binary, x binary"


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: floating point while it is exact, else Python's integers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)))
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return np.clip(a.astype(object) @ b.astype(object).T, _LONG.min, _LONG.max)


def row_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner product of each pair of rows."""
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if top < 2**62:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    pairs = zip(a.tolist(), b.tolist())
    return np.array([max(_LONG.min, min(_LONG.max, sum(p * q for p, q in zip(u, v)))) for u, v in pairs], dtype=np.int64)


def _usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    x = F.col(f"`{vec_col}`")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.filter(fine & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v"))


def _narrow(m: np.ndarray) -> np.ndarray:
    """``m`` in the smallest integers that hold it."""
    low, high = int(m.min(initial=0)), int(m.max(initial=0))
    return next(m.astype(t) for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def _blocks(rows: DataFrame, nodes: int, width: int, most: int, x: tuple = ()) -> tuple[DataFrame, int]:
    """((block, node, type, ids, part, x), number of blocks): rows packed into blocks, each node with its part of the components."""
    n = max(1, -(-rows.count() // max(1, min(most, BLOCK_BYTES // max(1, 8 * width)))))
    parts = np.array_split(np.arange(width), nodes)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((len(pdf), width), dtype=np.int64)
        for row, v in zip(m, pdf["v"]):
            row[: len(v)] = v
        m = _narrow(m)
        of = {"type": m.dtype.str, "ids": pdf["id"].to_numpy(np.int64).tobytes(), "x": b"".join(pdf[c].to_numpy().tobytes() for c in x)}
        return pd.DataFrame([{"block": key[0], "node": b, **of, "part": np.ascontiguousarray(m[:, p]).tobytes()} for b, p in enumerate(parts)])

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    schema = "block int, node int, type string, ids binary, part binary, x binary"
    return written(keyed.groupBy("block").applyInPandas(pack, schema), "block"), n


def _meet(queries: tuple, cands: tuple, fn, schema: str, by_node: bool, lists: DataFrame | None = None) -> DataFrame:
    """``fn`` on the packed rows of each query block and vector group, one task for each: first the queries, then the
    vector blocks in order, each followed by its ``lists``."""
    (q, nq), (c, nc) = queries, cands
    spark = q.sparkSession
    groups = min(nc, max(spark.sparkContext.defaultParallelism, -(-nc // GROUP)))
    none = F.lit(0)

    def every(n: int) -> F.Column:
        return F.explode(F.sequence(none, F.lit(n - 1)))

    names = [c.split(" ")[0] for c in _PACKED.split(", ")]
    left = q.withColumns({"qb": F.col("block"), "cb": F.lit(-1), "kind": none, "strip": none}).withColumn("grp", every(groups))
    right = c.withColumns({"cb": F.col("block"), "grp": F.col("block") % groups, "kind": F.lit(1), "strip": none}).withColumn("qb", every(nq))
    rows = left.select(names).unionByName(right.select(names))
    if lists is not None:
        rows = rows.unionByName(lists.withColumns({"kind": F.lit(2), "grp": F.col("cb") % groups}).select(names))
    keys = ["node", "qb", "grp"] if by_node else ["qb", "grp"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * groups * nq)
    placed = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "cb", "kind", "strip", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple[tuple, dict]]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    yield tuple(row[c] for c in keys), row

        yield from fn(stream())

    return map_batches(placed, run, schema)


def _ids(row: dict) -> np.ndarray:
    return np.frombuffer(row["ids"], np.int64)


def _part(row: dict) -> np.ndarray:
    return np.frombuffer(row["part"], row["type"]).reshape(len(row["ids"]) // 8, -1)


class _Heads:
    """The ``count`` highest partial scores of each query so far, and the least of all."""

    def __init__(self, queries: int, count: int) -> None:
        self.score, self.at = np.full((queries, count), -np.inf), np.zeros((queries, count), dtype=np.int64)
        self.least = np.full(queries, np.inf)

    def add(self, rows: slice, scores: np.ndarray, cb: int) -> None:
        scores = scores.astype(np.float64)
        self.least[rows] = np.minimum(self.least[rows], scores.min(axis=1))
        have, count = self.score[rows], self.score.shape[1]
        hit = scores > have.min(axis=1)[:, None]
        n = hit.sum(axis=1)
        if n.max() > 4 * count:  # few entries are passed by, so the best of each row are taken first
            j = np.argpartition(-scores, min(count, scores.shape[1]) - 1, axis=1)[:, :count]
            fresh, places = np.take_along_axis(scores, j, 1), j
        else:
            i, j = np.nonzero(hit)
            fresh, places = np.full((len(n), int(n.max())), -np.inf), np.zeros((len(n), int(n.max())), dtype=np.int64)
            nth = np.arange(len(i)) - (np.cumsum(n) - n)[i]
            fresh[i, nth], places[i, nth] = scores[i, j], j
        if not fresh.shape[1]:
            return
        both, named = np.hstack([have, fresh]), np.hstack([self.at[rows], (np.int64(cb) << 32) + places])
        top = np.argpartition(-both, count - 1, axis=1)[:, :count]
        self.score[rows], self.at[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(named, top, 1)


def _lists(queries: tuple, cands: tuple, count: int) -> DataFrame:
    """(node, qb, qi, query, at, partial, least): the highest partial scores of each query in each group; ``at`` is the
    place of a vector, block and row."""

    def fn(stream) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(ids), STRIP * 16):
                rows = slice(k, k + STRIP * 16)
                i, j = np.nonzero(heads.score[rows] > -np.inf)
                i = i + k
                n = len(i)
                yield pa.RecordBatch.from_pydict(
                    {"node": np.full(n, held[0], np.int32), "qb": np.full(n, held[1], np.int32), "qi": i.astype(np.int32), "query": ids[i],
                     "at": heads.at[i, j], "partial": heads.score[i, j], "least": heads.least[i]}
                )

        held, heads = None, None
        for key, row in stream:
            if row["kind"] == 0:
                if heads is not None:
                    yield from out()
                held, ids, a = key, _ids(row), _part(row)
                heads = _Heads(len(ids), count)
            elif held == key:
                b = _part(row)
                for k in range(0, len(ids), STRIP):
                    heads.add(slice(k, k + STRIP), dots(a[k : k + STRIP], b), row["cb"])
        if heads is not None:
            yield from out()

    return _meet(queries, cands, fn, "node int, qb int, qi int, query long, at long, partial double, least double", True)


def _reached(queries: tuple, cands: tuple) -> DataFrame:
    """Packed lists of all entries that reach the limit of their query and node."""

    def fn(stream) -> Iterator[pa.RecordBatch]:
        held = None
        for key, row in stream:
            if row["kind"] == 0:
                held, a = key, _part(row)
                # The cutoff comes first, then a limit of each node.
                limit = np.frombuffer(row["x"]).reshape(-1, len(a))[1 + row["node"]]
            elif held == key:
                b = _part(row)
                for strip, k in enumerate(range(0, len(a), STRIP)):
                    scores, at_least = dots(a[k : k + STRIP], b), limit[k : k + STRIP]
                    # Rounding of the shares must not lose an entry.
                    i, j = np.nonzero(scores >= (at_least - 1e-6 * np.abs(at_least) - 1.0)[:, None])
                    if len(i):
                        yield _list_row(row["qb"], row["cb"], strip, row["node"], i + k, j, scores[i, j].astype(np.float64))

    return _meet(queries, cands, fn, "qb int, cb int, strip int, node int, type string, ids binary, part binary, x binary", True)


def _list_row(qb: int, cb: int, strip: int, node: int, qi: np.ndarray, ci: np.ndarray, partial: np.ndarray) -> pa.RecordBatch:
    small = len(partial) == 0 or np.abs(partial).max() < 2**31
    columns = [_narrow(qi), _narrow(ci), _narrow(partial.astype(np.int64)) if small else partial]
    packed = dict(zip(("ids", "part", "x"), (c.tobytes() for c in columns)))
    row = {"qb": qb, "cb": cb, "strip": strip, "node": node, "type": ",".join(c.dtype.str for c in columns), **packed}
    types = [pa.int32()] * 4 + [pa.string()] + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))


def _unpacked(row: dict) -> list[np.ndarray]:
    """Queries, vectors and partial scores of a packed list."""
    return [np.frombuffer(row[c], t) for c, t in zip(("ids", "part", "x"), row["type"].split(","))]


class _Best:
    """Exact scores of named pairs; of each query those that no ``k`` others with an id of their own lie above."""

    def __init__(self, k: int) -> None:
        self.k, self.kept, self.fresh = k, [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)], 0
        self.parts: list[tuple] = []

    def add(self, qi: np.ndarray, ids: np.ndarray, score: np.ndarray, offers: np.ndarray) -> None:
        self.parts.append((qi, ids, score, offers))
        self.fresh += len(qi)
        if self.fresh > max(16 * PAIRS, len(self.kept[0])):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        qi, ids, score, offers = (np.concatenate(x) for x in zip(self.kept, *self.parts))
        order = np.lexsort((-score.astype(object) if len(score) and score.min() == _LONG.min else -score, qi))
        qi, ids, score, offers = qi[order], ids[order], score[order], offers[order]
        first = np.searchsorted(qi, qi)
        # How many before a pair, with a higher score, have an id other than the query's.
        before = np.cumsum(offers) - offers
        nth = before - before[first]
        new = np.r_[True, (qi[1:] != qi[:-1]) | (score[1:] != score[:-1])] if len(qi) else np.empty(0, bool)
        nth = nth[np.maximum.accumulate(np.where(new, np.arange(len(qi)), 0))] if len(qi) else nth
        keep = nth < self.k
        self.kept, self.parts, self.fresh = [qi[keep], ids[keep], score[keep], offers[keep]], [], 0
        return self.kept


def _resolved(queries: tuple, cands: tuple, lists: DataFrame, nodes: int, k: int) -> DataFrame:
    """(query, id, score): exact scores of listed pairs, the ``k`` best of each group at least, equal ones all.

    A pair whose partial scores are all listed has a known score; the k-th best of those raises the cutoff. The others
    are resolved if the limits of the missing nodes can lift them to it.
    """

    def fn(stream) -> Iterator[pa.RecordBatch]:
        def resolve(waiting: list[dict]) -> None:
            if not waiting:
                return
            width = len(c_ids)
            entries = [_unpacked(r) for r in waiting]
            codes = [i * np.int64(width) + j for i, j, _ in entries]
            pairs = np.unique(np.concatenate(codes))
            qi, ci = pairs // width, pairs % width
            if limits is not None:
                total, has = np.zeros(len(pairs)), np.zeros((nodes, len(pairs)), dtype=bool)
                for code, r, (_, _, partial) in zip(codes, waiting, entries):
                    at = np.searchsorted(pairs, code)
                    total[at] += partial
                    has[r["node"], at] = True
                whole = has.all(axis=0)
                bound = total + np.where(has, 0.0, limits[1:, qi]).sum(axis=0)
                good = offer(qi, ci) & whole
                for q, s in zip(qi[good], total[good]):  # few pairs are known at all nodes
                    if s > raised[q].min():
                        raised[q, raised[q].argmin()] = s
                cut = np.maximum(limits[0, qi], raised[qi].min(axis=1))
                fine = bound + 1.0 + np.abs(bound) * 1e-6 >= cut
                qi, ci = qi[fine], ci[fine]
            for lo in range(0, len(qi), PAIRS):
                i, j = qi[lo : lo + PAIRS], ci[lo : lo + PAIRS]
                best.add(i, c_ids[j], row_dots(a[i], b[j]), offer(i, j))

        def offer(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return (count[j] > 1) | (smallest[j] != ids[i])

        def out() -> Iterator[pa.RecordBatch]:
            qi, found, score, _ = best.settle()
            yield pa.RecordBatch.from_pydict({"query": ids[qi], "id": found, "score": score})

        held, best, a, b, waiting = None, None, None, None, []
        for key, row in stream:
            if waiting and (row["kind"] != 2 or row["strip"] != waiting[0]["strip"]):
                resolve(waiting)
                waiting = []
            if row["kind"] == 0:
                if held != key:
                    if best is not None:
                        yield from out()
                    held, best, ids, a = key, _Best(k), _ids(row), _part(row)
                    limits = np.frombuffer(row["x"]).reshape(-1, len(ids)) if row["x"] else None
                    raised = np.full((len(ids), k), -np.inf)
                else:
                    a = np.hstack([a, _part(row)])
            elif held != key:
                continue
            elif row["kind"] == 1:
                part = _part(row)
                b = np.hstack([b, part]) if row["node"] else part
                c_ids, (smallest, count) = _ids(row), np.frombuffer(row["x"], np.int64).reshape(2, -1)
            else:
                waiting.append(row)
        resolve(waiting)
        if best is not None:
            yield from out()

    return _meet(queries, cands, fn, "query long, id long, score long", False, lists)


def _named_lists(named: DataFrame) -> DataFrame:
    """Rows (qb, qi, at) as packed lists."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["at"].to_numpy()
        none = np.empty(0)
        return _list_row(*key, 0, 0, pdf["qi"].to_numpy(), at & 0xFFFFFFFF, none).to_pandas()

    schema = "qb int, cb int, strip int, node int, type string, ids binary, part binary, x binary"
    return named.withColumn("cb", F.shiftright("at", 32).cast("int")).groupBy("qb", "cb").applyInPandas(pack, schema)


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _named(scores: DataFrame, cands: DataFrame, k: int) -> DataFrame:
    """Scores of distinct vectors as scores of their ids, without the query's own."""
    out = scores.join(cands.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("id"))
    return out.filter("id <> query")


def top_k(
    vectors: DataFrame,
    k: int = K,
    every: int = EVERY,
    nodes: int = NODES,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best partners of each row whose id is divisible by ``every``.

    Components become ``floor(scale * x)``. Vectors that are null or hold a null, NaN or infinity, and rows without an
    id, take no part. Rows with the id of the query are its own. Missing components of shorter vectors count as 0.
    Ties go to the smaller id; an empty table or no partner gives no rows.
    """
    rows = written(_usable(vectors, id_col, vec_col, scale).distinct(), "vectors")
    queries = rows.filter(F.col("id") % every == 0)
    queries = written(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    cands = rows.withColumn("n", first).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # Rows may share an id with different vectors, so a vector is named by a 64-bit hash of itself.
    cands = written(cands.withColumn("id", F.xxhash64("v")), "distinct-vectors")
    width = cands.agg(F.max(F.size("v"))).first()[0] or 0
    owned = cands.select("id", "v", F.col("ids")[0].alias("smallest"), F.size("ids").cast("long").alias("count"))
    packed = _blocks(owned, nodes, width, BLOCK, ("smallest", "count"))
    by_query = _blocks(queries, nodes, width, QUERY_BLOCK)
    count = max(FIRST, k + 1)
    lists = written(_lists(by_query, packed, count), "lists")
    top = Window.partitionBy("query", "node").orderBy(F.desc("partial"), "at")
    named = lists.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= count).select("qb", "qi", "at").distinct()
    known = written(_resolved(by_query, packed, _named_lists(named), nodes, k), "phase-one")
    kth = _best(_named(known, cands, k), k).groupBy("query").agg(F.min("score").alias("cut"), F.count("*").alias("n"))
    # With fewer than k partners in the lists there is no cutoff yet: then everything is collected.
    cut = F.when(F.col("n") >= k, F.col("cut").cast("double")).otherwise(float("-inf"))
    least = lists.groupBy("query", "node").agg(F.min("least").alias("least"))
    least = least.groupBy("query").agg(*[F.max(F.when(F.col("node") == b, F.col("least"))).alias(f"least_{b}") for b in range(nodes)])
    total = sum((F.col(f"least_{b}") for b in range(1, nodes)), F.col("least_0"))
    limits = least.join(kth.select("query", cut.alias("cut")), "query", "left").withColumn("cut", F.coalesce("cut", F.lit(float("-inf"))))
    share = (F.col("cut") - total) / nodes
    limits = limits.select("query", "cut", *[(F.col(f"least_{b}") + share).alias(f"limit_{b}") for b in range(nodes)])
    names = ("cut", *[f"limit_{b}" for b in range(nodes)])
    asking = _blocks(queries.join(limits, queries.id == limits["query"]).select("id", "v", *names), nodes, width, QUERY_BLOCK, names)
    exact = written(_resolved(asking, packed, _reached(asking, packed), nodes, k), "exact")
    best = _best(_named(exact, cands, k), k)
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


_SQL = f"""WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= {K}"""


@query("op8_exact_topk", _SQL)
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
