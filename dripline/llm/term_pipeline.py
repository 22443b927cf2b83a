"""Ranked lexical search over term owners in a pipeline.

The terms of the items are dealt to owners, rarest terms first. Documents come in blocks; a bundle is one block of
documents together with a group of items, and carries a sparse accumulator per item. Stage by stage the bundles meet
the posting lists of the next owner in a cogroup, which adds whole-number contributions to the accumulators. An
accumulator that can't reach the last place of its block any more, whatever the later owners add, is not carried on.
After the last stage each bundle gives its best documents, and the best of all blocks are the answer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dripline.llm.catalog import query
from dripline.llm.common import ASCII_LOWER, bytes_of, map_batches, small_side, table, written

K, OWNERS = 20, 4
#: Documents of one block at most; items of one group about.
BLOCK_DOCS, GROUP_ITEMS = 4096, 128
#: Buckets of 32,768 bits in the bitmap of wanted terms: 4 KB each, so at most 2 MB travel, whatever the items hold.
BITMAP_BUCKETS = 512
BITS = BITMAP_BUCKETS * 32768
#: Terms whose bit one task remembers.
MEMO_TERMS = 100_000
#: No contribution of one asked term of weight one exceeds it.
_TOP = 1_000_000
#: The same terms for SQL.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(ASCII_LOWER)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_KEEP).split()


def _exploded(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, times): rows that repeat count once; rows with one id and different texts are one item."""
    rows = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text")).distinct()
    kind = dict(rows.dtypes)["item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(t)) for t in bytes_of(batch.column(1))]
            item = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts])))
            term = pa.array([t for c in counts for t in c], pa.binary())
            times = pa.array([n for c in counts for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([item, term, times], ["item", "term", "times"])

    out = map_batches(rows, run, f"item {kind}, term binary, times long")
    return out.groupBy("item", "term").agg(F.sum("times").alias("times"))


def _wanted(terms: DataFrame) -> dict[int, bytes]:
    """Bitmap of the checksums of the terms: never misses one, lets few others through."""
    bit = F.crc32("term") % BITS + 1
    maps = terms.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p"))
    maps = maps.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    return {r["b"]: bytes(r["bits"]) for r in maps.collect()}  # at most BITMAP_BUCKETS rows of 4 KB


def _postings(docs: DataFrame, wanted: dict[int, bytes], id_col: str, text_col: str) -> DataFrame:
    """(block, term, at, tf, ids, nameless, sizes): posting lists of each block; the row without a term names its documents.

    A block is a stretch of one batch of documents, so nothing is shuffled to build it.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    names = ["block", "term", "at", "tf", "ids", "nameless", "sizes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        known: dict[bytes, bool] = {}

        def listed(term: bytes) -> bool:
            bucket, place = divmod(crc32(term) % BITS, 32768)
            bits = shared.value.get(bucket + 1)
            return bits is not None and bits[place >> 3] >> (place & 7) & 1 == 1

        for batch in batches:
            for start in range(0, len(batch), BLOCK_DOCS):
                stretch = batch.slice(start, BLOCK_DOCS)
                lists: dict[bytes, tuple[list[int], list[int]]] = {}
                sizes = np.zeros(len(stretch), dtype=np.int64)
                for i, text in enumerate(bytes_of(stretch.column(1))):
                    found = terms_of(text)
                    sizes[i] = len(found)
                    for term, n in Counter(found).items():
                        use = known.get(term)
                        if use is None:
                            if len(known) >= MEMO_TERMS:
                                known.clear()
                            use = known[term] = listed(term)
                        if use:
                            at, tf = lists.setdefault(term, ([], []))
                            at.append(i)
                            tf.append(n)
                block, n = part << 32 | number, len(lists)
                number += 1
                ids = stretch.column(0)
                nameless = np.asarray(ids.is_null())
                header = [ids.fill_null(0).to_numpy().tobytes(), nameless.tobytes(), sizes.tobytes()]
                columns = [
                    pa.array([block] * (n + 1), pa.int64()),
                    pa.array([None, *lists], pa.binary()),
                    *[pa.array([None, *[np.array(x[j], np.int32).tobytes() for x in lists.values()]], pa.binary()) for j in (0, 1)],
                    *[pa.array([x] + [None] * n, pa.binary()) for x in header],
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(rows, run, "block long, term binary, at binary, tf binary, ids binary, nameless binary, sizes binary")


def _totals(heads: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.frombuffer(b, np.int64) for b in batch.column(0).to_pylist()]
            both = [sum(int((s > 0).sum()) for s in sizes), sum(int(s.sum()) for s in sizes)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in both], ["n", "l"])

    n, length = heads.select("sizes").mapInArrow(count, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return n or 0, length or 0


def _asked(terms: DataFrame, lists: DataFrame, total: int, owners: int) -> tuple[DataFrame, DataFrame, int]:
    """((grp, slot, term, times, w, owner), (item, grp, slot), number of groups): what each item asks of each owner.

    Items are numbered in groups. Owners have terms of similar frequency, the first the rarest, and about equal shares
    of all postings.
    """
    df = lists.groupBy("term").agg(F.sum(F.octet_length("at") / 4).cast("long").alias("df"))
    w = F.floor(1000 * F.log(F.lit(float(2 * total + 2)) / (2 * F.col("df") + 1))).cast("long")
    asked = written(terms.join(df, "term").withColumn("w", w), "asked")
    octave = F.floor(F.log2("df")).cast("int")
    volumes = sorted(asked.select("term", "df").distinct().groupBy(octave.alias("o")).agg(F.sum("df").alias("v")).collect())  # 63 at most
    share, owner_of, before = max(sum(v for _, v in volumes), 1), [0] * 64, 0
    for o, v in volumes:
        owner_of[o] = before * owners // share
        before += v
    items = asked.select("item").distinct()
    groups = max(1, -(-items.count() // GROUP_ITEMS))
    items = items.select(F.col("item").alias("name"), F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int").alias("grp"))
    slot = F.row_number().over(Window.partitionBy("grp").orderBy("name")) - 1
    items = written(items.withColumn("slot", slot), "items")
    owner = F.element_at(F.array(*map(F.lit, owner_of)), octave + 1)
    slots = asked.join(items, F.col("item").eqNullSafe(F.col("name"))).select("grp", "slot", "term", "times", "w", owner.alias("owner"))
    return written(slots, "slots"), items, groups


def _ranked(scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: high scores first, then named and small ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    order = np.lexsort((ids[places], nameless[places], -scores[places]))
    return places[order[:k]]


_BUNDLE = "block long, grp int, ids binary, nameless binary, sizes binary, rest array<array<long>>, slots binary, at binary, acc binary"


def _stage(bundles: DataFrame, lists: DataFrame, asks: DataFrame, owner: int, last: bool, k: int, total: int, length: int) -> DataFrame:
    """The bundles after one owner has added to them; after the last one (grp, slot, doc, score)."""

    def add(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bundle = left.iloc[0]
        sizes, ids = np.frombuffer(bundle["sizes"], np.int64), np.frombuffer(bundle["ids"], np.int64)
        rest = np.array([list(x) for x in bundle["rest"]], dtype=np.int64)  # slots x owners
        acc = np.zeros((len(rest), len(sizes)), dtype=np.int64)
        acc[np.frombuffer(bundle["slots"], np.int32), np.frombuffer(bundle["at"], np.int32)] = np.frombuffer(bundle["acc"], np.int64)
        m = 12 * (75 + 25 * sizes * total // max(length, 1))
        for at, tf, w, slots, times in zip(*[right[c] for c in ("at", "tf", "w", "slots", "times")]):
            at, tf = np.frombuffer(at, np.int32), np.frombuffer(tf, np.int32).astype(np.int64)
            gain = w * (1_000_000_000 * tf // (1000 * tf + m[at]))
            acc[np.ix_(slots, at)] += np.asarray(times)[:, None] * gain
        if last:
            nameless = np.frombuffer(bundle["nameless"], bool)
            out = []
            for slot, row in enumerate(acc):
                hits = np.flatnonzero(row)
                if len(hits):
                    places = hits[_ranked(row[hits], ids[hits], nameless[hits], k)]
                    docs = pd.arrays.IntegerArray(ids[places].copy(), nameless[places].copy())
                    out.append(pd.DataFrame({"grp": key[1], "slot": slot, "doc": docs, "score": row[places]}))
            return pd.concat(out) if out else pd.DataFrame({"grp": [], "slot": [], "doc": pd.array([], "Int64"), "score": []})
        keep = acc > 0
        if acc.shape[1] > k:
            least = np.partition(acc, acc.shape[1] - k, axis=1)[:, acc.shape[1] - k]
            keep &= acc >= (least - rest[:, owner + 1 :].sum(axis=1))[:, None]
        slots, at = np.nonzero(keep)
        carried = {"slots": slots.astype(np.int32).tobytes(), "at": at.astype(np.int32).tobytes(), "acc": acc[slots, at].tobytes()}
        return left.assign(**carried)

    tasks = int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = asks.filter(F.col("owner") == owner)
    # At most one entry per slot of a group.
    mine = mine.groupBy("term", "grp", "w").agg(F.sort_array(F.collect_list(F.struct("slot", "times"))).alias("s"))
    mine = mine.select("term", "grp", "w", F.col("s.slot").alias("slots"), F.col("s.times").alias("times"))
    given = lists.join(small_side(mine), "term").select(F.col("block").alias("b"), F.col("grp").alias("g"), "at", "tf", "w", "slots", "times")
    left = bundles.repartition(tasks, "block", "grp").groupBy("block", "grp")
    right = given.repartition(tasks, "b", "g").groupBy("b", "g")
    return left.cogroup(right).applyInPandas(add, "grp int, slot int, doc long, score long" if last else _BUNDLE)


def top_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    owners: int = OWNERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item, rank, doc, score): the ``k`` best documents of each item, all with a score above 0 if there are fewer.

    Null and term-less texts count in no statistic and are never found. Rows that repeat an id are documents of their
    own; equal scores go to the smaller id, rows without an id come last. Equal item rows count once, rows that share
    an item id (null is one) are one item. Texts are read whole; empty tables give an empty result.
    """
    terms = written(_exploded(items, item_col, item_text), "item-terms")
    rows = written(_postings(docs, _wanted(terms), id_col, text_col), "postings")
    heads = rows.filter("term is null").select("block", "ids", "nameless", "sizes")
    lists = rows.filter("term is not null").select("block", "term", "at", "tf")
    total, length = _totals(heads)
    slots, names, groups = _asked(terms, lists, total, owners)
    # What each owner can add to an item at most; a group has few items, so its array is short.
    most = [F.sum(F.when(F.col("owner") == o, F.col("w") * F.col("times") * _TOP).otherwise(0)) for o in range(owners)]
    rest = slots.groupBy("grp", "slot").agg(F.array(*most).alias("most"))
    rest = rest.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("slot", "most"))).alias("r"))
    rest = rest.select("grp", F.col("r.most").alias("rest"))
    none = [F.lit(b"").alias(c) for c in ("slots", "at", "acc")]
    bundles = heads.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    bundles = bundles.join(small_side(rest), "grp").select("block", "grp", "ids", "nameless", "sizes", "rest", *none)
    for owner in range(owners):
        bundles = _stage(bundles, lists, slots, owner, owner == owners - 1, k, total, length)
    order = Window.partitionBy("grp", "slot").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = bundles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(small_side(names), ["grp", "slot"]).select(F.col("name").alias("item"), "rank", "doc", "score")


_COUNTED = """SELECT {id}, t AS term, COUNT(*) AS tf FROM (SELECT {id}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS t
    FROM {table}) GROUP BY {id}, t"""

_SQL = f"""WITH d AS ({_COUNTED.format(id="doc_id", term=_TERM, table="documents")}),
q AS ({_COUNTED.format(id="item_id", term=_TERM, table="benchmark")}),
n AS (SELECT doc_id, CAST(SUM(tf) AS BIGINT) AS n FROM d GROUP BY doc_id),
a AS (SELECT COUNT(*) AS total, CAST(SUM(n) AS BIGINT) AS len FROM n),
m AS (SELECT doc_id, 100 - 25 + (25 * n * total) // len AS m FROM n, a),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, COUNT(*) AS df FROM d GROUP BY term), a),
s AS (SELECT item_id, doc_id, CAST(SUM(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * m))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN d USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {K}"""


@query("op12_lexical_search", _SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")
