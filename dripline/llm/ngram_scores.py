"""Language-model scores of whole texts from an Elias-Fano n-gram trie.

The model is a bigram model with absolute discounting over an open vocabulary:

    P(w | v) = max(c(v w) - D, 0) / c(v)  +  D * successors(v) / c(v) * P(w)
    P(w)     = (1 - u) * c(w) / N for a known word, u for an unknown one, u = (words seen once + 0.5) / (N + 1)

After an unknown word P(w | v) is P(w). A text starts after a start mark and closes with an end token.

All counts cover all training texts. Texts are cut into chunks of about a million tokens, written once. A chunk asks
for its distinct words and bigrams only, at shards that own them: a shard adds up the counts of all chunks, builds its
part of the trie in mapped memory, and answers each chunk in the order it asked. Words are dealt to shards by hash,
bigrams by their first word; a first word with a large share of all tokens is spread over several shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from dripline.llm.catalog import query
from dripline.llm.common import bucket, by_offsets, bytes_of, lower_words, map_batches, table, written
from dripline.llm.elias_fano import Trie, probabilities

FOLDS, HELD_OUT = 5, 1
CHUNK_TOKENS, DISCOUNT = 1_000_000, 0.75
#: Chunks per shard: keeps both the rows of a shard and the number of pieces small.
CHUNKS_PER_SHARD = 4
_END = b" "  # never a word


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads numbers over all 64 bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Chunk:
    """Texts being gathered: their words get local numbers."""

    def __init__(self):
        self.ids, self.tokens, self.size = {_END: 0}, [], 0
        self.docs, self.train, self.lengths = [], [], []

    def add(self, doc, train: bool, text: bytes) -> None:
        number = self.ids.setdefault
        local = [number(w, len(self.ids)) for w in lower_words(text)]
        local.append(0)
        self.tokens.append(np.array(local, dtype=np.uint32))
        self.size += len(local)
        self.docs.append(doc)
        self.train.append(train)
        self.lengths.append(len(local))

    def row(self, chunk: int, shards: int) -> dict:
        tokens, words = np.concatenate(self.tokens), list(self.ids)
        use = np.repeat(np.array(self.train), self.lengths)
        common = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[common] = np.arange(len(words), dtype=np.uint32)
        tokens = rank[tokens]
        counts = np.bincount(tokens[use], minlength=len(words))
        digest = xxhash.xxh64_intdigest
        shard = np.fromiter((digest(words[i]) % shards for i in common), np.int64, len(words))
        order = np.argsort(shard, kind="stable")
        return {
            "chunk": chunk, "docs": self.docs, "train": self.train, "lengths": pack(np.array(self.lengths, "<u4")),
            "tokens": pack(tokens.astype("<u4")), "order": pack(order.astype("<u4")), "cuts": pack(np.bincount(shard, minlength=shards).astype("<u4")),
            "counts": pack(counts[order].astype("<i8")), "words": zstandard.ZstdCompressor(level=1).compress(b"\n".join(words[common[i]] for i in order)),
        }


def _chunks(docs: DataFrame, shards: int, text_col: str, id_col: str, chunk_tokens: int) -> DataFrame:
    names = ["chunk", "docs", "train", "lengths", "tokens", "order", "cuts", "counts", "words"]
    schema = (
        "chunk long, docs array<long>, train array<boolean>, lengths binary, tokens binary, order binary, cuts binary, "
        "counts binary, words binary"
    )
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, _Chunk()

        def out() -> pa.RecordBatch:
            row = held.row(part << 32 | number, shards)
            return pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, kinds)], names)

        for batch in batches:
            for doc, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2))):
                held.add(doc, train, text)
                if held.size >= chunk_tokens:
                    yield out()
                    held, number = _Chunk(), number + 1
        if held.docs:
            yield out()

    rows = docs.select(
        F.col(id_col).cast("long"), (bucket(id_col, FOLDS) != HELD_OUT).alias("train"), F.col(text_col).cast("binary").alias("text")
    )
    return written(map_batches(rows, run, schema), "chunks")


def _asked_words(chunks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(unpack(row["cuts"], "<u4").astype(np.int64))
                counts = unpack(row["counts"], "<i8")
                words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b"\n")
                small = zstandard.ZstdCompressor(level=1)
                at = [s for s in range(len(ends)) if (ends[s - 1] if s else 0) < ends[s]]
                cuts = [slice(int(ends[s - 1]) if s else 0, int(ends[s])) for s in at]
                yield pa.RecordBatch.from_arrays([
                    pa.array(at, pa.int32()), pa.array([row["chunk"]] * len(at), pa.int64()),
                    pa.array([small.compress(b"\n".join(words[c])) for c in cuts], pa.binary()),
                    pa.array([pack(counts[c]) for c in cuts], pa.binary()),
                ], ["shard", "chunk", "words", "counts"])

    return map_batches(chunks.select("chunk", "cuts", "counts", "words"), run, "shard int, chunk long, words binary, counts binary")


def _words(chunks: DataFrame, shards: int) -> DataFrame:
    """Answers (shard, chunk, ids, counts), and per shard a row without chunk: known words, tokens, words seen once."""

    def own(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, total, asked = int(key[0]), {}, []
        for data, counts in zip(pdf["words"], pdf["counts"]):
            words, n = zstandard.ZstdDecompressor().decompress(data).split(b"\n"), unpack(counts, "<i8")
            asked.append(words)
            for w, k in zip(words, n.tolist()):
                total[w] = total.get(w, 0) + k
        known = sorted(w for w, k in total.items() if k)
        ids = {w: i * shards + shard for i, w in enumerate(known)}
        out = [
            {"shard": shard, "chunk": chunk, "ids": pack(np.array([ids.get(w, -1) for w in words], "<i8")),
             "counts": pack(np.array([total[w] for w in words], "<i8"))}
            for chunk, words in zip(pdf["chunk"], asked)
        ]
        values = [total[w] for w in known]
        out.append({"shard": shard, "chunk": None, "known": len(known), "tokens": sum(values), "once": values.count(1)})
        frame = pd.DataFrame(out, columns=["shard", "chunk", "ids", "counts", "known", "tokens", "once"])
        return frame.astype({"chunk": "Int64", "known": "Int64", "tokens": "Int64", "once": "Int64"})

    schema = "shard int, chunk long, ids binary, counts binary, known long, tokens long, once long"
    return written(_asked_words(chunks).groupBy("shard").applyInPandas(own, schema), "word-answers")


class _Known:
    """What a chunk knows once its words are answered: numbers and counts of its words, its distinct bigrams."""

    def __init__(self, row: dict, facts: dict):
        order, shards = unpack(row["order"], "<u4"), facts["shards"]
        answers = sorted(row["answers"], key=lambda a: a["shard"])
        self.ids, self.counts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        self.ids[order] = np.concatenate([unpack(a["ids"], "<i8") for a in answers])
        self.counts[order] = np.concatenate([unpack(a["counts"], "<i8") for a in answers])
        self.tokens, self.lengths = unpack(row["tokens"], "<u4"), unpack(row["lengths"], "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        train = np.repeat(np.array(row["train"], dtype=bool), self.lengths)
        word, n = self.ids[self.tokens], self.counts[self.tokens]
        # Contexts: 0 is the start of a text, a known word its number + 1, an unknown one -1.
        context = np.concatenate([[0], np.where(word >= 0, word + 1, -1)[:-1]])
        total = np.concatenate([[0], n[:-1]])
        context[self.starts[:-1]], total[self.starts[:-1]] = 0, facts["texts"]
        self.context, self.total = context, total
        # An unknown word has the last number: no stored bigram holds it, but its context has to be asked for.
        self.pair = np.flatnonzero(context >= 0)
        key = context[self.pair] * facts["width"] + np.where(word >= 0, word, facts["width"] - 1)[self.pair]
        unique, first, self.back = np.unique(key, return_index=True, return_inverse=True)
        self.pair_train = np.bincount(self.back, train[self.pair], len(unique)).astype(np.int64)
        self.pair_context, self.pair_word = unique // facts["width"], unique % facts["width"]
        self.pair_total = total[self.pair][first]
        # A context with a large share of the tokens is spread over several shards by the second word.
        fan = np.minimum(1 + self.pair_total * 4 * shards // max(facts["tokens"], 1), shards)
        spot = (_mixed(self.pair_word) % fan.astype(np.uint64)).astype(np.int64)
        # Each of its shards is asked for the successors it counts: once more, with the unknown word.
        head = _runs(self.pair_context)
        head = head[fan[head] > 1]
        also = np.repeat(head, fan[head])
        self.pair_context = np.concatenate([self.pair_context, self.pair_context[also]])
        self.pair_word = np.concatenate([self.pair_word, np.full(len(also), facts["width"] - 1)])
        self.pair_total = np.concatenate([self.pair_total, self.pair_total[also]])
        self.pair_train = np.concatenate([self.pair_train, np.zeros(len(also), np.int64)])
        spot = np.concatenate([spot, np.arange(len(also)) - np.repeat(np.cumsum(fan[head]) - fan[head], fan[head])])
        self.shard = ((_mixed(self.pair_context) % np.uint64(shards)).astype(np.int64) + spot) % shards
        self.by_shard = np.lexsort((self.pair_context, self.shard))


def _joined(chunks: DataFrame, answers: DataFrame, more: DataFrame | None = None) -> DataFrame:
    own = answers.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("shard", "ids", "counts")).alias("answers"))
    out = chunks.select("chunk", "docs", "train", "lengths", "tokens", "order").join(own, "chunk")
    if more is None:
        return out
    more = more.groupBy("chunk").agg(F.collect_list(F.struct("shard", "codes", "kinds")).alias("pairs"))
    return out.join(more, "chunk", "left")


def _runs(context: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, np.int64)


def _asked_pairs(known: DataFrame, facts: dict) -> DataFrame:
    names = ["shard", "chunk", "contexts", "lengths", "totals", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                k = _Known(row, facts)
                shard = k.shard[k.by_shard]
                cuts = np.append(_runs(shard), len(shard))
                for i, j in zip(cuts[:-1], cuts[1:]):
                    at = k.by_shard[i:j]
                    context = k.pair_context[at]
                    first = _runs(context)
                    cols = [
                        np.diff(context[first], prepend=0).astype("<i8"), np.diff(np.append(first, len(at))).astype("<u4"),
                        k.pair_total[at][first].astype("<i8"), k.pair_word[at].astype("<i8"), k.pair_train[at].astype("<u4"),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard[i]], pa.int32()), pa.array([row["chunk"]], pa.int64()), *[pa.array([pack(c)], pa.binary()) for c in cols]],
                        names,
                    )

    return map_batches(known, run, "shard int, chunk long, contexts binary, lengths binary, totals binary, words binary, counts binary")


def trie_of(context: np.ndarray, word: np.ndarray, count: np.ndarray, total: np.ndarray, width: int, discount: float) -> Trie:
    """Trie of the n-grams that were counted; rows of one n-gram are added up."""
    key, back = np.unique(context * width + word, return_inverse=True)
    counts = np.bincount(back, count, len(key))
    totals = np.zeros(len(key))
    totals[back] = total
    use = counts > 0
    return Trie(key[use] // width, key[use] % width, (counts[use] - discount) / totals[use], width)


def _pairs(asked: DataFrame, facts: dict) -> DataFrame:
    """Answers (shard, chunk, codes of the bigrams, successors of the contexts) in the order asked."""

    def own(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples():
            contexts, lengths = np.cumsum(unpack(r.contexts, "<i8")), unpack(r.lengths, "<u4")
            totals = np.repeat(unpack(r.totals, "<i8"), lengths)
            rows.append((contexts, np.repeat(contexts, lengths), unpack(r.words, "<i8"), unpack(r.counts, "<u4"), totals))
        context, word, count, total = (np.concatenate([r[i] for r in rows]) for i in range(1, 5))
        trie = trie_of(context, word, count, total, facts["width"], facts["discount"])
        out = [
            (int(key[0]), chunk, pack(trie.look_up(c, w).astype("<u2")), pack(trie.successors(runs).astype("<u4")))
            for chunk, (runs, c, w, _, _) in zip(pdf["chunk"], rows)
        ]
        return pd.DataFrame(out, columns=["shard", "chunk", "codes", "kinds"])

    return written(asked.groupBy("shard").applyInPandas(own, "shard int, chunk long, codes binary, kinds binary"), "pair-answers")


def _scores(known: DataFrame, facts: dict) -> DataFrame:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v, unknown = facts["tokens"], facts["known"], (facts["once"] + 0.5) / (facts["tokens"] + 1.0)
        for batch in batches:
            for row in batch.to_pylist():
                k = _Known(row, facts)
                answers = sorted(row["pairs"] or [], key=lambda a: a["shard"])
                codes = np.zeros(len(k.by_shard), np.uint16)
                kinds = np.zeros(len(k.by_shard), np.int64)
                if answers:
                    codes[k.by_shard] = np.concatenate([unpack(a["codes"], "<u2") for a in answers])
                    # Successors were counted once per shard and context: add up the shards of a context.
                    shard, context = k.shard[k.by_shard], k.pair_context[k.by_shard]
                    new = np.concatenate([[True], (context[1:] != context[:-1]) | (shard[1:] != shard[:-1])])
                    part = np.concatenate([unpack(a["kinds"], "<u4") for a in answers])
                    unique, back = np.unique(context[new], return_inverse=True)
                    total = np.bincount(back, part, len(unique))
                    kinds = total[np.searchsorted(unique, k.pair_context)]
                counts = k.counts[k.tokens]
                single = np.where(counts > 0, (1 - unknown) * counts / max(n, 1), unknown)
                share = np.ones(len(k.tokens))
                total = k.total[k.pair]
                share[k.pair] = np.where(total > 0, facts["discount"] * kinds[k.back] / np.maximum(total, 1), 1.0)
                p = np.zeros(len(k.tokens))
                p[k.pair] = probabilities(codes)[k.back]
                score = np.log10(p + share * single)
                base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
                cols = [
                    pa.array(row["docs"], pa.int64()), pa.array([not t for t in row["train"]], pa.bool_()), pa.array(k.lengths),
                    pa.array(by_offsets((counts > 0).astype(np.int64), k.starts)),
                    pa.array(np.add.reduceat(base, k.starts[:-1])), pa.array(np.add.reduceat(score, k.starts[:-1])),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    out = map_batches(known, run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(facts["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def score_texts(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    discount: float = DISCOUNT,
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows outside the held-out fold and scores all rows, whole. Null and empty texts have the
    end token only. Rows with a null id are training rows; repeated rows count and are scored each. Without training
    rows every word is unknown. An empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, int(size) // 6 // chunk_tokens // CHUNKS_PER_SHARD, 1)
    chunks = _chunks(docs, shards, text_col, id_col, chunk_tokens)
    answers = _words(chunks, shards)
    got = answers.filter("chunk IS NULL").agg(F.sum("known"), F.sum("tokens"), F.sum("once"), F.max("known")).first()
    texts = chunks.agg(F.sum(F.size(F.filter("train", lambda t: t)))).first()[0]
    facts = {
        "known": got[0] or 0, "tokens": got[1] or 0, "once": got[2] or 0, "width": ((got[3] or 0) + 1) * shards + 1,
        "texts": texts or 0, "shards": shards, "discount": discount,
    }
    pairs = _pairs(_asked_pairs(_joined(chunks, answers), facts), facts)
    return _scores(_joined(chunks, answers, pairs), facts)


@query("op7_lm_scores")
def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
