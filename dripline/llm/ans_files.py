"""Token ids in files: static range asymmetric numeral systems with shared frequencies.

The ids of all documents are counted once; the counts, scaled to a power of two, are one table shared by all blocks.
Documents are placed in the order of their ids and packed into blocks of about a million ids. A block is coded by
many interleaved lanes (id ``i`` belongs to lane ``i % lanes``), stands alone, and holds

    magic, sizes | document ids and lengths | checkpoints (states of all lanes and place in the stream) | stream | crc32

The first checkpoint starts the block; any other lets a reader start there, so parts of a block can be decoded at the
same time. A folder holds ``blocks`` (Parquet records of blocks with their place) and ``frequencies`` (one record).
"""

from __future__ import annotations

import json
import os
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dripline.llm.bpe_codec import default_path
from dripline.llm.bpe_prefix import MEMO_WORDS, Memo
from dripline.llm.catalog import query
from dripline.llm.common import map_batches, small_side, table, written
from dripline.session import scratch_path

END, SCALE_BITS, LANES, BLOCK_IDS, CHECKPOINT_STEPS = 2, 20, 2048, 1 << 20, 256
_LOW = np.uint64(1 << 31)
_HEAD = "<4sIIIIII"  # magic, ids, lanes, documents, checkpoints, stream words, crc32 of the frequencies
MAGIC = b"rANS"


class Frequencies:
    """Counts scaled to ``2**SCALE_BITS`` slots; every id that occurs has a slot at least."""

    def __init__(self, scaled: np.ndarray):
        self.scaled = scaled.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.scaled)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(scaled.astype("<u4").tobytes())
        self.limit = ((_LOW >> np.uint64(SCALE_BITS)) << np.uint64(32)) * self.scaled
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        """Id of each slot."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.scaled), dtype=np.uint32), self.scaled.astype(np.int64))
        return self._slots

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Frequencies:
        counts = counts.astype(np.int64)
        slots, seen = 1 << SCALE_BITS, counts > 0
        if not seen.any():
            counts, seen = np.ones(1, np.int64), np.ones(1, bool)
        if seen.sum() > slots:
            raise ValueError("more ids than slots")
        spare = slots - int(seen.sum())
        share = counts / counts.sum() * spare
        scaled = np.floor(share).astype(np.int64) + seen
        order = np.lexsort((np.arange(len(counts)), -(share - np.floor(share))))
        scaled[order[: slots - int(scaled.sum())]] += 1
        return cls(scaled)


def encode_block(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, freq: Frequencies) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, -(-n // 64)))
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, dtype=np.uint64)
    bits, word = np.uint64(SCALE_BITS), np.uint64(0xFFFFFFFF)
    words, marks = [], []
    total = 0
    for t in range(steps - 1, -1, -1):
        symbols = ids[t * lanes : (t + 1) * lanes]
        live = state[: len(symbols)]
        f = freq.scaled[symbols]
        full = live >= freq.limit[symbols]
        words.append((live[full] & word).astype("<u4"))
        total += len(words[-1])
        live[full] >>= np.uint64(32)
        whole = live // f
        live[:] = (whole << bits) + (live - whole * f) + freq.start[symbols]
        if t % CHECKPOINT_STEPS == 0:
            marks.append((total, state.tobytes()))
    stream = np.concatenate(words[::-1]).tobytes() if words else b""
    marks = [struct.pack("<I", total - at) + s for at, s in reversed(marks)]
    head = struct.pack(_HEAD, MAGIC, n, lanes, len(lengths), len(marks), total, freq.crc)
    body = b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), *marks, stream])
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block as read: its documents, and its ids from any checkpoint on."""

    def __init__(self, data: bytes, freq: Frequencies):
        body, (crc,) = data[:-4], struct.unpack("<I", data[-4:])
        magic, self.n, self.lanes, docs, marks, words, table_crc = struct.unpack_from(_HEAD, body)
        if magic != MAGIC or zlib.crc32(body) != crc or table_crc != freq.crc:
            raise ValueError("not a sound block of these frequencies")
        at = struct.calcsize(_HEAD)
        self.doc_ids = np.frombuffer(body, "<i8", docs, at)
        self.lengths = np.frombuffer(body, "<u4", docs, at + 8 * docs)
        at += 12 * docs
        self.marks = [at + k * (4 + 8 * self.lanes) for k in range(marks)]
        self.stream = np.frombuffer(body, "<u4", words, at + marks * (4 + 8 * self.lanes))
        self.body, self.freq = body, freq

    def part(self, k: int) -> np.ndarray:
        """Ids between checkpoint ``k`` and the next."""
        (at,) = struct.unpack_from("<I", self.body, self.marks[k])
        state = np.frombuffer(self.body, "<u8", self.lanes, self.marks[k] + 4).copy()
        first = k * CHECKPOINT_STEPS * self.lanes
        stop = min(self.n, first + CHECKPOINT_STEPS * self.lanes)
        out = np.empty(stop - first, dtype=np.uint32)
        freq, bits, mask = self.freq, np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
        for i in range(0, stop - first, self.lanes):
            live = state[: min(self.lanes, stop - first - i)]
            slot = live & mask
            symbols = freq.slots[slot]
            out[i : i + len(live)] = symbols
            live[:] = freq.scaled[symbols] * (live >> bits) + slot - freq.start[symbols]
            low = np.flatnonzero(live < _LOW)
            live[low] = (live[low] << np.uint64(32)) | self.stream[at : at + len(low)]
            at += len(low)
        return out

    def ids(self) -> np.ndarray:
        return np.concatenate([self.part(k) for k in range(len(self.marks))]) if self.marks else np.empty(0, np.uint32)


#: Words of one request to the library, and what stands between them: one token that no other word ends with.
ASKED, MARK = 64, "\x01"
#: Words that a Python process remembers with their ids.
REMEMBERED = 2 * MEMO_WORDS
#: How a vocabulary lowers and cuts text if ASCII words may be lowered and punctuation after them asked for apart.
STEPS = ["NFC", "Replace", "Lowercase"]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class LibraryIds:
    """Ids of the tokenizers library, asked once per word: white space splits and is dropped by this vocabulary.

    A request has a fixed cost, so many words are asked as one text. Words of Latin letters are one piece each and end
    with the token that closes it; others are parted by ``MARK``. Words that differ in ASCII capitals or in the
    punctuation after them are asked once, if the vocabulary makes such pieces of them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values(), default=-1) + 1
        self.known = Memo(REMEMBERED)
        marks = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = marks[0] if len(marks) == 1 else None
        spec = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cut = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.close = spec["model"].get("end_of_word_suffix")
        self.plain = bool(self.close) and steps == STEPS and cut == PIECES
        self.closes = np.zeros(self.size, dtype=bool)
        if self.plain:
            self.closes[[i for t, i in vocab.items() if t.endswith(self.close)]] = True
        # For words in lower case that are one piece each: the same model without the steps that find that out.
        self.lowered = Tokenizer(self.tokenizer.model)
        steps = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.lowered.pre_tokenizer = pre_tokenizers.Sequence(steps)

    @staticmethod
    def _request(tokenizer, texts: list[str], mark: str, ends: np.ndarray) -> list[bytes]:
        """Ids of each text, asked ``ASKED`` at a time; the ids marked in ``ends`` end a text, a ``mark`` is left out."""
        if not texts:
            return []
        between = f" {mark} " if mark else " "
        asked = [between.join([*texts[k : k + ASKED], ""]) for k in range(0, len(texts), ASKED)]
        got = tokenizer.encode_batch_fast(asked, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in got), "<u4")
        last = np.flatnonzero(ends[ids])
        if len(last) != len(texts):
            raise ValueError("the requests can't be parted into words")
        data, stops = ids.tobytes(), (4 * last + (0 if mark else 4)).tolist()
        starts = [0, *(4 * last + 4).tolist()]
        return [data[a:b] for a, b in zip(starts, stops)]

    def _ask(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        texts = [w.decode("utf-8", "replace") for w in words]
        # Latin-1 letters stay single letters in every step, so such a word is one piece.
        letters = [self.plain and t.isalpha() and (t.isascii() or max(t) < "\u0100") for t in texts]
        alone = [not a and (self.mark is None or MARK in t) for t, a in zip(texts, letters)]
        marked = [not a and not b for a, b in zip(letters, alone)]
        single = self.tokenizer.encode_batch_fast(list(compress(texts, alone)), add_special_tokens=False)
        is_mark = np.arange(self.size) == (-1 if self.mark is None else self.mark)
        of_letters = iter(self._request(self.lowered, [t.lower() for t in compress(texts, letters)], "", self.closes))
        of_marked = iter(self._request(self.tokenizer, list(compress(texts, marked)), MARK, is_mark))
        of_alone = (np.array(e.ids, "<u4").tobytes() for e in single)
        return [next(of_letters if a else of_alone if b else of_marked) for a, b in zip(letters, alone)]

    def _parts(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Each word as a word in lower case and the punctuation after it: together they have the same ids.

        Punctuation is a piece of its own after an ASCII letter or digit or one of À to ÿ (0xC3 and another byte in
        UTF-8). Words with ``<`` may hold special tokens.
        """
        heads, tails = [], []
        for w in words:
            head = w.rstrip(TAIL)
            if not head[-1:].isalnum() and (head[-2:-1] != b"\xc3" or head[-1:] in b"\x97\xb7"):  # × and ÷
                head = w
            tails.append(w[len(head) :])
            heads.append(head.lower() if head.isascii() and b"<" not in head else head)
        return heads, tails

    def _learn(self, words: list[bytes]) -> None:
        if not self.plain:
            self.known.update(zip(words, self._ask(words)))
            return
        heads, tails = self._parts(words)
        wanted = {*heads, *tails} - {b""}
        new = [p for p in wanted if p not in self.known]
        self.known.again |= wanted.difference(new)
        self.known.update(zip(new, self._ask(new)))
        get = self.known.__getitem__
        self.known.update((w, get(h) + get(t) if t else get(h)) for w, h, t in zip(words, heads, tails))

    def learn(self, wanted: list[bytes]) -> None:
        new = self.known.missing(wanted)
        if not self.known:  # it was reset
            new = set(wanted)
        words = list(new)
        for k in range(0, len(words), 20_000):
            self._learn(words[k : k + 20_000])

    def ids_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a binary column, place after the last id of each); null is empty.

        Arrow cuts the texts and tells distinct words, so only these become Python objects.
        """
        column = column.fill_null(b"")
        texts = pa.Array.from_buffers(pa.string(), len(column), [None, *column.buffers()[1:]], offset=column.offset)
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        forms = words.dictionary
        if self.plain:  # ASCII letters and punctuation after them: as ``_parts`` does, without Python objects
            heads = pc.ascii_rtrim(forms, TAIL.decode())
            simple = pc.ascii_is_alpha(heads)
            tails = pc.if_else(simple, pc.ascii_ltrim(forms, string.ascii_letters), "")
            heads = pc.if_else(simple, pc.ascii_lower(heads), forms)
            pieces = pa.concat_arrays([heads, tails]).dictionary_encode()
        else:
            pieces = forms.dictionary_encode()
        found = pieces.dictionary
        distinct = pa.Array.from_buffers(pa.binary(), len(found), [None, *found.buffers()[1:]], offset=found.offset).to_pylist()
        self.learn([w for w in distinct if w])  # an empty word: no tail, or white space at an end of a text
        get = self.known.__getitem__
        coded = pa.array([get(w) if w else w for w in distinct], pa.binary()).take(pieces.indices)
        if self.plain:
            coded = pc.binary_join_element_wise(coded[: len(forms)], coded[len(forms) :], b"")
        coded = coded.take(words.indices)
        _, offsets, data = coded.buffers()
        places = np.frombuffer(offsets, "<i4", len(coded) + 1, 4 * coded.offset) if len(coded) else np.zeros(1, "<i4")
        ids = np.frombuffer(data, "<u4", int(places[-1]) // 4) if places[-1] else np.empty(0, "<u4")
        return ids, places[cut.offsets.to_numpy()[1:]].astype(np.int64) // 4

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ids, ends = self.ids_of(pa.array(texts, pa.binary()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def library(path: str) -> LibraryIds:
    return LibraryIds(path)


def encoded(docs: DataFrame, path: str, kind: str, text_col: str, id_col: str, end: int) -> DataFrame:
    """(doc, ids): the ids of every text and its end as packed numbers, written once; the library is not asked again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, ends = library(path).ids_of(batch.column(1))
            ids = np.insert(ids, ends, end).astype(kind)
            ends = np.append(0, ends + np.arange(1, len(ends) + 1)) * ids.itemsize
            values = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc", "ids"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))
    return written(map_batches(texts, run, "doc long, ids binary"), "encoded")


def id_counts(ids: DataFrame, kind: str) -> DataFrame:
    """(id, n): counts of all ids of all texts. A task gives one row per id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column(0)
            _, offsets, data = column.buffers()
            ends = np.frombuffer(offsets, "<i4", len(column) + 1, 4 * column.offset) // np.dtype(kind).itemsize
            got = np.bincount(np.frombuffer(data, kind)[ends[0] : ends[-1]], minlength=len(total))
            got[: len(total)] += total
            total = got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return map_batches(ids.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, folder: str, path: str, text_col: str = "text", id_col: str = "doc_id", end: int = END) -> None:
    """Write the ids of all documents, each closed by ``end``, in ascending order of their document ids.

    Null texts have the end id only; null document ids come first and are written as the smallest number; repeated
    rows are written each. Texts are never cut: a block takes whole documents and ends with the one that fills it.
    """
    spark = docs.sparkSession
    kind = "<u2" if max(library(path).size, end + 1) <= 1 << 16 else "<u4"
    texts = encoded(docs, path, kind, text_col, id_col, end)
    rows = id_counts(texts, kind).collect()  # one row per id of the vocabulary at most
    counts = np.zeros(max([end, *(r.id for r in rows)]) + 1, dtype=np.int64)
    for r in rows:
        counts[r.id] = r.n
    freq = Frequencies.of_counts(counts)
    scaled = freq.scaled.astype("<u4").tobytes()
    spark.createDataFrame([(bytearray(scaled),)], "scaled binary").coalesce(1).write.parquet(f"{folder}/frequencies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = Frequencies(np.frombuffer(scaled, "<u4"))
        part, number = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        owners: list[int] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), kind).astype("<u4")
            lengths = np.array([len(x) for x in held], dtype=np.int64) // np.dtype(kind).itemsize
            data = encode_block(ids, np.array(owners, dtype=np.int64), lengths, freq)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()),
                "ids": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary()),
            })

        for batch in batches:
            for owner, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(ids)
                owners.append(-(1 << 63) if owner is None else owner)
                size += len(ids) // np.dtype(kind).itemsize
                if size >= BLOCK_IDS:
                    yield block()
                    held, owners, size, number = [], [], 0, number + 1
        if held:
            yield block()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = texts.repartitionByRange(n, "doc", F.xxhash64("ids")).sortWithinPartitions("doc", F.xxhash64("ids"))
    map_batches(placed, run, "part int, block int, ids long, data binary").write.parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a folder: ``start`` counts the ids of all documents before it."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    (row,) = spark.read.parquet(f"{folder}/frequencies").collect()
    scaled = bytes(row.scaled)
    places = blocks.select("part", "block", "ids")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = places.groupBy("part").agg(F.sum("ids").alias("n"))
    parts = parts.select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("first"))
    starts = places.withColumn("inside", F.sum("ids").over(before)).join(parts, "part")
    starts = starts.select("part", "block", (F.coalesce("first", F.lit(0)) + F.coalesce("inside", F.lit(0))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = Frequencies(np.frombuffer(scaled, "<u4"))
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block = Block(data, freq)
                ids = block.ids()
                ends = np.cumsum(block.lengths.astype(np.int64))
                starts = ends - block.lengths
                for k in range(0, len(ends), 1000):
                    s, e = starts[k : k + 1000], ends[k : k + 1000]
                    owner = pa.array(block.doc_ids[k : k + 1000], mask=block.doc_ids[k : k + 1000] == -(1 << 63))
                    texts = pa.array([ids[i:j].tobytes() for i, j in zip(s, e)], pa.binary())
                    yield pa.RecordBatch.from_arrays([owner, pa.array(at + s), texts], ["doc_id", "start", "ids"])

    return map_batches(blocks.join(small_side(starts), ["part", "block"]).select("at", "data"), run, "doc_id long, start long, ids binary")


@query("op6_ans_files")
def op6_ans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), folder, default_path("word_bpe_49k.json"))
    return read_ids(spark, folder).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
