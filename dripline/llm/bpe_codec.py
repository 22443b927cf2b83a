"""Byte-pair encoding and decoding of whole texts: distinct words form a trie, shared prefixes are encoded once."""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from dripline.llm.bpe_prefix import MEMO_PAIRS, MEMO_WORDS, Memo, vocabulary
from dripline.llm.catalog import query
from dripline.llm.common import per_text, table

#: White space of the word pattern. A border between other characters and white space is always a border of words.
_SPACE = r" \t\n\v\f\r\x85\xa0  -     　"
_CHUNK = regex.compile(rf"[{_SPACE}]*+[^{_SPACE}]++|[{_SPACE}]++")


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Codec:
    """Encodes and decodes with one vocabulary; remembers the ids of chunks (white space and what follows it).

    A lean codec remembers a quarter and takes a megabyte of text at a time: less memory, more work.
    """

    def __init__(self, path: str, lean: bool = False):
        self.vocab = vocabulary(path)
        self.known = Memo(MEMO_WORDS // 4 if lean else None)
        if lean:
            self.vocab.merges.most_pairs = MEMO_PAIRS // 4
        self.stride = 1 << 20 if lean else 1 << 62

    def chunks(self, text: str) -> list[str]:
        parts = self.vocab.segments(text)
        if len(parts) == 1:
            return _CHUNK.findall(text)
        return [c for i, p in enumerate(parts) for c in ([p] if i % 2 else _CHUNK.findall(p))]

    def learn(self, chunks) -> None:
        """Encode the chunks that aren't known yet: all their distinct words go through one trie."""
        new = self.known.missing(chunks)
        for c in new & self.vocab.specials.keys():
            self.known[c] = _packed([self.vocab.specials[c]])
            new.discard(c)
        words = {c: self.vocab.words(c) for c in new}
        ids = self.vocab.merges.encode(set(chain.from_iterable(words.values())))
        for c, ws in words.items():
            self.known[c] = _packed([i for w in ws for i in ids[w]])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, start, size = [], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size >= self.stride or end == len(texts):
                out += self._encode(texts[start:end])
                start, size = end, 0
        return out

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        cut = [self.chunks(t.decode("utf-8", "replace")) for t in texts]
        if len(self.known) < 1 or not all(map(self.known.__contains__, chain.from_iterable(cut))):
            self.learn([*chain.from_iterable(cut)])
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, packed: bytes) -> bytes:
        """Text of the ids in UTF-8; broken sequences become U+FFFD."""
        ids = array("I")
        ids.frombytes(packed)
        raw = b"".join(map(self.vocab.bytes.__getitem__, ids))
        return raw if raw.isascii() else raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(path: str, lean: bool = False) -> Codec:
    return Codec(path, lean)


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None, lean: bool = False) -> DataFrame:
    """(row, n_tokens, ids, decoded): ids as packed 32-bit integers and the text they decode to (UTF-8).

    Special tokens inside a text are tokens, as the library has it. Null counts as empty and has no ids; long texts
    are encoded whole; every row, repeated or not, gets its own result; an empty table gives an empty one.
    ``path`` is a file of the tokenizers library with byte-level words that every executor can open. ``lean`` is for
    jobs that share their executors with other steps.
    """

    def run(texts: list[bytes]) -> list:
        c = codec(path, lean)
        ids = c.encode(texts)
        return [[len(x) // 4 for x in ids], ids, [c.decode(x) for x in ids]]

    return per_text(docs, run, "n_tokens long, ids binary, decoded binary", text_col, carry)


def digests(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", lean: bool = False) -> DataFrame:
    out = encode_texts(docs, path, text_col, [id_col], lean)
    return out.select(
        F.col(f"row.`{id_col}`").alias(id_col),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_bpe_codec")
def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
