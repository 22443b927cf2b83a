"""Elias-Fano sequences in mapped memory, and a two-level n-gram trie made of them."""

from __future__ import annotations

import tempfile

import numpy as np


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in a nameless temporary file, mapped for reading: the system may drop and reload its pages."""
    if not array.nbytes:
        return array
    with tempfile.TemporaryFile() as f:
        f.write(array.tobytes())
        f.flush()
        return np.memmap(f, dtype=array.dtype, mode="r", shape=array.shape)


class EliasFano:
    """A sorted sequence of numbers under ``universe``: low bits packed, high bits as gaps in a bit vector."""

    def __init__(self, values: np.ndarray, universe: int):
        values = values.astype(np.uint64)
        self.n, self.universe = len(values), max(int(universe), 1)
        self.low_bits = max(0, (self.universe // max(self.n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << self.low_bits) - 1)
        shifts = np.arange(self.low_bits, dtype=np.uint64)
        packed = [np.empty(0, np.uint8)]
        # A multiple of eight values at a time keeps the pieces at whole bytes.
        for k in range(0, self.n, 1 << 16):
            bits = ((low[k : k + (1 << 16), None] >> shifts) & np.uint64(1)).astype(np.uint8)
            packed.append(np.packbits(bits.ravel(), bitorder="little"))
        self.low = mapped(np.concatenate([*packed, np.zeros(8, np.uint8)]))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.buckets = (self.universe >> self.low_bits) + 1
        bits = np.zeros(-(-(self.n + self.buckets) // 64) * 64, dtype=np.uint8)
        bits[high + np.arange(self.n)] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        self.high = mapped(words)
        zeros = 64 - np.bitwise_count(words).astype(np.int64)
        self.zeros = mapped(np.concatenate([[0], np.cumsum(zeros)]))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        windows = np.lib.stride_tricks.as_strided(self.low, (len(self.low) - 7, 8), (1, 1))
        words = np.ascontiguousarray(windows[bit >> 3]).view("<u8").ravel()
        return (words >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def _first(self, bucket: np.ndarray) -> np.ndarray:
        """Place of the first value whose high part is ``bucket`` or more: what stands before the bucket-th gap."""
        word = np.searchsorted(self.zeros, bucket, "left") - 1
        word = np.maximum(word, 0)
        left = bucket - self.zeros[word]
        gaps = np.unpackbits((~self.high[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = np.argmax(np.cumsum(gaps, axis=1, dtype=np.int16) == left[:, None], axis=1)
        return np.where(bucket > 0, word * 64 + inside - bucket + 1, 0)

    def successor(self, targets: np.ndarray, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """For each target the place of the first value that is not smaller, and whether it is the target itself."""
        place, hit = np.empty(len(targets), np.int64), np.zeros(len(targets), bool)
        for k in range(0, len(targets), block):
            t = targets[k : k + block].astype(np.int64)
            bucket = np.minimum(t >> self.low_bits, self.buckets - 1)
            lo, end = self._first(bucket), self._first(np.minimum(bucket + 1, self.buckets))
            hi, low = end.copy(), (t & ((1 << self.low_bits) - 1)).astype(np.uint64)
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                less = self._low(mid) < low[open_]
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
            place[k : k + block] = lo
            beyond = t >= self.universe
            place[k : k + block][beyond] = self.n
            inside = np.flatnonzero((lo < end) & ~beyond)
            hit[k + inside] = self._low(lo[inside]) == low[inside]
        return place, hit

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        at = np.asarray(at, dtype=np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        return ((ones[at] - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.zeros.nbytes


#: Logarithmic codes of probabilities in 16 bits, rounded down so that sums never exceed one; code 0 is none.
_DECADES, _CODES = 12.0, 65_535


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.floor((np.log10(p) / _DECADES + 1.0) * (_CODES - 1)) + 1
    return np.where(p > 0, np.clip(code, 1, _CODES), 0).astype(np.uint16)


def probabilities(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (((codes.astype(np.float64) - 1) / (_CODES - 1) - 1.0) * _DECADES), 0.0)


class Trie:
    """Contexts, a monotone pointer for each into its successors, and a quantised probability for each successor.

    Successors of one context are sorted; raised by ``rank of the context * width`` all of them are one monotone
    sequence, and the successor search of a word inside its context is a search in that sequence.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, p: np.ndarray, width: int):
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.empty(0, np.int64)
        self.width = width
        self.contexts = EliasFano(context[first], (int(context[-1]) if len(context) else 0) + 1)
        self.pointers = EliasFano(np.append(first, len(context)), len(context) + 1)
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        self.words = EliasFano(rank * width + word, max(len(first), 1) * width)
        self.codes = mapped(quantised(p))
        self.sizes = mapped(np.diff(np.append(first, len(context))).astype(np.int64))

    def look_up(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the given n-grams; 0 where one isn't stored."""
        rank, known = self.contexts.successor(context)
        out = np.zeros(len(context), np.uint16)
        at = np.flatnonzero(known)
        place, hit = self.words.successor(rank[at] * self.width + word[at])
        out[at[hit]] = self.codes[place[hit]]
        return out

    def successors(self, context: np.ndarray) -> np.ndarray:
        """How many different words follow each context."""
        rank, known = self.contexts.successor(context)
        out = np.zeros(len(context), np.int64)
        out[known] = self.sizes[rank[known]]
        return out
