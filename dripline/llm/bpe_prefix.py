"""Byte-pair encoding by the last token of every prefix.

The encoding of a prefix ends with exactly one token ``t`` for which the encoding of what stands before ``t`` stays
apart from ``t``: merging both together would give the same tokens. So the last token of every prefix follows from
the last tokens of shorter prefixes, and the whole encoding from walking back.

Two neighbours stay apart if no merge across their border comes first. While the merges of lower rank are made, the
right edge of the left token and the left edge of the right token grow; walking both growths in the order of their
ranks finds the first moment at which a merge across the border would win.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import regex

_NEVER = 1 << 60
#: Most remembered border decisions and words of one Python process; reset when full, results don't depend on it.
MEMO_PAIRS, MEMO_WORDS = 400_000, 400_000


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it is printable, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class Merges:
    """Merge table of one vocabulary; ``end`` is the mark that closes a word, if any."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = ""):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.end, self.rank, self.made = end, {}, {}
        for r, (a, b) in enumerate(pairs):
            if a + b in vocab:
                self.rank[vocab[a], vocab[b]] = r
                self.made.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._apart: dict[int, bool] = {}
        self.most_pairs = MEMO_PAIRS
        cut = len(end)
        self.inner, self.final = {}, {}
        for token, i in vocab.items():
            closed = bool(cut) and token.endswith(end) and len(token) > cut
            body = token[:-cut] if closed else token
            if len(body) == 1 or (i in self.made and self._sound(i)):
                (self.final if closed else self.inner)[body] = i
        if not cut:
            self.final = self.inner
        self.longest = max(map(len, chain(self.inner, self.final)), default=1)

    def _edges(self, token: int, side: int, memo: dict[int, list]) -> list[tuple[int, int]]:
        """Edge tokens on one side in the order they come to be, each with the rank of the merge that takes it in."""
        if token not in memo:
            if token in self.made:
                part, rank = self.made[token][side], self.made[token][2]
                memo[token] = [*self._edges(part, side, memo)[:-1], (part, rank), (token, _NEVER)]
            else:
                memo[token] = [(token, _NEVER)]
        return memo[token]

    def _meet(self, a: int, b: int) -> tuple[int, int] | None:
        """The edges that merge across the border of ``a`` and ``b`` first; None if they stay apart."""
        right, left = self._edges(a, 1, self._right), self._edges(b, 0, self._left)
        i = j = 0
        while True:
            (x, taken_x), (y, taken_y) = right[i], left[j]
            across = self.rank.get((x, y), _NEVER)
            # Of equal ranks the leftmost pair goes first: the one inside ``a``, then the border, then ``b``.
            if across < taken_x and across <= taken_y and across < _NEVER:
                return x, y
            if taken_x == taken_y == _NEVER:
                return None
            if taken_x <= taken_y:
                i += 1
            else:
                j += 1

    def _sound(self, token: int) -> bool:
        """Whether merging its own symbols gives the token."""
        a, b, _ = self.made[token]
        return self._meet(a, b) == (a, b) and all(t not in self.made or self._sound(t) for t in (a, b))

    def apart(self, a: int, b: int) -> bool:
        key = a << 24 | b
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= self.most_pairs:
                self._apart.clear()
            known = self._apart[key] = self._meet(a, b) is None
        return known

    def _last(self, word: str, i: int, last: list[int], tokens: dict[str, int]) -> tuple[int, int]:
        """Last token of ``word[:i]`` and where it starts. Only one fits, so the order of trying is free."""
        memo, j = self._apart, i - 1
        while j > 0:
            t = tokens.get(word[j:i])
            if t is not None:
                known = memo.get(last[j] << 24 | t)
                if known or known is None and self.apart(last[j], t):
                    return t, j
            j -= 1
        return tokens[word[:i]], 0

    def walk(self, words: Iterable[str], every: bool = False) -> Iterator[tuple[str, list, list, list]]:
        """Depth first through the trie of ``words``: (word, last, start, closed) of each.

        Sorted words are the trie in depth-first order: the states of the prefix that a word shares with the word
        before are on the stack already, so each node of the trie is computed once. ``last[i]`` and ``start[i]`` are
        the last token of the open prefix of length i and where it starts; ``closed[i]`` is the same pair for that
        prefix as a whole word with its end mark: for every prefix, or only for the whole word.
        """
        last, start, closed, before = [0], [0], [(0, 0)], ""
        inner, final, step = self.inner, self.final, self._last
        for word in sorted(words):
            n, top = 0, min(len(word), len(before))
            while n < top and word[n] == before[n]:
                n += 1
            del last[n + 1 :], start[n + 1 :], closed[n + 1 :]
            for i in range(n + 1, len(word) + 1):
                t, j = step(word, i, last, inner)
                last.append(t)
                start.append(j)
                if inner is final:
                    closed.append((t, j))
                else:
                    closed.append(step(word, i, last, final) if every or i == len(word) else None)
            if word and closed[-1] is None:
                closed[-1] = step(word, len(word), last, final)
            before = word
            yield word, last, start, closed

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        out = {}
        for word, last, start, closed in self.walk(words):
            ids = []
            if word:
                t, i = closed[-1]
                ids.append(t)
                while i:
                    ids.append(last[i])
                    i = start[i]
            out[word] = ids[::-1]
        return out

    def prefix_counts(self, words: Iterable[str], every: bool = True) -> dict[str, list[int]]:
        """For each word the token count of every prefix 0..n, each prefix taken as a whole word of its own.

        Counts of open prefixes are kept along the trie in any case; without ``every`` only the whole word is closed,
        and the list holds its count alone.
        """
        out = {}
        if not every:
            for word, _, start, closed in self.walk(words):
                out[word], i = [0], closed[-1][1]
                if word:
                    n = 1
                    while i:
                        n, i = n + 1, start[i]
                    out[word].append(n)
            return out
        counts = [0]  # of the open prefixes on the stack
        before = ""
        for word, _, start, closed in self.walk(words, every):
            n, top = 0, min(len(word), len(before))
            while n < top and word[n] == before[n]:
                n += 1
            del counts[n + 1 :]
            for i in range(n + 1, len(word) + 1):
                counts.append(counts[start[i]] + 1)
            before = word
            out[word] = [0, *[counts[j] + 1 for _, j in closed[1:]]]
        return out


class Vocabulary:
    """A tokenizer file: how it cuts text into words, its merges, and the bytes of its tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.chars = {i: c for i, c in byte_chars().items()}
        back = {c: i for i, c in self.chars.items()}
        mark = model["end_of_word_suffix"] or ""
        size = max(chain(model["vocab"].values(), self.specials.values())) + 1
        self.bytes = [b""] * size
        for token, i in model["vocab"].items():
            body, close = (token[: -len(mark)], b" ") if mark and token.endswith(mark) else (token, b"")
            self.bytes[i] = bytes(back[c] for c in body) + close
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.lower = bool(spec["normalizer"])
        pattern = (
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            if self.lower
            else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        self.cut = regex.compile(pattern)
        names = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def words(self, piece: str) -> list[str]:
        """Words of a piece of text without special tokens, in byte stand-ins."""
        if self.lower:
            piece = piece.lower() if piece.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", piece))
        return [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.chars) for w in self.cut.findall(piece)]

    def segments(self, text: str) -> list[str]:
        """Text cut at special tokens; these stand at the odd places."""
        return self.special.split(text) if self.special and "<" in text else [text]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo(dict):
    """Results by word, thinned out when it would grow over ``most`` words (``MEMO_WORDS`` unless set).

    Most words of a corpus come once. What was asked for again since the last thinning stays, the rest goes.
    """

    def __init__(self, most: int | None = None):
        self.most, self.again = most, set()

    def missing(self, wanted: Iterable) -> set:
        """What of ``wanted`` isn't known; makes room first."""
        wanted, most = set(wanted), self.most or MEMO_WORDS
        if len(self) >= most:
            kept = {w: self[w] for w in self.again} if len(self.again) <= most // 2 else {}
            self.clear()
            self.update(kept)
            self.again.clear()
        new = set(filterfalse(self.__contains__, wanted))
        self.again |= wanted - new
        return new
