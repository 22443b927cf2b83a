"""Exact token counts of every prefix of a text, from counts of every prefix of its words.

A word (a run without ASCII white space) never shares a token with its neighbours, so the count of a text is a running
sum over words; inside a word the prefix table answers. Truncating to a budget, counting a prefix or fitting several
texts into a window then needs look-ups only.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate, chain

from pyspark.sql import DataFrame, SparkSession, functions as F

from dripline.llm.bpe_codec import default_path
from dripline.llm.bpe_prefix import MEMO_WORDS, Memo, vocabulary
from dripline.llm.catalog import query
from dripline.llm.common import per_text, table

LIMIT = 2048
#: Words that a Python process remembers with their counts.
REMEMBERED = 2 * MEMO_WORDS


class Counter:
    """Token counts with one vocabulary that drops white space and closes words by a mark."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.known = Memo(REMEMBERED)

    def prefixes(self, words, every: bool = True) -> dict[bytes, list[int]]:
        """Counts at every prefix of each word, by normalised byte; the last is the count of the whole word.

        Without ``every`` the prefixes stay inside the table and only counts after whole parts are given.
        """
        cut = {}
        for w in words:
            parts = self.vocab.segments(w.decode("utf-8", "replace"))
            cut[w] = [None if i % 2 else self.vocab.words(p) for i, p in enumerate(parts)]
        table = self.vocab.merges.prefix_counts({x for c in cut.values() for p in c if p for x in p}, every)
        out = {}
        for w, c in cut.items():
            counts = [0]
            for p in c:
                if p is None:
                    counts.append(counts[-1] + 1)
                for x in p or ():
                    done = counts[-1]
                    counts.extend(done + k for k in table[x][1:])
            out[w] = counts
        return out

    def counts(self, texts: list[bytes]) -> list[int]:
        cut = [t.split() for t in texts]
        if not all(map(self.known.__contains__, chain.from_iterable(cut))):
            new = self.known.missing(chain.from_iterable(cut))
            if not self.known:  # it was reset
                new = set(chain.from_iterable(cut))
            self.known.update((w, c[-1]) for w, c in self.prefixes(new, False).items())
        get = self.known.__getitem__
        return [sum(map(get, c)) for c in cut]

    def word_totals(self, text: bytes) -> list[int]:
        """Tokens of the first 0, 1, 2 ... words."""
        words = text.split()
        table = self.prefixes(set(words))
        return [0, *accumulate(table[w][-1] for w in words)]

    def fit(self, text: bytes, budget: int) -> int:
        """How many whole words from the start fit into ``budget`` tokens."""
        return bisect_right(self.word_totals(text), budget) - 1


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    docs: DataFrame, path: str, limit: int = LIMIT, text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """(row, n_bytes, n_tokens, over_limit) of every row.

    Null counts as empty: no bytes, no tokens. Long texts are counted whole, repeated rows each get their row, an
    empty table gives an empty result. Special tokens inside a text count as one.
    """
    out = per_text(docs, lambda t: [[len(x) for x in t], counter(path).counts(t)], "n_bytes long, n_tokens long", text_col, carry)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_tables(docs: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, totals): for every row the tokens of its first 0, 1, 2 ... words, for any later budget question."""
    run = lambda texts: [[counter(path).word_totals(t) for t in texts]]
    return per_text(docs, run, "totals array<bigint>", text_col, carry)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, default_path("word_bpe_49k.json"), carry=["doc_id"]).select("row.doc_id", "*").drop("row")
