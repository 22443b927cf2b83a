"""Quality rules, line first: judge every line, drop the failing ones, then reject texts that lost too much.

A line with words fails when it is
  * navigation or markup: symbols ``#*$%&|<>`` are more than 5 % of its characters,
  * shouting: runs of two or more ``!`` or ``?`` are more than a fifth of its words,
  * stuttering: at least 5 words, of which more than 30 % equal the word before,
  * a fragment: under 4 words and no closing punctuation,
  * boilerplate: at most 30 words and one of the phrases below.
Lines without a word are neither judged nor dropped. A text is kept if it passes the base rules and lost at most half
of its words with its lines.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from dripline.llm.catalog import query
from dripline.llm.common import by_offsets, per_text, table

#: Phrases that mark a short line as boilerplate. Fixed values.
PHRASES = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "click here",
    "read more",
    "share this",
    "sign up for",
    "subscribe to",
    "skip to content",
    "powered by",
    "lorem ipsum",
)
SYMBOLS = b"#*$%&|<>"
SYMBOL_PERCENT, SHOUT_PERCENT, STUTTER_PERCENT, STUTTER_WORDS = 5, 20, 30, 5
FRAGMENT_WORDS, BOILERPLATE_WORDS, LOST_PERCENT = 4, 30, 50
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8

_CONTINUATION = bytes(range(0x80, 0xC0))
_SHOUT = re.compile(rb"[!?]{2,}")
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)).encode())
_CLOSING = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "…".encode(), "。".encode())


def points(text: bytes) -> int:
    """Code points of UTF-8; in broken text every byte that isn't a continuation counts."""
    return len(text) if text.isascii() else len(text.translate(None, _CONTINUATION))


def line_fails(line: bytes, words: list[bytes]) -> bool:
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if 100 * symbols > SYMBOL_PERCENT * points(line):
        return True
    if 100 * len(_SHOUT.findall(line)) > SHOUT_PERCENT * n:
        return True
    if n >= STUTTER_WORDS and 100 * sum(map(eq, words, words[1:])) > STUTTER_PERCENT * n:
        return True
    if n < FRAGMENT_WORDS and not words[-1].endswith(_CLOSING):
        return True
    return n <= BOILERPLATE_WORDS and _PHRASE.search(line.lower()) is not None


def judge_lines(text: bytes) -> tuple[int, int, list[bytes]]:
    """Lines equal to an earlier one, words of failing lines, and the lines that stay."""
    seen: set[bytes] = set()
    dup = lost = 0
    stay = []
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            dup += line in seen
            seen.add(line)
            if line_fails(line, words):
                lost += len(words)
                continue
        stay.append(line)
    return dup, lost, stay


def repeated_words(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in that text.

    Windows are numbered exactly by doubling: the number of 2, 4, 8 words is the number of a pair of halves. The text
    is part of the first pair, so windows of two texts never meet.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = int(starts[-1])
    if n < window:
        return np.zeros(len(texts), dtype=np.int64)
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64, n)
    owner = np.repeat(np.arange(len(texts)), sizes)
    width = 1
    while width < window:
        step = min(width, window - width)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        width += step
    inside = owner[: len(rank)] == owner[window - 1 :]
    rank, owned, at = rank[inside], owner[: len(inside)][inside], np.flatnonzero(inside)
    key = rank * len(texts) + owned
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(n + 1, dtype=np.int64)
    hit = at[count[back] > 1]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return by_offsets((np.cumsum(edge[:n]) > 0).astype(np.int64), starts)


def judge_texts(texts: list[bytes]) -> list:
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    chars = [points(b"".join(w)) for w in words]
    symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
    repeats = repeated_words(words)
    lines = [judge_lines(t) for t in texts]
    lost = np.array([x[1] for x in lines], dtype=np.int64)
    failed = (n_words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
    kept = ~failed & (100 * lost <= LOST_PERCENT * n_words)
    clean = [b"\n".join(x[2]) for x in lines]
    return [n_words, chars, symbols, [x[0] for x in lines], repeats, lost, failed, kept, clean]


_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_words long, "
    "base_failed boolean, kept boolean, clean binary"
)


def line_rules(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Counts, verdicts and the cleaned text (UTF-8) of every row: (row, counts..., base_failed, kept, clean).

    Null and empty texts have no words and fail the base rules; long texts are read whole; repeated rows are judged
    alike, each by itself; an empty table gives an empty result; carried columns stay in ``row`` under their names.
    """
    return per_text(docs, judge_texts, _FIELDS, text_col, carry)


def cleaned(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents that are kept, with the columns of ``docs``: failing lines are gone, the length is counted anew.

    Texts that lost no line, and their lengths, are as they were.
    """
    out = line_rules(docs, text_col).filter("kept")
    clean = F.col("clean").cast("string")
    cols = []
    for c in docs.columns:
        old = F.col(f"row.`{c}`")
        new = clean if c == text_col else F.length(clean).cast(docs.schema[c].dataType) if c == chars_col else old
        cols.append(F.when(F.col("lost_words") > 0, new).otherwise(old).alias(c))
    return out.select(*cols)


_PHRASE_SQL = "|".join(PHRASES)
_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
judged AS (SELECT r, l, n, 100 * len(regexp_extract_all(l, '[#*$%&|<>]')) > 5 * length(l)
    OR 100 * len(regexp_extract_all(l, '[!?]{{2,}}')) > 20 * n
    OR (n >= 5 AND 100 * len(list_filter(range(2, n + 1), lambda i: ws[i] = ws[i - 1])) > 30 * n)
    OR (n < 4 AND NOT regexp_matches(ws[n], '[.!?:;"'')…。]$'))
    OR (n <= 30 AND regexp_matches(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASE_SQL}')) AS bad
    FROM (SELECT r, l, ws, len(ws) AS n FROM (SELECT r, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS ws FROM line)) WHERE n > 0),
lost AS (SELECT r, SUM(CASE WHEN bad THEN n ELSE 0 END) AS lost, COUNT(*) - COUNT(DISTINCT l) AS dup FROM judged GROUP BY r),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
cover AS (SELECT r, COUNT(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) AS j FROM rep) GROUP BY r),
base AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(lost.dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.lost, 0) AS BIGINT) AS lost_words
    FROM w LEFT JOIN lost ON lost.r = w.r LEFT JOIN cover ON cover.r = w.r)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_words <= 50 * n_words AS kept FROM base"""


@query("op9_quality_rules", _SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("row.doc_id", "*").drop("row", "clean")
