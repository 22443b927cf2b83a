"""URL filters: pattern rules found by their rarest literal token.

A rule is a pattern over ``host + path + query`` of a URL. Every rule is filed under one literal token that any URL
it fits must contain as a whole token; of a rule's tokens the one that is rarest in the URLs is taken. A URL is cut
into tokens, its tokens fetch the candidate rules, and only those run their regular expression.

Pattern language: ``||`` at the start ties to a host or its subdomains, ``|`` at the end to the end of the URL,
``*`` is anything, ``^`` is one separator or the end. A leading ``@@`` allows instead of blocking.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dripline.llm.common import map_batches, table
from dripline.llm.catalog import query

#: Host and path rules of the contract: (verdict, rule). Fixed values.
SITE_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Pattern rules for everything the site rules leave open.
PATTERN_RULES = [
    "||doubleclick.net^",
    "||googlesyndication.com^",
    "/adserver/",
    "/wp-login.php",
    "/cart/checkout^",
    "/tracking/pixel^",
    "*.exe|",
    "*.torrent|",
    "^phpsessid=",
    "@@/press/tracking/pixel^",
]

_TOKEN = re.compile(r"[a-z0-9]+")
_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


def parts(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lower-cased), path and the rest of a URL; all empty without ``://``."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return _lower(host), tail[:stop], tail[stop:]


_UPPER = {i: i + 32 for i in range(65, 91)}


def _lower(text: str) -> str:
    return text.translate(_UPPER)


class Rule:
    """One rule: its regular expression, its tokens and what it says."""

    def __init__(self, pattern: str, verdict: str, name: str, site: bool):
        self.verdict, self.name, self.site = verdict, name, site
        self.regex, self.tokens = compile_site(pattern) if site else compile_pattern(pattern)


def compile_site(rule: str) -> tuple[re.Pattern, list[str]]:
    """Host and its subdomains, then the start of the path (case of the path counts)."""
    host, slash, path = rule.partition("/")
    # A host may hold a line break but no slash, and a path is empty or begins with one: so the parts stay apart.
    regex = re.compile(rf"(?:[^/]*\.)?{re.escape(host)}\n(?=/|\Z){re.escape(slash + path)}", re.DOTALL)
    closed = path if path and not _TOKEN.match(path[-1].lower()) else path[: len(path) - len(re.search(r"[A-Za-z0-9]*$", path)[0])]
    return regex, _TOKEN.findall(host) + _TOKEN.findall(_lower(closed))


def compile_pattern(pattern: str) -> tuple[re.Pattern, list[str]]:
    """Regular expression of a pattern rule and the tokens that stand whole in every URL it fits."""
    body, start = (pattern[2:], True) if pattern.startswith("||") else (pattern, False)
    body, stop = (body[:-1], True) if body.endswith("|") else (body, False)
    text = "".join(".*" if c == "*" else _SEPARATOR if c == "^" else re.escape(c) for c in _lower(body))
    regex = re.compile((r"(?:[^\n/?#]*\.)?" if start else ".*?") + text + ("$" if stop else ""), re.DOTALL)
    tokens = []
    for m in _TOKEN.finditer(_lower(body)):
        left = body[m.start() - 1] if m.start() else ("" if start else "*")
        right = body[m.end()] if m.end() < len(body) else ("" if stop else "*")
        if left != "*" and right != "*":
            tokens.append(m[0])
    return regex, tokens


def make_rules(site_rules: Iterable[tuple[str, str]], patterns: Iterable[str]) -> list[Rule]:
    rules = [Rule(r, v, r, True) for v, r in site_rules]
    for p in patterns:
        allow = p.startswith("@@")
        rules.append(Rule(p[2:] if allow else p, "allow" if allow else "block", p, False))
    return rules


class RuleIndex:
    """Rules by their rarest token; rules without a token are candidates of every URL."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token, self.always = defaultdict(list), []
        for rule in rules:
            if rule.tokens:
                self.by_token[min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(rule)
            else:
                self.always.append(rule)

    def judge(self, url: str | None, default: str = "allow") -> tuple[str, str, str | None, str]:
        """Host, path, the site rule that fits (longest), and the verdict.

        Without a site rule an allowing pattern wins over a blocking one; without any, ``default``.
        """
        host, path, rest = parts(url)
        site_text, text = f"{host}\n{path}", _lower(f"{host}{path}{rest}")
        found: set[Rule] = set(self.always)
        for token in set(_TOKEN.findall(text)):
            found.update(self.by_token.get(token, ()))
        best, verdict = None, default
        for rule in found:
            if rule.site:
                if (best is None or len(rule.name) > len(best.name)) and rule.regex.match(site_text):
                    best = rule
            elif verdict != "allow!" and host and rule.regex.match(text):
                verdict = "allow!" if rule.verdict == "allow" else "block"
        if best is not None:
            return host, path, best.name, best.verdict
        return host, path, None, verdict.rstrip("!")


def rule_token_counts(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each token of the rules. Every URL is counted; the result has one row per rule token."""
    wanted = frozenset(t for r in rules for t in r.tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                seen.update(wanted.intersection(_TOKEN.findall(_lower("".join(parts(url))))))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = map_batches(pages.select(url_col), count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in rows.collect()}


def filter_urls(
    pages: DataFrame,
    site_rules: Iterable[tuple[str, str]] = tuple(SITE_RULES),
    patterns: Iterable[str] = tuple(PATTERN_RULES),
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Verdict on every URL: (id, host, path, rule, verdict).

    Null or a URL without ``://``: empty host and path, no rule, the default verdict. Repeated rows each get their
    row; other columns are not read. An empty table gives an empty result. Rules are parameters held by every task.
    """
    rules = make_rules(site_rules, patterns)
    index = RuleIndex(rules, rule_token_counts(pages, rules, url_col))
    kind = pages.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [index.judge(u, default) for u in batch.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in cols)], ["id", "host", "path", "rule", "verdict"]
            )

    out = map_batches(
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")),
        judge,
        f"id {kind}, host string, path string, rule string, verdict string",
    )
    return out.withColumnRenamed("id", id_col)


def _sql() -> str:
    site = f"""FROM (SELECT * FROM (VALUES {', '.join(f"('{v}', '{r}')" for v, r in SITE_RULES)}) v(verdict, rule)) r
        WHERE (u.host = split_part(r.rule, '/', 1) OR u.host LIKE '%.' || split_part(r.rule, '/', 1))
          AND starts_with(u.path, substr(r.rule, strpos(r.rule, '/')))"""
    tests = {True: [], False: []}
    for p in PATTERN_RULES:
        allow = p.startswith("@@")
        regex = compile_pattern(p[2:] if allow else p)[0].pattern.replace("'", "''")
        tests[allow].append(f"regexp_matches(u.whole, '^(?:{regex})', 's')")
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    u AS (SELECT page_id, {lower.format("regexp_extract(rest, '^[^/?#]*', 0, 's')")} AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0, 's')) + 1), '^[^?#]*', 0, 's') AS path,
        {lower.format('rest')} AS whole FROM cut),
    hit AS (SELECT u.page_id, u.host, u.path, u.whole, (SELECT arg_max(r.rule, length(r.rule)) {site}) AS rule,
        (SELECT arg_max(r.verdict, length(r.rule)) {site}) AS said FROM u)
    SELECT page_id, host, path, rule, CASE WHEN said IS NOT NULL THEN said
        WHEN {' OR '.join(tests[True])} THEN 'allow'
        WHEN host <> '' AND ({' OR '.join(tests[False])}) THEN 'block' ELSE 'allow' END AS verdict FROM hit u"""


@query("op1_url_filters", _sql())
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
