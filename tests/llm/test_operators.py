"""Each operator against brute force or its library, and on nulls, empty and long texts, ties, repeats, empty tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dripline.llm import (
    ans_files,
    bpe_codec,
    exact_topk,
    line_rules,
    ngram_scores,
    pareto_mix,
    quality_trees,
    simhash_anchors,
    token_counts,
    url_rules,
)
from dripline.llm.elias_fano import EliasFano, Trie, probabilities
from dripline.session import scratch_path

LOW = {i: i + 32 for i in range(65, 91)}
ODD = [
    None, "", " \n\t ", "word", "The  quick\r\nbrown fox  jumps<|endoftext|>over <|startoftext|>it's 12½ Ⅷ ΣΑΣ é İ",
    "a\x1cb \x85 c  \n\n  d", "😀 中文 naïve " * 3, "same text here for all", "same text here for all", "x" * 3000, "long words go on " * 4000,
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate(LOW)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with an extra column whose name clashes with results, a repeated row and a null id."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0, 1.5) for i, t in enumerate(ODD)]
    rows += [rows[7], (None, "no id at all", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("1 = 0")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


# URL filters ----------------------------------------------------------------------------------------------------


def test_urls_follow_the_longest_rule_then_the_patterns(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme/org/": ("", "", None, "allow"),
        "http://A.ORG": ("a.org", "", None, "allow"),
        "http://a.org/": ("a.org", "/", "org/", "allow"),
        "http://www.Example.org/es/x?y": ("www.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/17#z": ("example.org", "/en/17", "example.org/en/1", "block"),
        "http://example.org/EN/1": ("example.org", "/EN/1", "org/", "allow"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"),
        "http://x.com/fr/1://org/": ("x.com", "/fr/1://org/", "com/fr/", "allow"),
        "http://ad.doubleclick.net/x": ("ad.doubleclick.net", "/x", None, "block"),
        "http://nodoubleclick.net/x": ("nodoubleclick.net", "/x", None, "allow"),
        "http://a.net/get/tool.EXE": ("a.net", "/get/tool.EXE", None, "block"),
        "http://a.net/tool.exe?v": ("a.net", "/tool.exe", None, "allow"),
        "http://a.net/tracking/pixel": ("a.net", "/tracking/pixel", None, "block"),
        "http://a.net/press/tracking/pixel": ("a.net", "/press/tracking/pixel", None, "allow"),
        "http://a.net/p?PHPSESSID=1": ("a.net", "/p", None, "block"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_rules.filter_urls(pages).collect()}
    assert got == {i: v for i, v in enumerate(cases.values())}
    assert url_rules.filter_urls(pages.filter("1 = 0")).count() == 0


def test_rules_are_found_as_by_trying_all():
    rules = url_rules.make_rules(url_rules.SITE_RULES, [*url_rules.PATTERN_RULES, "*a*", "/x^y"])
    index = url_rules.RuleIndex(rules, {})
    everything = url_rules.RuleIndex([], {})
    everything.always = rules
    rng = np.random.default_rng(3)
    bits = ["http://", "org", "com", ".", "/", "example", "es", "en/1", "de", "a", "x", "y", "?", ".exe", "doubleclick.net", "cart/checkout"]
    for _ in range(3000):
        url = "".join(rng.choice(bits, rng.integers(1, 9)))
        assert index.judge(url) == everything.judge(url), url


# Quality rules --------------------------------------------------------------------------------------------------


def brute_rules(text):
    ws, n = words(text), len(words(text))
    count = Counter(tuple(ws[i : i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if count[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def test_line_rules_count_as_brute_force(spark, odd, docs, none):
    for table in (odd, docs.limit(80)):
        got = line_rules.line_rules(table, carry=["text"]).collect()
        assert len(got) == table.count()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(r.row.text)
            assert not (r.kept and r.base_failed)
    assert line_rules.cleaned(none).columns == none.columns and line_rules.cleaned(none).count() == 0


def test_failing_lines_go_and_clean_texts_stay(spark):
    body = "Every good line of this text has some words and it closes with a stop."
    other = "Another line says something else so that nothing in here repeats at all today."
    bad = ["Home | News | About | Contact", "BUY!! NOW!! IT!! IS!! CHEAP!!", "go go go go go go.", "Menu", "All rights reserved."]
    rows = [(0, f"{body}\n{other}", 1), (1, "\n".join([body, *bad, "", other]), 2), (2, "\n".join([body, *bad * 3, other]), 3)]
    out = {r.doc_id: r for r in line_rules.cleaned(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert set(out) == {0, 1}
    assert out[0].text == rows[0][1] and out[0].n_chars == 1
    assert out[1].text == f"{body}\n\n{other}" and out[1].n_chars == len(out[1].text)
    for line in bad:
        assert line_rules.line_fails(line.encode(), line.encode().split())


# Quality classifier ---------------------------------------------------------------------------------------------


def test_trees_learn_and_never_see_the_held_out_fold(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    trees = quality_trees.train(docs, labels)
    out = quality_trees.score(docs, trees, carry=["doc_id"]).select("row.doc_id", "score", "predicted")
    got = {r.doc_id: r for r in out.collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = np.mean([got[r.doc_id].predicted == r.quality for r in held])
    assert right >= 0.9
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_trees.train(docs, flipped)
    assert np.array_equal(again.value, trees.value) and np.array_equal(again.cut, trees.cut)


def test_trees_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    trees = quality_trees.train(odd, labels)
    got = quality_trees.score(odd, trees).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_trees.score(none, quality_trees.train(none, labels)).count() == 0


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] < -0.5)).astype(float)
    t = quality_trees.fit_trees(x, y, trees=15)

    def walk(row):
        total = t.bias
        for node in t.roots:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.cut[node] else t.right[node]
            total += t.value[node]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(t.score(x), [walk(r) for r in x])
    assert ((t.score(x) >= 0.5) == y).mean() > 0.95


# SimHash --------------------------------------------------------------------------------------------------------


def brute_print(text):
    ws = words(lower(text))
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids, bits):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(prints))]


def test_simhash_equals_brute_force(odd, docs, none):
    for table in (odd, docs):
        rows = table.select("doc_id", "text").collect()
        prints = [brute_print(r.text) for r in rows]
        want = Counter(zip([r.doc_id for r in rows], prints, brute_components(prints, [r.doc_id for r in rows], 3)))
        got = simhash_anchors.near_duplicates(table).collect()
        assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == want
    assert simhash_anchors.near_duplicates(none).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_anchor_links_connect_exactly_the_near_pairs(bits):
    rng = np.random.default_rng(bits)
    seeds = rng.integers(0, 2**64, 60, dtype=np.uint64)
    many = [int(s) for s in seeds]
    for s in seeds:
        for _ in range(12):
            many.append(int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False)))
    fps = np.unique(np.array(many, dtype=np.uint64)).view(np.int64)
    anchor, fp, home = simhash_anchors.Anchors(bits).of(fps)
    order = np.lexsort((~home, anchor))
    links = simhash_anchors.links_at(anchor[order], fp[order], home[order], bits)
    prints = [int(x) & (2**64 - 1) for x in fps]
    want = brute_components(prints, range(len(prints)), bits)
    parent = {int(x): int(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() <= 2 * bits
        parent[root(int(a))] = root(int(b))
    groups = [root(int(x)) for x in fps]
    assert len(set(zip(groups, want))) == len(set(groups)) == len(set(want))


def test_hot_anchors_are_tiled_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash_anchors, "TILE_HOMES", 8)
    base = 0x0123456789ABCDEF
    prints = [base ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)]
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = simhash_anchors.near_links(fps).collect()
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a & (2**64 - 1))] = root(b & (2**64 - 1))
    assert len({root(p) for p in prints}) == len(set(brute_components(prints, range(len(prints)), 3)))


def test_one_document_of_each_group_stays(odd):
    kept = simhash_anchors.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    heads = {r.component_id for r in simhash_anchors.near_duplicates(odd).collect()}
    assert Counter(i for i in ids if i is not None) == Counter(h for h in heads if h is not None)
    assert ids.count(None) == 1


# Mixing ---------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not above:
            target.update({s: weight[s] * level for s in free})
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def test_mix_reaches_its_targets(docs, odd, none):
    for table in (docs, odd):
        rows = pareto_mix.mix(table).select("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "copies").collect()
        assert len(rows) == table.count()
        sizes, taken, largest = Counter(), Counter(), Counter()
        for r in rows:
            assert r["size"] == len(words(r.text)) and 0 <= r.copies <= 3
            sizes[r.source] += r["size"]
            taken[r.source] += r["size"] * r.copies
            largest[r.source] = max(largest[r.source], r["size"])
        want = brute_targets(sizes)
        for r in rows:
            assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        for s, t in want.items():
            assert abs(taken[s] - t) <= max(largest[s] / 2, 0.03 * t)
    assert pareto_mix.mix(none).count() == 0


def test_mix_is_repeatable_and_takes_whole_copies(docs):
    first, second = (Counter((r.doc_id,) for r in pareto_mix.mixed(docs.repartition(n)).select("doc_id").collect()) for n in (3, 7))
    assert first == second and pareto_mix.mixed(docs).columns == docs.columns


def test_narrowing_finds_the_cut_of_sorted_ranks(spark, monkeypatch):
    monkeypatch.setattr(pareto_mix, "FEW_ROWS", 5)
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.random(300), 10.0 ** -rng.uniform(1, 12, 300)])
    size = rng.integers(0, 40, 600)
    ranked = spark.createDataFrame([("s", int(s), float(x)) for s, x in zip(size, v)], "source_key string, size long, v double")
    order = np.argsort(v)
    for need in (0.0, 17.5, 3000.0, float(size.sum()) + 1):
        cut = pareto_mix._cut(ranked, spark.createDataFrame([("s", need)], "source_key string, need double")).first()
        got = size[(v < cut.low) | (v <= (cut.upto if cut.upto is not None else -1))].sum()
        sums = np.cumsum(size[order])
        assert got == max([0, *sums[sums <= need]]) and math.isclose(cut.missing, need - got, abs_tol=1e-6)


# BPE and token counts -------------------------------------------------------------------------------------------


def random_texts(n):
    rng = np.random.default_rng(11)
    alphabet = list("abcdeEHT  \n\t\r\x1c\x1f\x85\xa0 'sld1２½ßİΣσéé́ñ中文😀.,!?…—_`Ⅷ٣ᾼ​") + ["<|endoftext|>", "'ll", "the", "ing"]
    return ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(n)]


def test_bpe_encodes_and_decodes_as_the_library(odd, docs, none):
    path, t = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    for table in (odd, docs.limit(60)):
        got = bpe_codec.encode_texts(table, path, carry=["text"]).collect()
        assert len(got) == table.count()
        for r in got:
            ids = t.encode(r.row.text or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
            assert bytes(r.decoded).decode() == t.decode(ids, skip_special_tokens=False)
    assert bpe_codec.digests(none, path).count() == 0


def test_bpe_on_random_strings():
    texts = random_texts(1500)
    for name, vocabulary in (("byte_bpe_50k.json", bpe_codec.Codec), ("word_bpe_49k.json", token_counts.Counter)):
        path, t = public_tokenizers.path(name), library(name)
        want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        if vocabulary is bpe_codec.Codec:
            got = [np.frombuffer(x, "<u4").tolist() for x in vocabulary(path).encode([x.encode() for x in texts])]
            assert got == want
        else:
            assert vocabulary(path).counts([x.encode() for x in texts]) == [*map(len, want)]


def test_counts_of_every_prefix(odd, none):
    path, t = public_tokenizers.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    size = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    c = token_counts.Counter(path)
    for w in ("internationalization,don'tthorreou", "aaaaaaaaaaab", "x1y2...zz"):
        assert c.prefixes({w.encode()})[w.encode()] == [size(w[:i]) for i in range(len(w) + 1)]
    text = "The quick brown foxes, jumped overreachingly!"
    totals = [size(" ".join(text.split()[:i])) for i in range(len(text.split()) + 1)]
    assert c.word_totals(text.encode()) == totals
    for budget in range(totals[-1] + 2):
        assert c.fit(text.encode(), budget) == max(i for i, n in enumerate(totals) if n <= budget)
    got = token_counts.count_tokens(odd, path, limit=20, carry=["text"]).collect()
    for r in got:
        n = size(r.row.text or "")
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.row.text or "").encode()), n, n > 20)
    assert token_counts.count_tokens(none, path).count() == 0


# Token files ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 5, 3000, 700_000])
def test_blocks_round_trip_from_every_checkpoint(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_407).astype(np.uint32)
    freq = ans_files.Frequencies.of_counts(np.bincount(ids, minlength=3))
    data = ans_files.encode_block(ids, np.array([4, 9]), np.array([n, 0]), freq)
    block = ans_files.Block(data, ans_files.Frequencies(freq.scaled))
    assert np.array_equal(block.ids(), ids) and block.doc_ids.tolist() == [4, 9] and block.lengths.tolist() == [n, 0]
    step = ans_files.CHECKPOINT_STEPS * block.lanes
    for k in reversed(range(len(block.marks))):
        assert np.array_equal(block.part(k), ids[k * step : (k + 1) * step])
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        ans_files.Block(bytes(broken), freq)


def test_token_files_hold_all_documents_in_order(spark, odd, docs, none):
    t = library("word_bpe_49k.json")
    for table in (odd, docs, none):
        folder = scratch_path(spark, "ids")
        ans_files.write_ids(table, folder, public_tokenizers.path("word_bpe_49k.json"))
        got = sorted(ans_files.read_ids(spark, folder).collect(), key=lambda r: r.start)
        rows = table.select("doc_id", "text").collect()
        assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
        assert [r.start for r in got] == [0, *np.cumsum([len(r.ids) // 4 for r in got]).tolist()][: len(got)]
        want = Counter((r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in rows)
        assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want


# Language model -------------------------------------------------------------------------------------------------


def brute_scores(rows):
    texts = [
        (r.doc_id, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1, words(lower(r.text)) + ["\n"]) for r in rows
    ]
    c, pairs, before = Counter(), Counter(), Counter()
    for _, held, ws in texts:
        if not held:
            c.update(ws)
            pairs.update(zip(["\0 start", *ws], ws))
            before.update(["\0 start", *ws[:-1]])
    follow = Counter(a for a, _ in pairs)
    n, v, once = sum(c.values()), len(c), sum(k == 1 for k in c.values())
    u, d = (once + 0.5) / (n + 1), ngram_scores.DISCOUNT
    out = []
    for i, held, ws in texts:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        score = 0.0
        for a, w in zip(["\0 start", *ws], ws):
            p = (1 - u) * c[w] / n if c[w] else u
            if before[a]:
                p = max(pairs[a, w] - d, 0) / before[a] + d * follow[a] / before[a] * p
            score += math.log10(p)
        out.append((i, held, len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return out


@pytest.mark.parametrize("chunk", [500, 2_000_000])
def test_scores_equal_a_counted_model(odd, docs, none, chunk):
    for table in (odd, docs.limit(60)):
        rows = table.select("doc_id", "text").collect()
        key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
        got = sorted((tuple(r) for r in ngram_scores.score_texts(table, chunk_tokens=chunk).collect()), key=key)
        want = sorted(brute_scores(rows), key=key)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        for g, w in zip(got, want):
            assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=2e-3)
    assert ngram_scores.score_texts(none).count() == 0


def test_model_is_a_distribution():
    rng = np.random.default_rng(2)
    context, word = rng.integers(0, 30, 4000), rng.integers(0, 50, 4000)
    total = np.bincount(context)[context]
    trie = ngram_scores.trie_of(context, word, np.ones(4000), total, 51, 0.75)
    for c in range(30):
        p = probabilities(trie.look_up(np.full(51, c), np.arange(51)))
        rest = 0.75 * trie.successors(np.array([c]))[0] / total[context == c][0]
        assert 0.995 < p.sum() + rest <= 1.0 + 1e-12


@pytest.mark.parametrize("n,universe", [(0, 9), (1, 1), (7, 8), (900, 10**7), (900, 2**60), (900, 901)])
def test_elias_fano_finds_successors(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n))
    f = EliasFano(values, universe)
    asked = np.concatenate([values, rng.integers(0, 2 * universe, 300), [0, universe - 1, universe]])
    place, hit = f.successor(asked)
    assert np.array_equal(place, np.searchsorted(values, asked)) and np.array_equal(hit, np.isin(asked, values))
    assert np.array_equal(f[np.arange(n)].astype(np.int64), values)
    assert Trie(np.empty(0, int), np.empty(0, int), np.empty(0), 5).look_up(np.array([1]), np.array([2])).tolist() == [0]


# Top-k ----------------------------------------------------------------------------------------------------------


def brute_top(rows, k, every):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault((i, tuple(math.floor(256 * x) for x in v)))
    out = []
    for q, a in fine:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 240)] + [(i, [0.0] * 6) for i in range(300, 312)]
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(405, [2.0]), (406, [1e12] * 6), rows[10]]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    for every, k in ((5, 5), (50, 3)):
        got = sorted(tuple(r) for r in exact_topk.top_k(data, k, every).collect())
        assert got == brute_top(rows, k, every)
    assert exact_topk.top_k(data.filter("1 = 0")).count() == 0
    assert exact_topk.top_k(data.filter("vec_id = 0")).count() == 0


def test_top_k_never_broadcasts_copies_of_blocks(spark, monkeypatch):
    """One small block of queries met very many vector blocks: its copies were gathered on the driver."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)] + [(1001 + i % 3, [float(i)] * 6) for i in range(9)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plans, write = [], exact_topk.written

    def written(df, stem):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, stem)

    for name, value in (("BLOCK", 16), ("STRIP", 4), ("written", written)):
        monkeypatch.setattr(exact_topk, name, value)
    got = sorted(tuple(r) for r in exact_topk.top_k(data, 3, 5).collect())
    assert got == brute_top(rows, 3, 5)
    met = [p for p in plans if "MapInArrow" in p.splitlines()[1]]
    assert met and not [p for p in met if "Broadcast" in p]
