"""Conversation repair, term pipeline and chosen paths against brute force and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dripline.llm import ans_files, bpe_prefix, chosen_paths, conversation_repair, line_rules, pareto_mix, simhash_anchors, term_pipeline, url_rules
from dripline.llm.queries import QUERIES

BASE = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}
SPACE = " \t\n\x0b\x0c\r"


def cheapest(initials, faults, start=0, ends=(0, 3)):
    """Least (cost, edits) by dynamic programming from the last row back."""
    best = {}
    for i in range(len(initials), -1, -1):
        here = {}
        for state in range(4):
            ways = [(0, "")] if i == len(initials) and state in ends else []
            if i < len(initials):
                turned = 3 if state == 2 else 2
                ways.append((best[i + 1, state][0] + 4, "D" + best[i + 1, state][1]))
                if faults[i] in (0, 3):
                    late = 3 if faults[i] == 3 else 0
                    kept = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(initials[i])
                    if kept:
                        ways.append((best[i + 1, kept][0] + late, "K" + best[i + 1, kept][1]))
                    ways.append((best[i + 1, turned][0] + 3 + late, "R" + best[i + 1, turned][1]))
            here[state] = min(ways, default=(10**9, ""))
        for _ in range(3):
            for state in range(4):
                other = here[3 if state == 2 else 2]
                here[state] = min(here[state], (other[0] + 3, "I" + other[1]))
        best.update({(i, state): here[state] for state in range(4)})
    return best[0, start]


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_dynamic_programming(seed):
    rng = random.Random(seed)
    for _ in range(300):
        n = rng.randint(0, 11)
        initials = "".join(rng.choice("suua?a") for _ in range(n))
        faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        want = cheapest(initials, faults)
        assert conversation_repair.search(initials, faults)[:2] == want
        size = rng.randint(1, 4)
        pieces = []
        for at in range(0, n, size):
            found = {}
            for before in range(4):
                for after in range(4):
                    way = conversation_repair.search(initials[at : at + size], faults[at : at + size], before, (after,))
                    if way:
                        found[before, way[2]] = way[:2]
            pieces.append(found)
        assert conversation_repair.join_pieces(pieces) == want


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def judged_by_hand(rows):
    """conv_id -> the columns of the query."""
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in damaged(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.rstrip(SPACE)
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in turns]
        cost, audit = cheapest("".join(x if x and x in "sua" else "?" for x in initials), faults)
        lines, state, at = [], 0, 0
        for edit in audit:
            if edit in "IR":
                state = 3 if state == 2 else 2
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[initials[at]]
            name = {2: "user", 3: "assistant"}.get(state)
            if edit == "I":
                lines.append(f"{name}:")
                continue
            if edit != "D":
                lines.append(f"{turns[at][1] if edit == 'K' else name}:{turns[at][2]}")
            at += 1
        numbers = [r[0] for r in turns if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        want[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha)
    return want


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def of_table(spark, df, folder, monkeypatch, size=None):
    df.write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    if size:
        monkeypatch.setattr(conversation_repair.repair, "__defaults__", (size,))
    return QUERIES["op13_conversation_repair"](spark, str(folder))


def test_repair_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{BASE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"](spark, BASE).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == judged_by_hand(rows)


@pytest.mark.parametrize("size", [None, 3])
def test_repair_of_odd_and_long_conversations(spark, tmp_path, monkeypatch, size):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "User", "", None, "ärger", "umpire"]
    texts = ["Fine.", "fine", "", " \n", None, "Done!  ", "long " * 5000 + ".", "Why?", "a.\x85", "😀."]
    rows = [(1, k, rng.choice(roles[:3]), f"{rng.choice(texts[:8])}") for k in range(150)]
    rows += [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(2, 40) for _ in range(rng.randint(1, 8))]
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    rows += [r for r in rows if r[0] == 3] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("pos", F.lit("x")).withColumn("fault", F.lit(1.5))
    got = of_table(spark, df, tmp_path, monkeypatch, size).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == judged_by_hand(rows)


def test_repair_of_an_empty_table(spark, tmp_path, monkeypatch):
    df = spark.read.parquet(f"{BASE}/conversations.parquet").filter("1 = 0")
    assert of_table(spark, df, tmp_path, monkeypatch).count() == 0


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def ranked_by_hand(docs, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    total, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(terms(text))
    want = []
    for item, ask in asked.items():
        scored = []
        for (doc, c), n in zip(counts, sizes):
            score = 0
            for t, times in ask.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    score += times * w * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * total // length)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        want += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(want, key=str)


@pytest.mark.parametrize("owners, group", [(1, 128), (3, 2), (4, 128)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, owners, group):
    monkeypatch.setattr(term_pipeline, "GROUP_ITEMS", group)
    monkeypatch.setattr(term_pipeline, "BLOCK_DOCS", 40)
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "naïve", "中文", "A1"]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=range(64, 0, -1), k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(None, "w63x É w1"), (None, None), (7, "w1 w1, W1; w2"), (900, ""), (901, " \n.,;"), (902, "w5 " * 30000), docs[4], docs[4]]
    items = [(k, " ".join(rng.choices(vocabulary, k=6))) for k in range(9)]
    items += [(9, None), (10, "nowhere"), (None, "w1 w2 w2"), items[0], (1, "É w60 w3"), (11, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1.5))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0)).withColumn("term", F.lit(1.5))
    got = sorted(map(tuple, term_pipeline.top_documents(d, q, owners=owners).collect()), key=str)
    assert got == ranked_by_hand(docs, items)


def test_ranked_search_of_empty_tables(spark):
    d, q = (spark.read.parquet(f"{BASE}/{t}.parquet") for t in ("documents", "benchmark"))
    for a, b in ((d.filter("1 = 0"), q), (d, q.filter("1 = 0"))):
        assert term_pipeline.top_documents(a, b).count() == 0


def shingles(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def linked_by_hand(docs, percent=80):
    """(doc, size, component) of each row, and the number of links between different sets."""
    sets = {}
    for doc, text in docs:
        sets.setdefault(shingles(text), []).append(doc)
    keys = [s for s in sets if s]
    parent, holders, links = list(range(len(keys))), {}, 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(keys):
        common = Counter(j for x in s for j in holders.get(x, ()))
        for j, both in common.items():
            if 100 * both >= percent * (len(s) + len(keys[j]) - both):
                parent[root(i)] = root(j)
                links += 1
        for x in s:
            holders.setdefault(x, []).append(i)
    least = {}
    for i, s in enumerate(keys):
        named = [d for d in sets[s] if d is not None]
        least[root(i)] = min([*named, least.get(root(i))], key=lambda d: (d is None, d))
    place = {s: i for i, s in enumerate(keys)}
    rows = [(d, len(shingles(t)), least[root(place[shingles(t)])] if shingles(t) else d) for d, t in docs]
    return Counter(rows), links


def varied(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("leaf, depth", [(1024, 4), (12, 4), (12, 1), (6, 2)])
def test_chosen_paths_equal_brute_force(spark, monkeypatch, leaf, depth):
    """Families of near copies around the threshold, a passage that many share, and odd texts; also with tiny leaves."""
    monkeypatch.setattr(chosen_paths, "LEAF", leaf)
    monkeypatch.setattr(chosen_paths, "DEPTH", depth)
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts = fresh(60), []
    for _ in range(12):
        base = fresh(rng.randint(20, 150))
        texts += [varied(rng, base, rng.randrange(4)) for _ in range(rng.randint(2, 9))]
    big = fresh(120)
    texts += [varied(rng, big, rng.randrange(5)) for _ in range(60)]  # similarities on both sides of 0.8
    texts += [" ".join(passage + fresh(40)) for _ in range(40)]
    texts += [" ".join(fresh(30)) for _ in range(30)]
    texts += [texts[0]] * 3 + [texts[1].upper(), "a b c", "a  b\nc", "A B C d", "", " \n", None, "x", "long " * 20000, "long " * 30000, "É é", "é É"]
    docs = list(enumerate(texts)) + [(None, texts[3]), (None, "no id at all here"), (7, texts[20]), (5, texts[5]), (5, texts[5])]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sig", F.lit("x")).withColumn("key", F.lit(1.5))
    want, links = linked_by_hand(docs)
    assert links > 300
    assert Counter(map(tuple, chosen_paths.near_duplicates(df).collect())) == want
    assert chosen_paths.near_duplicates(df.filter("1 = 0")).count() == 0


def test_chosen_paths_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text").collect()]
    want, links = linked_by_hand(rows)
    got = QUERIES["op11_chosen_paths"](spark, BASE).collect()
    assert links and Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_simhash_components_join_different_fingerprints(spark):
    """A few changed words in long texts leave fingerprints within three bits, which texts of random words don't reach."""
    rng = random.Random(2)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
        texts += [varied(rng, base, 1) for _ in range(5)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash_anchors.near_duplicates(df).collect()}
    parent = {d: d for d in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    different = 0
    for a in got:
        for b in range(a):
            if (got[a][0] ^ got[b][0]).bit_count() <= 3:
                different += got[a][0] != got[b][0]
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert different and {d: c for d, (_, c) in got.items()} == {d: root(d) for d in got}


def test_one_row_of_each_component_stays(spark):
    """One id on two texts, copies with and without an id, and repeated rows."""
    rng = random.Random(4)
    fresh = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    a, b, c, d, e = (fresh() for _ in range(5))
    rows = [(1, a), (1, b), (2, a), (3, c), (3, c), (3, c), (4, d), (5, d), (6, fresh()), (7, ""), (8, None)]
    rows += [(None, e)] * 1000 + [(None, c), (None, fresh())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("doc", F.lit(1))
    kept = simhash_anchors.one_of_each(df)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    want = Counter([(1, a), (1, b), (3, c), (4, d), rows[8], (7, ""), (None, e), (None, rows[-1][1])])
    assert kept.columns == df.columns and got == want


def test_equal_rows_are_weighed_together(spark):
    equal = [(1, "ten words are in this one text of ten exactly", "a")] * 50 + [(2, "w " * 48, "b")]
    df = spark.createDataFrame(equal, "doc_id long, text string, source string")
    got = {r.source: r for r in pareto_mix.mix(df).groupBy("row.source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()}
    for r in got.values():
        # All equal rows or none: no other choice comes nearer to the target.
        assert abs(r.taken - r.target) <= min(abs(k * r.size - r.target) for k in range(4)) + 1e-6


def test_a_line_break_in_a_host_is_part_of_it(spark):
    rows = [
        (1, "http://a\n.example.org/es/x"), (2, "http://example.org\nfoo/es/x"), (3, "http://x.com/a.example.org\n/es/"),
        (4, "http://w.example.org/es/?q"), (5, "http://example.org/es/" + "x" * 50_000), (6, "http://w.example.org/es/?q"),
    ]
    df = spark.createDataFrame([*rows, rows[3]], "page_id long, url string")
    got = url_rules.filter_urls(df).collect()
    found = {r.page_id: r.rule for r in got}
    assert len(got) == 7 and found[1] == found[4] == found[5] == found[6] == "example.org/es/"
    assert found[2] is None and found[3] is None


def test_broken_text_is_counted_and_judged(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61C3206263FF' AS STRING) AS text UNION ALL SELECT 2L, 'ärger über öl'")
    assert line_rules.line_rules(df, carry=["doc_id"]).count() == 2
    assert line_rules.points("ärger 😀".encode()) == 7 and line_rules.points(b"a\xc3 bc\xff") == 6


def test_stretches_hold_a_document_once(spark, monkeypatch):
    """Two large nodes of the same documents: each document is in the larger, both pivots are in all their stretches."""
    monkeypatch.setattr(chosen_paths, "LEAF", 10)
    rows = [(1, k, 40) for k in range(40)] + [(2, k, 30) for k in range(5, 35)]
    got = chosen_paths._stretches(spark.createDataFrame(rows, "path long, key long, size long")).collect()
    assert {r.key for r in got} == set(range(40))
    assert Counter(r.key for r in got if r.key not in (0, 5)) == Counter(k for k in range(40) if k not in (0, 5))
    assert len({r.path for r in got if r.key == 0}) == 4


def test_memo_keeps_what_was_asked_again():
    memo = bpe_prefix.Memo(4)
    for batch in (["a", "b"], ["a", "c"], ["d"]):
        memo.update((w, w) for w in memo.missing(batch))
    assert memo.missing(["a", "b", "e"]) == {"b", "e"}  # full: only "a" came twice
    memo.update((w, w) for w in "becd")
    assert memo.missing(iter("abx")) == {"b", "x"}  # full again, and only "a" was asked for since


def test_library_ids_of_many_words_at_once():
    """One request for many words gives the ids of each: odd characters, special strings, the mark itself, broken UTF-8."""
    import public_tokenizers

    ids = ans_files.LibraryIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    words = ["".join(rng.choice("abcäßÉ'0.,。́") for _ in range(rng.randint(1, 9))).encode() for _ in range(300)]
    odd = ["\x01", "a\x01b", "\x01\x01", "<|endoftext|>", "x<|startoftext|>y", "<|endof", "text|>", "　", "ΑΣ", "İ", "́e"]
    words += [x.encode() for x in odd] + [b"\xff\xfe", b"caf\xc3"]
    want = [ids.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in words]
    asked, real = [], ids.tokenizer
    ids.tokenizer = SimpleNamespace(encode_batch_fast=lambda texts, **k: asked.extend(texts) or real.encode_batch_fast(texts, **k))
    assert ids.encode(words) == [b"".join(i.to_bytes(4, "little") for i in x) for x in want]
    assert len(asked) < len(words) / 10


def test_library_ids_asks_one_form_of_a_word():
    """Capitals and punctuation after a word don't make it a new one; special tokens and odd letters stay as they are."""
    import public_tokenizers

    ids = ans_files.LibraryIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    stems = ["house", "HOUSE", "straße", "Été", "été", "x×", "a÷", "it's", "'S", "9a", "İz", "ſo", "K", "µm", "ª", "’", "。"]
    stems += ["<|ENDOFTEXT|>", "<|endoftext|>", "<|endoftext", "|", "</w>", "", "a.b", "�", "\x01", "ñ", "Σ", "dÉ"]
    tails = ["", ".", "...", "!?", "'", "'s", "'S.", ",”", "́.", "###", "|>", "_-", "é.", "×,", "."]
    words = [(a + b).encode() for a in stems for b in tails if a + b] + [b"caf\xc3.", b"\xe3\xc3\xa9;", b"\xc3\x97.", b"\xff."]
    rng.shuffle(words)
    want = [b"".join(i.to_bytes(4, "little") for i in ids.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids) for w in words]
    assert ids.encode(words) == want
    asked, real = [], ids._ask
    ids._ask = lambda words: asked.extend(words) or real(words)
    ids.known.clear()
    ids.encode([b"Tree tree, TREE... (tree) tree!", b"Tree; tree"])
    assert sorted(asked) == sorted([b"tree", b",", b"...", b"(tree", b")", b"!", b";"])


def test_library_ids_of_columns():
    """Texts are cut at the six white characters only, whatever else they hold; slices, nulls and empty texts keep their place."""
    import public_tokenizers

    ids = ans_files.LibraryIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [b" a  b\t\nc\v\f\rd ", None, b"", b"   ", "x\x1cy\x85z w v".encode(), b"\xff \xc3", b"one", b"two  three "]
    column = pa.array([b"before", *texts, b"after"], pa.binary()).slice(1, len(texts))
    got, ends = ids.ids_of(column)
    pieces = [got[a:b].tolist() for a, b in zip([0, *ends], ends)]
    want = [[ids.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in (t or b"").split()] for t in texts]
    assert pieces == [[i for w in t for i in w] for t in want]
    got, ends = ids.ids_of(pa.array([None, b" "], pa.binary()))
    assert not len(got) and ends.tolist() == [0, 0]
    assert len(ids.ids_of(pa.array([], pa.binary()))[1]) == 0


def test_leaves_stay_whole(spark):
    """Spark may take the partitions of a join by path for those asked for, and cut them: links between pieces were lost."""
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token = bytes(4 * chosen_paths.POSITIONS)
        nodes = spark.createDataFrame([(k, 9, token) for k in range(200)], "key long, n long, sketch binary")
        leaves = spark.createDataFrame([(p, k) for k in range(200) for p in range(4)], "path long, key long").repartition(40).localCheckpoint()
        labels = spark.createDataFrame([(0, 0)], "key long, label long")
        seen = chosen_paths._in_leaves(leaves, nodes, labels, lambda keys, n, tokens, label: (keys[:1], [len(keys)]), "a long, b long")
        assert sorted((r.a, r.b) for r in seen.collect()) == [(0, 200)] * 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_strays_of_all_nodes_meet_a_bulky_component_once(spark, monkeypatch):
    """Before, they met it again in every tree and level."""
    monkeypatch.setattr(chosen_paths, "LEAF", 8)
    labels = spark.createDataFrame([(k, 0) for k in range(20)], "key long, label long")
    big = spark.createDataFrame([(p, k, 26) for p in range(12) for k in range(26)], "path long, key long, size long")
    met, strays, branching = chosen_paths._split(big, labels, False)
    assert met.isEmpty() and branching.isEmpty()
    leaves = {}
    for r in chosen_paths._pools(strays, labels).collect():
        leaves.setdefault(r.path, []).append(r.key)
    rows = sum(map(len, leaves.values()))
    assert rows <= 6 * 7 + 26 * 2  # each stray in all stretches, each document in all tiles of strays
    assert all(any(a in m and b in m for m in leaves.values()) for a in range(20, 26) for b in range(26))


def test_documents_name_a_partner_that_is_likely_similar(spark):
    """Not just the smallest that may be."""
    agree = [64, 40, 60, 64]
    tokens = [[0] * a + [100 * k + 1] * (chosen_paths.POSITIONS - a) for k, a in enumerate(agree)]
    rows = [(k, 50, np.array(t, np.uint32).tobytes()) for k, t in zip([3, 1, 2, 4], tokens)]
    nodes = spark.createDataFrame(rows, "key long, n long, sketch binary")
    leaves = nodes.selectExpr("9L as path", "key")
    stars = chosen_paths._stars(leaves, nodes, 80, 36).collect()
    assert {tuple(r) for r in stars} == {(1, 2), (2, 3), (2, 4)}  # all agree with 1 in 40 positions, the others in 60 or more


def test_pivots_are_in_every_stretch(spark, monkeypatch):
    monkeypatch.setattr(chosen_paths, "LEAF", 10)
    got = chosen_paths._pivots(spark.createDataFrame([(1, k, 40) for k in range(40)], "path long, key long, size long")).collect()
    keys = {r.key for r in got}
    assert 0 in keys and 4 < len(keys) <= chosen_paths.PIVOTS and len(got) == 4 * len(keys) and len({r.path for r in got}) == 4
