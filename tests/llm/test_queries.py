"""Registered queries against SQL, and the pipeline stage by stage."""

import hashlib
import os
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check_oracle import compare, connect

import corpus_pipeline
from dripline.llm import line_rules
from dripline.llm.queries import QUERIES, SQL
from dripline.llm.common import written

BASE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    line = compare(spark, connect(BASE), name, QUERIES[name], SQL[name], BASE)
    assert line.startswith("OK"), line


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], BASE), "stage"))
    for t in tables[1:-1]:
        assert t.columns == docs.columns
    ids = [Counter(r.doc_id for r in t.select("doc_id").collect()) for t in tables]
    judged = line_rules.line_rules(docs, carry=["doc_id"]).select("row.doc_id", "kept").collect()
    assert set(ids[1]) == {r.doc_id for r in judged if r.kept}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    assert set(ids[2]) <= set(ids[1]) and all(labels.get(i, 1) == 1 for i in ids[2])
    assert max(ids[3].values()) == 1 and set(ids[3]) <= set(ids[2])
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 3
    assert ids[5] == ids[4]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in tables[4].collect()}
    for r in tables[5].collect():
        packed = np.array(t.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(packed).hexdigest() and r.n_tokens == len(packed) // 4
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet").filter("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, BASE), "empty")
    assert docs.count() == 0


def test_pipeline_on_odd_rows(spark):
    """Null, empty, long, repeated and nameless rows pass every stage or are dropped by its rule; none ends the job."""
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    good = docs.filter("length(text) > 400").limit(3).collect()
    rows = [tuple(r) for r in good]
    kinds = {f.name: i for i, f in enumerate(docs.schema)}

    def with_(row, **values):
        return tuple(values.get(name, row[i]) for name, i in kinds.items())

    odd = [with_(rows[0], doc_id=900_000 + k, text=t) for k, t in enumerate([None, "", " \n\t", "word", rows[0][kinds["text"]] * 30])]
    odd += [with_(rows[1], doc_id=None), with_(rows[1], doc_id=None), rows[2], rows[2], with_(rows[2], doc_id=rows[0][kinds["doc_id"]])]
    odd += [with_(rows[0], doc_id=910_000, source=None, lang=None, n_chars=None)]
    table = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    counts = [table.count()]
    for name, stage in corpus_pipeline.STAGES:
        table = written(stage(spark, table, BASE), "odd")
        counts.append(table.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert table.columns == docs.columns
    assert 0 < counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] < counts[2] and counts[5] == counts[4]
