"""From raw documents to token digests: five stages, each a Parquet table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dripline.llm import bpe_codec, line_rules, pareto_mix, quality_trees, simhash_anchors
from dripline.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep at least half of their words once failing lines are gone."""
    return line_rules.cleaned(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be good by trees that learn from the labelled rows of the whole documents table.

    The rules before have taken out most bad documents; among what they kept the trees would find none to learn from.
    """
    trees = quality_trees.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_trees.good_documents(docs, trees)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: three-word shingles, at most three differing bits."""
    return simhash_anchors.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return pareto_mix.mixed(docs)


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, digest of the ids and digest of the decoded text of every document of the mix."""
    return bpe_codec.digests(docs, bpe_codec.default_path("byte_bpe_50k.json"), lean=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", token_digests),
]

#: Fitted trees, random odds and token ids have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: (doc_id, n_tokens, ids_sha256, decoded_sha256), a row for every taken copy."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
