"""Loads every operator of this folder; importing them fills the catalogue."""

from dripline.llm import ans_files, bpe_codec, chosen_paths, conversation_repair, exact_topk, line_rules, ngram_scores, pareto_mix, quality_trees, simhash_anchors, term_pipeline, token_counts, url_rules  # noqa: F401
from dripline.llm.catalog import QUERIES, SQL  # noqa: F401
