"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from parchmill.llm import bpe, chat, embeddings, exact_dedup, html, merkle, negatives, ngram_join, packing, pii, quality, urls, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_url_filters": urls.op5_url_filters,
    "op6_pii": pii.op6_pii,
    "op7_embedding_near_dedup": embeddings.op7_embedding_near_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_warc": warc.op10_warc,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality.OP2_SQL,
    "op4_chat_formatting": chat.OP4_SQL,
    "op5_url_filters": urls.OP5_SQL,
    "op7_embedding_near_dedup": embeddings.OP7_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_exact_dedup": exact_dedup.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
