"""The queries of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from lendscope.llm import bpe_words, embedding_links, filter_audit, jaccard_join, katz, language_mix, lexical_search, packing, page_text, quality_rank, toxicity
from lendscope.llm import exact_dedup as chunked
from lendscope.llm import secret_scan as secrets
from lendscope.llm.shared import load


def op1_language_mix(spark, sf_dir):
    return language_mix.language_mix(load(spark, sf_dir, "documents"))


def op2_quality_rank(spark, sf_dir):
    return quality_rank.quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_packing(spark, sf_dir):
    return packing.digests(packing.pack_documents(load(spark, sf_dir, "documents")))


def op4_embedding_links(spark, sf_dir):
    return embedding_links.embedding_links(load(spark, sf_dir, "embeddings"))


def op5_katz(spark, sf_dir):
    return katz.score_documents(load(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_bpe(spark, sf_dir):
    return bpe_words.digests(bpe_words.code_documents(load(spark, sf_dir, "documents")))


def op8_secret_scan(spark, sf_dir):
    return secrets.report(secrets.secret_scan(load(spark, sf_dir, "documents")))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.near_documents(load(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return chunked.exact_dedup(load(spark, sf_dir, "documents"))


def op11_lexical_search(spark, sf_dir):
    return lexical_search.lexical_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_page_text(spark, sf_dir):
    return page_text.page_texts(load(spark, sf_dir, "pages"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES = {
    "op1_language_mix": op1_language_mix,
    "op2_quality_rank": op2_quality_rank,
    "op3_packing": op3_packing,
    "op4_embedding_links": op4_embedding_links,
    "op5_katz": op5_katz,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_page_text": op12_page_text,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op4_embedding_links": embedding_links.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op8_secret_scan": secrets.ORACLE,
    "op10_exact_dedup": chunked.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
