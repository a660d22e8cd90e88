"""A corpus pipeline: language, exact copies, near copies, secrets, packing.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the
documents that it keeps, with the columns of documents, or, as the last one, the pieces of
packed windows. run() applies them to documents and writes what each stage keeps before the
next one reads it. Other columns of documents pass through, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from lendscope.llm import exact_dedup, jaccard_join, language_mix, packing, secret_scan
from lendscope.llm import shared
from lendscope.llm.shared import load, shared_dir, stored


def language(spark, docs, sf_dir):
    """Documents without a letter, null and empty ones too, or without a leading language, go; repeated rows stay."""
    return language_mix.accepted(docs)


def exact_copies(spark, docs, sf_dir):
    """Of texts that are equal but for white space the longest stays; null counts as empty."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark, docs, sf_dir):
    """Of documents linked by a shingle similarity of 0.8 or more, also over others, the first stays."""
    return jaccard_join.one_of_each(docs)


def secrets(spark, docs, sf_dir):
    """Every secret is replaced by a mark; all documents stay, repeated rows each, and null stays null."""
    return secret_scan.redact(docs)


def pack(spark, docs, sf_dir):
    """Windows of 1024 tokens, with their tokens; null is empty, and repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("packing", pack),
]

#: Languages, near copies and tokens can't be told in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        place = shared_dir(spark)
        with shared.own_folders(spark):  # what only this stage reads
            docs = stored(stage(spark, docs, sf_dir), f"{place}/{name}")
        if before:
            shared.discard(spark, before)
        before = place
    return STAGES[-1][1](spark, docs, sf_dir)
