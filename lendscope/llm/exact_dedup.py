"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

Each text loses its white space ([\\x20\\x09-\\x0D]) and is cut where its own letters say so,
so equal passages give equal chunks wherever they stand. A chunk's identifier is verified:
all distinct chunk texts meet once, and an identifier that two texts share makes the job take
a wider one. Documents are then compared by their ordered identifier lists, so no document
text moves between machines as a whole, and a chunk that many documents repeat moves once
for each task that reads it.

Defined cases: null text counts as empty, and all empty texts are one group. In a group the
row with most code points in its original text stays, then the smallest doc_id (null last).
Repeated rows each count, and each row that equals the kept one in doc_id and length is kept.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.shared import kept_rows, shared_dir, stored

BLANKS = r"[\x20\x09-\x0D]+"
#: Once it has 128 characters, a chunk ends after a vowel, a dental and a rarer consonant, or, for other
#: scripts, after a character beyond ASCII and a punctuation mark, or two combining marks apart.
CHUNK = r"(?s).{128,4096}?(?:[aeiou][nrst][bdfghklmpvwz]|[^\x00-\x7F]\p{P}|\p{M}\P{M}\p{M})|(?s).{1,4096}"

#: Identifiers of growing width; the first that verification accepts is used.
IDENTIFIERS = {
    "xxhash64": lambda chunk: F.xxhash64(chunk).cast("string"),
    "sha256": lambda chunk: F.sha2(chunk, 256),
    "text": lambda chunk: chunk,
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def collisions(docs: DataFrame, identifier) -> DataFrame:
    """Identifiers that more than one chunk text has."""
    pieces = docs.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
    distinct = pieces.select(identifier(F.col("chunk")).alias("id"), "chunk").distinct()
    return distinct.groupBy("id").count().where("count > 1")


def verified_identifier(docs: DataFrame) -> str:
    """Name of the first identifier under which all chunk texts of docs differ."""
    for name, identifier in IDENTIFIERS.items():
        if name == "text" or collisions(docs, identifier).isEmpty():
            return name
    raise AssertionError("texts are their own identifiers")


def recipes(docs: DataFrame, identifier: str) -> DataFrame:
    """doc_id, points (code points of the original text), raw_sha256, text_sha256, recipe."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("points"),
        F.sha2(text, 256).alias("raw_sha256"),
        normalised(F.col("text")).alias("plain"),
    )
    to_id = (lambda c: F.xxhash64(c)) if identifier == "xxhash64" else IDENTIFIERS[identifier]
    return plain.select(
        "doc_id", "points", "raw_sha256", F.sha2("plain", 256).alias("text_sha256"), F.transform(chunks(F.col("plain")), to_id).alias("recipe")
    )


def grouped(docs: DataFrame, name: str | None = None) -> DataFrame:
    """recipes()'s columns for each row of docs (doc_id, text), with best (of its group the row that
    stays) and group_size."""
    docs = docs.select("doc_id", "text")
    place = shared_dir(docs.sparkSession)
    rows = stored(recipes(docs, name or verified_identifier(docs)), f"{place}/recipes")
    first = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw_sha256")
    groups = rows.groupBy("recipe").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(stored(groups, f"{place}/groups"), "recipe")


def exact_dedup(docs: DataFrame, name: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text)."""
    return grouped(docs, name).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (-F.col("points") == F.col("best.less"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns; of equal rows of one document one."""
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("raw_sha256") == F.col("best.raw_sha256"))
    return kept_rows(docs, grouped(docs).select("doc_id", "raw_sha256", stays.alias("stays"), F.lit(True).alias("once")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY plain) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept,
       sha256(plain) AS text_sha256
FROM d WINDOW g AS (PARTITION BY plain ORDER BY points DESC, doc_id)
"""
