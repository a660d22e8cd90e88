"""Katz backoff models of any order as stored tables, and scores of documents by them.

A model has two tables for each order n: its n-grams with their probability, and the contexts of
n - 1 tokens with their backoff weight. P(w|h) is the n-gram's probability where it was trained,
else b(h) P(w|h') with the first token of h left out, down to words alone, where untrained ones
share what the discounts leave. Discounts and normalisation are those of katz; each context's
probabilities sum to one over the training types and the unknown one.

katz.score_documents scores a whole corpus at order two without a row a token; the tables here
are for models that stay, for higher orders, and for documents that come later. A new document
costs a join of its tokens with each table.

Defined cases: null text is empty, an empty text is the end mark alone. Without training
documents every token is unknown, with probability one. Repeated rows are trained and scored
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.katz import LAST_DISCOUNTED, Discounts, Unigrams
from lendscope.llm.shared import shared_dir, stored

BEGIN, END = "<", ">"  # words begin with =
BLANKS = r"[\x20\x09-\x0D]+"


@dataclass
class Tables:
    """levels[n - 1]: t1 .. tn, p; backoff[n - 1] (from order two on): t1 .. t(n-1), b; unknown: the
    unknown type's probability."""

    levels: list[DataFrame]
    backoff: list[DataFrame | None]
    unknown: float

    @property
    def order(self) -> int:
        return len(self.levels)


def names(n: int, first: int = 1) -> list[str]:
    return [f"t{i}" for i in range(first, n + 1)]


def tokens(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, BLANKS), lambda w: w != "")
    return F.concat(F.transform(words, lambda w: F.concat(F.lit("="), w)), F.array(F.lit(END)))


def grams(docs: DataFrame, n: int, *also: str) -> DataFrame:
    """t1 .. tn for each token of docs (text), with columns also; before a text stand n - 1 begin marks."""
    padded = F.concat(F.array_repeat(F.lit(BEGIN), n - 1), tokens(F.col("text")))
    lines = docs.select(*also, padded.alias("line"))
    shifted = F.arrays_zip(*[F.slice("line", i, F.size("line")).alias(f"t{i}") for i in range(1, n + 1)])
    return lines.select(*also, F.explode(shifted).alias("g")).select(*also, "g.*").where(F.col(f"t{n}").isNotNull())


def of_counts(counted: DataFrame) -> list[int]:
    """How many n-grams have each count up to LAST_DISCOUNTED + 1, from index 1 on."""
    few = {r["c"]: r["n"] for r in counted.where(F.col("c") <= LAST_DISCOUNTED + 1).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [few.get(r, 0) for r in range(LAST_DISCOUNTED + 2)]


def train(docs: DataFrame, order: int = 3) -> Tables:
    """The tables of a model of docs (text), written to the shared folder."""
    place = shared_dir(docs.sparkSession)
    levels, backoff, unknown = [], [], 1.0
    for n in range(1, order + 1):
        counted = stored(grams(docs, n).groupBy(*names(n)).agg(F.count(F.lit(1)).alias("c")), f"{place}/counts{n}")
        counts = of_counts(counted)
        if n == 1:
            total, types = counted.agg(F.sum("c"), F.count(F.lit(1))).first()
            words = Unigrams(total or 0, types, counts)
            levels.append(stored(counted.select("t1", (_weight(words.discounts) / max(words.below, 1)).alias("p")), f"{place}/level1"))
            backoff.append(None)
            unknown = words.unknown
            continue
        lower = levels[-1].toDF(*names(n, 2), "lower")
        weighed = counted.join(lower, names(n, 2)).withColumn("weight", _weight(Discounts(counts)))
        sums = weighed.groupBy(*names(n - 1)).agg(F.sum("c").alias("all"), F.sum("weight").alias("seen"), F.sum("lower").alias("backed"))
        below = F.when(F.col("all") - F.col("seen") > 0, F.col("all")).otherwise(F.col("all") + 1)
        sums = stored(sums.withColumn("below", below), f"{place}/sums{n}")
        levels.append(stored(weighed.join(sums.select(*names(n - 1), "below"), names(n - 1)).select(*names(n), (F.col("weight") / F.col("below")).alias("p")), f"{place}/level{n}"))
        left = (1 - F.col("seen") / F.col("below")) / F.greatest(1 - F.col("backed"), F.lit(1e-300))
        backoff.append(stored(sums.select(*names(n - 1), left.alias("b")), f"{place}/backoff{n}"))
    return Tables(levels, backoff, unknown)


def _weight(discounts: Discounts) -> Column:
    out = F.col("c").cast("double")
    for r in range(1, LAST_DISCOUNTED + 1):
        out = F.when(F.col("c") == r, float(discounts.d[r]) * r).otherwise(out)
    return out


def score(docs: DataFrame, model: Tables) -> DataFrame:
    """doc_id, n_tokens, score (log10 of the text's probability) of each row of docs (doc_id, text)."""
    n = model.order
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = grams(stored(rows, f"{shared_dir(docs.sparkSession)}/rows"), n, "row", "doc_id")
    for k in range(1, n + 1):
        own = names(n, n - k + 1)
        each = each.join(model.levels[k - 1].toDF(*own, f"p{k}"), own, "left")
        if k > 1:
            each = each.join(model.backoff[k - 1].toDF(*own[:-1], f"b{k}"), own[:-1], "left")
    value = F.log10(F.coalesce("p1", F.lit(model.unknown)))
    for k in range(2, n + 1):
        value = F.when(F.col(f"p{k}").isNotNull(), F.log10(f"p{k}")).otherwise(F.log10(F.coalesce(f"b{k}", F.lit(1.0))) + value)
    return each.groupBy("row", "doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(value).alias("score")).drop("row")
