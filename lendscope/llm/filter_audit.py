"""Filter interaction audit: what each of five filters removes in every order, by a walk over subsets.

Each document fails some of the filters A to E; its mask has a bit for each. Documents are summed into
one cell a part and mask (32 masks), so that nothing but cells is walked over: the subsets of active
filters are visited in Gray-code order, which toggles one filter at a time. Each cell counts how many of
its filters are active now, and the running survivors lose a cell when its counter leaves zero and get
it back when the counter returns to zero. The survivors of all 32 subsets are stored; a step of an order
is the difference of two of them.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * characters A-Z > 5 * code
points; D any of #$%&*|; E a smaller doc_id has the same text. E takes one minimum a text: equal texts
are summed before they are shuffled, so a text that a third of the rows have moves once a task.

Defined cases: null text is empty, null source the empty part. A row without an id has no smaller one,
and is smaller than none: E spares it. Rows that repeat id and text don't fail E by each other. A row is
good (toxic) if any label row of its id has quality (toxic) 1; labels without an id count for none. Any
length of text: words are told by the engine's own functions. An empty table has no parts and no rows;
other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.shared import shared_dir, stored

BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SIGNS = r"[#$%&*|]"
#: One letter a filter, in the order of the mask's bits.
LETTERS = "ABCDE"
SUMS = ("n", "good", "toxic")

SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> list[Column]:
    """Whether a text (not null) fails A, B, C and D."""
    words = F.regexp_count(text, F.lit(WORDS))
    parts = F.split(text, BLANKS)
    distinct = F.size(F.array_distinct(parts)) - F.array_contains(parts, "").cast("int")
    return [
        words < LEAST_WORDS,
        F.lit(100).cast("long") * distinct < F.lit(DISTINCT_PERCENT).cast("long") * words,
        F.lit(100).cast("long") * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(CAPITAL_PERCENT).cast("long") * F.length(text),
        text.rlike(SIGNS),
    ]


def bits(failures: list[Column]) -> Column:
    """The mask of failures, the first one in the lowest bit."""
    mask = F.lit(0)
    for i, failed in enumerate(failures):
        mask = mask + failed.cast("int") * (1 << i)
    return mask


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic: whether a label row of their doc_id says so."""
    says = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    of = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    return rows.join(of, "doc_id", "left").fillna(0, ["good", "toxic"])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and how many rows (n), good and toxic ones it has, of docs (doc_id, text, source) and labels."""
    place = shared_dir(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sha"), bits(text_failures(text)).alias("mask"),
    )
    # Rows of one text and id first, then those of one text: n of the least id tells which of them E spares.
    same = labelled(rows.groupBy("doc_id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n")), labels)
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n")
    of_text = same.groupBy("sha", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.min(least).alias("least")
    )
    of_text = stored(of_text, f"{place}/texts")
    first = of_text.groupBy("sha").agg(F.min("least.doc_id").alias("first"))
    spared = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    told = of_text.join(first, "sha").select("part", "mask", "good", "toxic", spared.alias("spared"), (F.col("n") - spared).alias("failed"))
    either = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("spared").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("failed").alias("n"))))
    split = told.select("part", "good", "toxic", either.alias("of")).select("part", "of.mask", "of.n", "good", "toxic").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def gray_states(masks: np.ndarray, sums: np.ndarray, filters: int) -> np.ndarray:
    """For each subset of filters (as bits) the sums of the cells that none of them removes."""
    states = np.zeros((1 << filters, sums.shape[1]), np.int64)
    active, running, subset = np.zeros(len(masks), np.int64), sums.sum(axis=0), 0
    states[0] = running
    for i in range(1, 1 << filters):
        toggled = (i & -i).bit_length() - 1
        subset ^= 1 << toggled
        on, hit = subset >> toggled & 1, masks >> toggled & 1 == 1
        if on:
            running = running - sums[hit & (active == 0)].sum(axis=0)
        active[hit] += 1 if on else -1
        if not on:
            running = running + sums[hit & (active == 0)].sum(axis=0)
        states[subset] = running
    return states


def steps(states: np.ndarray, letters: str) -> dict[str, list]:
    """One row an order of letters and step, from the states of all subsets."""
    every = len(states) - 1
    orders = [*itertools.permutations(range(len(letters)))]
    rows, taken = [], [0] * len(letters)
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            gone = states[before] - states[after]
            fails = states[0, 0] - states[1 << f, 0]
            only = states[every ^ 1 << f, 0] - states[every, 0]
            rows.append(("".join(letters[x] for x in order), step, f, states[after, 0], gone[0], fails - gone[0], only, gone[1], gone[2]))
            taken[f] += int(gone[0])
            before = after
    names = ("filter_order", "step", "f", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    out = {c: [r[i] if isinstance(r[i], (str, int)) else int(r[i]) for r in rows] for i, c in enumerate(names)}
    out["shapley"] = [taken[f] for f in out.pop("f")]
    return out


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """SCHEMA of cells (part, mask, n, good, toxic), one row a part and mask; all orders of letters."""

    def walk(group):
        import pyarrow as pa

        masks = group["mask"].to_numpy().astype(np.int64)
        sums = np.stack([group[c].to_numpy().astype(np.int64) for c in SUMS], axis=1)
        out = steps(gray_states(masks, sums, len(letters)), letters)
        out = {"part": [group["part"][0].as_py()] * len(out["step"])} | out
        return pa.table({c: pa.array(v, pa.string() if isinstance(v[0], str) else pa.int32() if c == "step" else pa.int64()) for c, v in out.items()})

    return cells.groupBy("part").applyInArrow(walk, SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of every order, by part, of docs (doc_id, text, source) and
    labels (doc_id, quality, toxic)."""
    return interactions(cells(docs, labels))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
orders(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, ord(substr(filter_order, step, 1)) - 65 AS b,
         list_sum(list_transform(range(1, step), lambda i: 1 << (ord(substr(filter_order, i::INT, 1)) - 65))) AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(filter_order) = 5)),
x AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (mask & (coalesce(before, 0)::INT | (1 << b)) = 0) AS kept,
         sum(n) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & (1 << b) <> 0) AS removed,
         sum(n) FILTER (mask & coalesce(before, 0)::INT <> 0 AND mask & (1 << b) <> 0) AS redundant,
         sum(n) FILTER (mask = 1 << b) AS unique_fails,
         sum(good) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & (1 << b) <> 0) AS good_lost,
         sum(toxic) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & (1 << b) <> 0) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM x
"""
