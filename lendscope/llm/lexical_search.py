"""Ranked lexical search: impact vectors in buckets of falling length, with two bounds before exact scores.

A document is a vector of impacts, one for each term that a query has too: how much an occurrence pattern
of the term counts, a whole number. A query is a vector of term weights, and a score is their product.
Vectors are dealt out by falling length and searched in rounds and buckets of neighbours. In a bucket

- a query whose length times that of the bucket's longest vector is below its threshold (its k-th best
  score so far) leaves the whole bucket (Cauchy-Schwarz);
- for the others, the FOCUS heaviest coordinates of the query are multiplied exactly, and what is left of
  both vectors is bounded by the product of the lengths that remain; who can't reach the threshold goes;
- survivors are scored exactly in 64-bit integers.

Bounds are widened by more than their rounding, so the result is exact. Each round's k best raise the
thresholds of the next one. Queries are taken in blocks of bounded size against all documents.

Defined cases: null text has no terms, and a document or query without terms has no row. Documents of
equal score are ranked by doc_id (null last); repeated rows are documents of their own, repeated queries
are ranked each. Texts of any length. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.blocks import gathered
from lendscope.llm.shared import LOWER, give_back, shared_dir, stored, text_bytes

TOP = 10
#: Bytes of query text in a block, about; and bytes of document text split into terms at once.
BLOCK_BYTES, SLICE = 4_000_000, 8_000_000
#: Documents in a bucket, and coordinates of a query that are multiplied before the bound.
BUCKET, FOCUS = 2048, 24
#: Shares of the documents, by falling length, after which thresholds are raised.
ROUNDS = (1 / 64, 1 / 8)
#: Salts of the first of two selections of the k best.
SALTS = 32
#: By how much bounds are widened.
SLACK = 1 + 1e-9

TERM = np.zeros(256, bool)
TERM[128:] = True
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    TERM[_low:_high] = True


def terms(raw: np.ndarray, off: np.ndarray):
    """All terms of texts (bytes and offsets) as an Arrow array, and how many each text has."""
    import pyarrow as pa

    inside = TERM[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[:-1][off[:-1] < len(raw)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    before = np.cumsum(inside, dtype=np.int64)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    letters = LOWER[raw[inside]]
    ends = np.append(before, len(letters)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters.tobytes())])
    return words, np.diff(np.searchsorted(starts, off))


def term_counts(table, vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many terms each text of table has, and text, term (its number in vocabulary) and frequency of
    those in vocabulary, sorted."""
    import pyarrow as pa
    import pyarrow.compute as pc

    raw, off = text_bytes(table["text"])
    words, sizes = terms(raw, off)
    known = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy()
    text = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)[known >= 0]
    width = max(len(vocabulary), 1)
    keys, times = np.unique(text * width + known[known >= 0], return_counts=True)
    return sizes, keys // width, keys % width, times


VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"


def vectors(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """VECTORS of each row of docs (doc_id, text) that has a term: n counts its terms, terms are those in words."""

    def run(batches):
        import pyarrow as pa

        vocabulary = pa.array(words, pa.large_binary())
        for table in gathered(batches, most=SLICE):
            sizes, text, term, times = term_counts(table, vocabulary)
            ends = np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
            found = pa.table({"doc_id": table["doc_id"], "n": pa.array(sizes.astype(np.int64)), "terms": listed(term), "tfs": listed(times)})
            yield from found.filter(pa.array(sizes > 0)).combine_chunks().to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, VECTORS)


def document_frequencies(rows: DataFrame, width: int) -> np.ndarray:
    """How many of rows (VECTORS) have each of the width terms; counted in tasks first."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(seen.astype(np.int32)), "n": pa.array(total[seen])})

    out = np.zeros(width, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    return out


IMPACTS = "doc_id long, length double, terms array<int>, impacts array<int>"


def impacts(rows: DataFrame, count: int, total: int) -> DataFrame:
    """IMPACTS of rows (VECTORS) that have a known term; count documents have total terms."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, tfs = batch.column(1).to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            m = 25 + 75 * n * count // total
            x = 1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(m, sizes))
            sums = np.zeros(len(n))
            full = sizes > 0
            if full.any():
                sums[full] = np.add.reduceat(x.astype(float) ** 2, (np.cumsum(sizes) - sizes)[full])
            ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            listed = lambda v: pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32)))
            found = pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "length": pa.array(np.sqrt(sums)), "terms": listed(batch.column(2).flatten().to_numpy()), "impacts": listed(x)}
            )
            yield found.filter(pa.array(full))

    return rows.mapInArrow(run, IMPACTS)


class Queries:
    """Weight vectors of queries: flat terms and weights (whole numbers), lengths, and focus coordinates."""

    def __init__(self, query_terms: list[np.ndarray], repeats: list[np.ndarray], weight: np.ndarray):
        self.width = len(weight)
        self.terms, self.weights = query_terms, [weight[t] * r for t, r in zip(query_terms, repeats, strict=True)]
        self.length = np.array([math.sqrt(float((w.astype(float) ** 2).sum())) for w in self.weights])
        heavy = [np.argsort(-w, kind="stable")[:FOCUS] for w in self.weights]
        self.focus = [t[h] for t, h in zip(self.terms, heavy, strict=True)]
        self.focus_weights = [w[h].astype(float) for w, h in zip(self.weights, heavy, strict=True)]
        left = [max(n * n - float((w**2).sum()), 0.0) for n, w in zip(self.length.tolist(), self.focus_weights, strict=True)]
        self.rest = np.sqrt(left)


class Bucket:
    """Documents of neighbouring lengths: identifiers, lengths, and postings by document."""

    def __init__(self, table):
        ids = table["doc_id"].combine_chunks()
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.doc_id = ids.fill_null(0).to_numpy()
        self.length = table["length"].to_numpy()
        lists = table["terms"].combine_chunks()
        self.ends = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
        self.terms, self.impacts = lists.flatten().to_numpy(), table["impacts"].combine_chunks().flatten().to_numpy().astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.length)), np.diff(self.ends))

    def bounds(self, queries: Queries, active: np.ndarray) -> np.ndarray:
        """An upper bound of the score of each document (row) for each active query."""
        focus = np.unique(np.concatenate([queries.focus[q] for q in active]))
        place = np.full(queries.width, -1)
        place[focus] = np.arange(len(focus))
        at = place[self.terms]
        some = at >= 0
        dense = np.zeros((len(self.length), len(focus)))
        dense[self.doc[some], at[some]] = self.impacts[some]
        weights, own = np.zeros((len(focus), len(active))), np.zeros((len(focus), len(active)))
        for j, q in enumerate(active.tolist()):
            weights[place[queries.focus[q]], j] = queries.focus_weights[q]
            own[place[queries.focus[q]], j] = 1
        left = np.maximum((self.length**2)[:, None] - dense**2 @ own, 0)
        left += 1e-9 * (self.length**2)[:, None]
        return (dense @ weights + np.sqrt(left) * queries.rest[active]) * SLACK

    def scores(self, rows: np.ndarray, query_terms: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
        """Exact scores of some documents for one query."""
        of_term = np.zeros(width, np.int64)
        of_term[query_terms] = weights
        sizes = self.ends[rows + 1] - self.ends[rows]
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.ends[rows] - first, sizes)
        return np.add.reduceat(of_term[self.terms[at]] * self.impacts[at], first)


class Best:
    """The k best of each query so far, in rank order, and the score that the next one must reach."""

    def __init__(self, least: np.ndarray, top: int):
        self.least, self.top = least.copy(), top
        self.held = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in least]

    def add(self, q: int, score: np.ndarray, no_id: np.ndarray, doc_id: np.ndarray) -> None:
        score, no_id, doc_id = (np.concatenate((a, b)) for a, b in zip(self.held[q], (score, no_id, doc_id), strict=True))
        order = np.lexsort((doc_id, no_id, -score))[: self.top]
        self.held[q] = score[order], no_id[order], doc_id[order]
        if len(order) == self.top:
            self.least[q] = max(self.least[q], score[order[-1]])


def search(queries: Queries, least: np.ndarray, top: int):
    """Arrow batches (IMPACTS) to query, score, doc_id of the best of these documents; none below least."""

    def run(batches):
        import pyarrow as pa

        best = Best(least, top)

        def visit(table):
            bucket = Bucket(table)
            active = np.flatnonzero((queries.length > 0) & (queries.length * bucket.length.max() * SLACK >= best.least))
            if len(active) == 0:
                return
            bounds = bucket.bounds(queries, active)
            for j, q in enumerate(active.tolist()):
                rows = np.flatnonzero(bounds[:, j] >= best.least[q])
                if len(rows) == 0:
                    continue
                score = bucket.scores(rows, queries.terms[q], queries.weights[q], queries.width)
                good = score >= best.least[q]
                best.add(q, score[good], bucket.no_id[rows[good]], bucket.doc_id[rows[good]])

        waiting, held = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET):
                piece = batch.slice(start, BUCKET)
                if held + piece.num_rows > BUCKET:
                    visit(pa.Table.from_batches(waiting))
                    waiting, held = [], 0
                waiting.append(piece)
                held += piece.num_rows
        if held:
            visit(pa.Table.from_batches(waiting))
        for q, (score, no_id, doc_id) in enumerate(best.held):
            if len(score):
                ids = pa.array(doc_id, pa.int64(), mask=no_id)
                yield pa.RecordBatch.from_pydict({"query": pa.array([q] * len(score), pa.int32()), "score": pa.array(score), "doc_id": ids})
        give_back()

    return run


FOUND = "query int, score long, doc_id long"


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The top rows of each query of found (FOUND), with rank; chosen in salted parts first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)


def query_vectors(texts: list, words_of=None) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    """The distinct terms of query texts, and for each text its term numbers and how often it has them."""
    import pyarrow as pa

    raw, off = text_bytes(pa.array(texts, pa.large_string()))
    words, sizes = terms(raw, off)
    coded = words.dictionary_encode()
    number, at = coded.indices.to_numpy(), 0
    known, repeats = [], []
    for n in sizes.tolist():
        a, b = np.unique(number[at : at + n], return_counts=True)
        known.append(a)
        repeats.append(b.astype(np.int64))
        at += n
    return coded.dictionary.to_pylist(), known, repeats


def search_block(docs: DataFrame, items: list, top: int) -> DataFrame:
    """item_id, rank, doc_id, score of a block of items (rows of item_id, text)."""
    spark = docs.sparkSession
    place = shared_dir(spark)
    words, known, repeats = query_vectors([r["text"] for r in items])
    rows = stored(vectors(docs, words), f"{place}/vectors")
    count, total = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    frequency = document_frequencies(rows, len(words))
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * f + 1))) for f in frequency.tolist()], np.int64)
    queries = Queries(known, repeats, weight)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = impacts(rows, count, total or 1)
    by_length = own.repartitionByRange(parts, F.col("length").desc(), F.xxhash64("doc_id")).sortWithinPartitions(F.col("length").desc())
    ordered = stored(by_length, f"{place}/ordered")
    cuts = ordered.agg(F.percentile_approx("length", [1 - s for s in ROUNDS], 10_000)).first()[0] or []
    least, found = np.ones(len(items), np.int64), None
    bounds = [None, *cuts, None]
    for i, (high, low) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        some = ordered if high is None else ordered.where(F.col("length") < high)
        some = some if low is None else some.where(F.col("length") >= low)
        here = some.mapInArrow(search(queries, least, top), FOUND)
        here = here if found is None else here.unionByName(found)
        found = stored(best_of(here, top).select("query", "score", "doc_id"), f"{place}/round{i}")
        full = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == top)
        for r in full.toLocalIterator():  # one row a query of this block
            least[r["query"]] = max(1, r["least"])
    names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(items)], "query int, item_id long")
    return best_of(found, top).join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The top documents of docs (doc_id, text) for each row of items (item_id, text): item_id, rank, doc_id, score."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks, out = max(1, math.ceil(size / BLOCK_BYTES)), None
    for block in range(blocks):
        of_block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        found = search_block(docs, of_block, top)
        out = found if out is None else out.unionByName(found)
    return out


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY term, s.n),
x AS (
  SELECT t.r, t.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.terms) * s.n) // s.total))) AS part
  FROM t JOIN d USING (r) JOIN w USING (term), s),
p AS (SELECT q, item_id, unnest(terms) AS term FROM i),
f AS (SELECT q, item_id, r, sum(part)::BIGINT AS score FROM p JOIN x USING (term) GROUP BY 1, 2, 3 HAVING sum(part) > 0)
SELECT item_id, rank, doc_id, score
FROM (SELECT f.item_id, d.doc_id, f.score, row_number() OVER (PARTITION BY f.q ORDER BY f.score DESC, d.doc_id)::INT AS rank
      FROM f JOIN d USING (r)) WHERE rank <= 10
"""
