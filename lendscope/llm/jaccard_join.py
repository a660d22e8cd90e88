"""Jaccard join of documents on five-word shingles by chosen paths.

Equal shingle sets are one node. A node walks from the root of each run along sampled tokens
of its set: a token is a coordinate of its min-wise signature with that coordinate's value, and
a path goes on along each coordinate that the path's own hash picks, 1/0.8 of them on average,
so two sets of similarity 0.8 share one path a level on average. Nodes that share a path are a
bucket; buckets of up to BRUTE nodes are compared by brute force, larger ones are split again,
DEPTH levels at most, and what is still large is compared in tiles. A pair is compared in the first
bucket that both have. Runs are repeated until a
pair at the threshold is found with RECALL even at the last level. Pairs are checked exactly on
whole shingle sets (64-bit shingle hashes); a second hash verifies the ids of sets.

Result: for each document its class (the least doc_id it is connected with by links of
similarity 0.8 or more) and how many other documents are linked with it.

Defined cases: words are what ASCII white space parts, A-Z lowered. A text of one to four words
has one shingle of all of them; a text without words (null too) links with nothing. Repeated
rows and copies count as documents of their own. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.blocks import gathered
from lendscope.llm.linkage import bucket_lists, candidates, components, verified_links
from lendscope.llm.shared import MIX1, MIX2, MULT, kept_rows, mix64, shared_dir, stored, text_bytes, word_hashes

WORDS, LEAST = 5, 0.8
COORDINATES = 64
BRUTE, DEPTH = 128, 3
RECALL = 0.999
SEED = 977
#: Of COORDINATES, how many agree at least for sets of similarity LEAST: five deviations below the mean.
AGREE = math.floor(COORDINATES * LEAST - 5 * math.sqrt(COORDINATES * LEAST * (1 - LEAST)))
#: Bytes of text hashed at once.
SLICE = 2_000_000


def runs_needed(depth: int = DEPTH, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met with this probability: paths of such a
    pair are a branching process with one child on average."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def root_paths() -> list[tuple[int, int]]:
    """(run, coordinate) picked at the root of each run."""
    runs = np.arange(runs_needed(), dtype=np.uint64)
    with np.errstate(over="ignore"):
        pick = mix64(mix64(runs + np.uint64(SEED))[:, None] + np.arange(COORDINATES, dtype=np.uint64)[None, :])
    chance = 1 / (LEAST * COORDINATES)
    return [(int(r), int(c)) for r, c in zip(*np.nonzero(pick < np.uint64(int(chance * 2**64))), strict=True)]


def shingles(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, sizes = word_hashes(raw, off)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for n in sizes.tolist():
            own = words[at : at + n]
            at += n
            span = min(n, WORDS)
            if n == 0:
                out.append(own)
                continue
            h = np.full(n - span + 1, np.uint64(span), np.uint64)
            for i in range(span):
                h = h * MULT + own[i : n - span + 1 + i]
            out.append(np.unique(mix64(h)))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-wise signatures of non-empty sets."""
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(COORDINATES):
            out[:, i] = np.minimum.reduceat(flat * odd[i] + add[i], starts)
    return mix64(out)


def set_ids(sets: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """64-bit identifiers of sets; another salt gives independent ones."""
    with np.errstate(over="ignore"):
        add = np.uint64(salt) * MIX1
        sums = np.array([mix64(s + add).sum(dtype=np.uint64) if len(s) else np.uint64(0) for s in sets], np.uint64)
        return mix64(sums + np.array([len(s) for s in sets], np.uint64) * MIX2).view(np.int64)


def _tables(batches):
    """(table, bytes, offsets) of bounded slices."""
    for table in gathered(batches, most=SLICE):
        yield table, *text_bytes(table["text"])


def described(docs: DataFrame, salt: int = 0) -> DataFrame:
    """doc_id, raw_sha256, id (of its set), check (another id of it), size (0: no words), paths of the
    first level, sketch."""
    paths = root_paths()

    def run(batches):
        import pyarrow as pa

        runs = np.array([r for r, _ in paths], np.uint64)
        at = np.array([c for _, c in paths])
        for table, raw, off in _tables(batches):
            sets = shingles(raw, off)
            full = np.array([len(s) > 0 for s in sets])
            keys = np.zeros((len(sets), len(paths)), np.int64)
            sketch = [b""] * len(sets)
            if full.any():
                sig = signatures([s for s in sets if len(s)])
                with np.errstate(over="ignore"):
                    keys[full] = mix64(mix64(sig[:, at]) + (runs * np.uint64(COORDINATES) + at.astype(np.uint64)) * MIX2).view(np.int64)
                for i, s in zip(np.flatnonzero(full).tolist(), sig.astype(np.uint16), strict=True):
                    sketch[i] = s.tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": table["doc_id"].combine_chunks().cast(pa.int64()),
                    "raw_sha256": table["raw_sha256"].combine_chunks(),
                    "id": pa.array(set_ids(sets, salt)),
                    "check": pa.array(set_ids(sets, salt + 1)),
                    "size": pa.array([len(s) for s in sets], pa.int64()),
                    "paths": pa.array([k.tolist() for k in keys], pa.list_(pa.int64())),
                    "sketch": pa.array(sketch, pa.binary()),
                }
            )

    return docs.mapInArrow(run, "doc_id long, raw_sha256 string, id long, check long, size long, paths array<long>, sketch binary")


def longer(members: DataFrame) -> DataFrame:
    """id, bucket for each path of members (id, bucket, sketch) that goes on."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            path = batch.column(1).to_numpy().view(np.uint64)
            values = np.array([np.frombuffer(s, np.uint16) for s in batch.column(2).to_pylist()]).reshape(len(ids), COORDINATES)
            with np.errstate(over="ignore"):
                pick = mix64(path[:, None] * MULT + np.arange(COORDINATES, dtype=np.uint64)[None, :])
                row, c = np.nonzero(pick < np.uint64(int(2**64 / (LEAST * COORDINATES))))
                key = mix64(mix64(path[row] + c.astype(np.uint64) * MIX2) + values[row, c])
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[row]), "bucket": pa.array(key.view(np.int64))})

    return members.select("id", "bucket", "sketch").mapInArrow(run, "id long, bucket long")


def agreeing(table) -> np.ndarray:
    """Rows whose sketches agree in AGREE coordinates or more."""
    x = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(-1, COORDINATES)
    if len(x) <= 64:  # most buckets: one step
        return (x[:, None] == x[None]).sum(axis=2) >= AGREE
    out = np.zeros((len(x), len(x)), np.uint8)
    for i in range(COORDINATES):
        out += x[:, i][:, None] == x[:, i][None, :]
    return out >= AGREE


def alike(least: float):
    def similar(table, some: np.ndarray) -> np.ndarray:
        """Exact Jaccard similarity of some whole sets with all: shared shingles by products of slabs of
        the incidence matrix, over shingles that two rows have."""
        sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), sizes)
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        keep = times[column] > 1
        number = np.cumsum(times > 1) - 1
        row, column = row[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((len(some), len(sets)), np.float32)
        width = int(min(max(4_000_000 // len(sets), 1), column[-1] + 1 if len(column) else 1))
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [low, low + width])
            slab = np.zeros((len(sets), width), np.float32)
            slab[row[a:b], column[a:b] - low] = 1
            shared += slab[some] @ slab.T
        return shared >= least * (sizes[some][:, None] + sizes[None, :] - shared) - 1e-6

    return similar


def with_shingles(docs: DataFrame, salt: int = 0) -> DataFrame:
    """id, shingles (sorted 64-bit hashes) of docs, once for each set: a task tells a set once, and of what
    tasks tell one stays."""

    def run(batches):
        import pyarrow as pa

        told: set[int] = set()
        for table, raw, off in _tables(batches):
            sets = shingles(raw, off)
            ids = set_ids(sets, salt)
            new = [i for i, x in enumerate(ids.tolist()) if not (x in told or told.add(x))]
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[new]), "shingles": pa.array([sets[i].tobytes() for i in new], pa.binary())})

    return docs.mapInArrow(run, "id long, shingles binary").groupBy("id").agg(F.first("shingles").alias("shingles"))


def buckets(nodes: DataFrame, place: str) -> DataFrame:
    """id, bucket, n (its nodes): buckets to compare, of nodes (id, paths, sketch)."""
    level = nodes.select("id", F.explode("paths").alias("bucket"))
    out = None
    for depth in range(1, DEPTH + 1):
        shared = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        both = stored(level.join(shared, "bucket").select("id", "bucket", "n"), f"{place}/level{depth}")
        last = depth == DEPTH
        ready = both if last else both.where(F.col("n") <= BRUTE)
        out = ready if out is None else out.unionByName(ready)
        large = both.where(F.col("n") > BRUTE)
        if last or large.isEmpty():
            return out
        level = longer(large.join(nodes.select("id", "sketch"), "id").select("id", "bucket", "sketch"))
    return out


def described_nodes(texts: DataFrame, place: str) -> tuple[DataFrame, DataFrame, int]:
    """described() rows, the nodes (one for each set: id, doc_id, weight, size, paths, sketch), and the
    salt of the ids, under which no two sets have one id: a second identifier tells."""
    salt = 0
    while True:
        rows = stored(described(texts, salt), f"{place}/rows{salt}")
        first = [F.first(c).alias(c) for c in ("size", "paths", "sketch")]
        nodes = rows.where("size > 0").groupBy("id").agg(
            F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("weight"), F.min("check").alias("low"), F.max("check").alias("high"), *first
        )
        nodes = stored(nodes, f"{place}/nodes{salt}")
        if nodes.where("low < high").isEmpty():
            return rows, nodes.drop("low", "high"), salt
        salt += 2


def classified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, raw_sha256, id (of its set; null without words), class (an id of its class), class_id,
    n_links of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    place = shared_dir(spark)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("raw_sha256"))
    rows, nodes, salt = described_nodes(texts, place)
    compared = stored(buckets(nodes, place), f"{place}/compared")
    lists = stored(bucket_lists(compared).join(nodes.select("id", "sketch"), "id"), f"{place}/lists")
    found = stored(candidates(compared, lists, agreeing), f"{place}/candidates")
    # Only documents of nodes that have candidates are shingled again.
    known = nodes.select("id", "doc_id", "weight").join(found.select("id").distinct(), "id").join(lists.select("id", "buckets"), "id")
    known = stored(known, f"{place}/members")
    of_id = known.select(F.col("doc_id").alias("of_id")).distinct()
    wanted = texts.join(of_id, texts["doc_id"].eqNullSafe(of_id["of_id"]), "left_semi").select("text")
    payload = with_shingles(wanted, salt).join(known.select("id", "buckets", "weight"), "id")
    links = stored(verified_links(found, nodes.select("id", (8 * F.col("size")).alias("bytes")), payload, alike(least)), f"{place}/links")
    real = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), f"{place}/components")
    ids = nodes.select("id", "doc_id", "weight")
    least_id = stored(real.join(ids, "id").groupBy("component").agg(F.min("doc_id").alias("class_id")), f"{place}/named")
    classes = real.join(least_id, "component").select("id", F.col("component").alias("class"), "class_id")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    known = ids.join(classes, "id", "left").join(counts, "id", "left")
    known = known.select(
        "id", F.coalesce("class", "id").alias("class"), F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n")
    )
    known = stored(known, f"{place}/classes")
    of_set = rows.where("size > 0").select("doc_id", "raw_sha256", "id").join(known, "id")
    of_set = of_set.select("doc_id", "raw_sha256", "id", "class", "class_id", F.col("n").cast("long").alias("n_links"))
    no_words = rows.where("size = 0").selectExpr("doc_id", "raw_sha256", "CAST(NULL AS LONG) AS id", "CAST(NULL AS LONG) AS class", "doc_id AS class_id", "0L AS n_links")
    return of_set.unionByName(no_words)


def near_documents(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id, n_links, kept of each row of docs (doc_id, text)."""
    return classified(docs, least).select("doc_id", "class_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of docs, with its own columns: that of the least doc_id (null last), of
    those the one whose text hash is least. Rows without words all stay."""
    rows = stored(classified(docs).select("doc_id", "raw_sha256", "class"), f"{shared_dir(docs.sparkSession)}/classified")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw_sha256")
    first = stored(rows.where("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("first")), f"{shared_dir(docs.sparkSession)}/first")
    stays = F.col("class").isNull() | F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("raw_sha256") == F.col("first.raw_sha256"))
    return kept_rows(docs, rows.join(first, "class", "left").select("doc_id", "raw_sha256", stays.alias("stays"), F.col("class").isNotNull().alias("once")))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (SELECT DISTINCT r, array_to_string(words[i : i + least(len(words), 5) - 1], ' ') AS shingle
      FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-6),
reach(a, b) AS (SELECT r, r FROM w UNION SELECT reach.a, l.b FROM reach JOIN links l ON reach.b = l.a),
c AS (SELECT reach.a AS r, min(w.doc_id) AS class_id FROM reach JOIN w ON w.r = reach.b GROUP BY 1)
SELECT w.doc_id, c.class_id, (SELECT count(*) FROM links l WHERE l.a = w.r) AS n_links, w.doc_id = c.class_id AS kept
FROM w JOIN c USING (r)
"""
