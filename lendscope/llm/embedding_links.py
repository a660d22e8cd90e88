"""Near-duplicate embeddings: sign hashing by random hyperplanes in several tables, exact
cosines, connected components.

A table's key is the row's label, its dimension and BITS signs; the number of signs follows
the size of the largest label and the number of tables the wanted recall for a pair just at
the threshold. All signs together are the row's sketch, which tells candidates in a bucket; each
candidate pair's cosine is computed in double precision in the first bucket that both rows have.
Equal vectors of a label are one node.

Defined cases: a vector that is null, empty or zero, or that holds null or non-finite
components, and a row whose label is null, links with nothing and is its own component.
Vectors of different dimension don't link. Repeated rows are vectors of their own and link
with each other. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.linkage import bucket_lists, candidates, components, verified_links
from lendscope.llm.shared import mix64, shared_dir, stored

SEED = 20231
RECALL = 0.9999


def plan(rows_of_label: int, least: float) -> tuple[int, int, int]:
    """Signs a table, tables, and in how many signs of the sketch similar rows may differ."""
    apart = math.acos(least) / math.pi
    bits = min(max(math.ceil(math.log2(max(rows_of_label, 1))) - 2, 8), 24)
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - apart) ** bits))
    signs = bits * tables
    return bits, tables, math.ceil(signs * apart + 5 * math.sqrt(signs * apart * (1 - apart)))


def hashed(rows: DataFrame, bits: int, tables: int) -> DataFrame:
    """id, buckets, sketch of rows (id, label, vector)."""

    def run(batches):
        import pyarrow as pa

        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                if size not in planes:
                    planes[size] = np.random.default_rng([SEED, size]).standard_normal((size, bits * tables))
                x = flat[(starts[own][:, None] + np.arange(size)).reshape(-1)].reshape(len(own), size)
                signs = (x @ planes[size]) > 0
                code = signs.reshape(len(own), tables, bits) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
                with np.errstate(over="ignore"):
                    home = mix64(label[own].astype(np.uint64) * np.uint64(1_000_003) + np.uint64(size))
                    keys = mix64(mix64(code + (np.arange(tables, dtype=np.uint64) << np.uint64(40))) + home[:, None]).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array(ids[own]),
                        "buckets": pa.array(list(keys), pa.list_(pa.int64())),
                        "sketch": pa.array([s.tobytes() for s in np.packbits(signs, axis=1)], pa.binary()),
                    }
                )

    return rows.mapInArrow(run, "id long, buckets array<long>, sketch binary")


def near_signs(most: int):
    def similar(table) -> np.ndarray:
        bits = np.array([np.frombuffer(s, np.uint8) for s in table["sketch"].to_pylist()])
        bits = np.unpackbits(bits, axis=1).astype(np.float32)
        ones = bits.sum(axis=1)
        return ones[:, None] + ones[None, :] - 2 * (bits @ bits.T) <= most + 0.5

    return similar


def near_cosine(least: float):
    def similar(table, some: np.ndarray) -> np.ndarray:
        x = np.array(table["vector"].to_pylist(), np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        return (x[some] @ x.T) / (norm[some][:, None] * norm[None, :]) >= least

    return similar


def embedding_links(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    place = shared_dir(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    rows = stored(rows, f"{place}/rows")
    usable = F.col("label").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    good = rows.where(usable)
    nodes = good.groupBy("label", "vector").agg(F.min("row").alias("id"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"))
    nodes = stored(nodes, f"{place}/nodes")
    node_of = good.select("row", "label", "vector").join(nodes.select("label", "vector", "id"), ["label", "vector"]).select("row", "id")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables, most = plan(largest, least)
    tagged = stored(hashed(nodes.select("id", "label", "vector"), bits, tables), f"{place}/hashed")
    keyed = tagged.select("id", F.explode("buckets").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    compared = stored(keyed.join(shared, "bucket"), f"{place}/compared")
    lists = stored(bucket_lists(compared).join(tagged.select("id", "sketch"), "id"), f"{place}/lists")
    found = stored(candidates(compared, lists, near_signs(most)), f"{place}/candidates")
    payload = nodes.select("id", "vector", "weight").join(lists.select("id", "buckets"), "id")
    links = verified_links(found, nodes.select("id", (8 * F.size("vector")).alias("bytes")), payload, near_cosine(least))
    links = stored(links, f"{place}/links")
    real = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), f"{place}/components")
    named = real.join(nodes.select("id", "vec_id"), "id")
    least_id = stored(named.groupBy("component").agg(F.min("vec_id").alias("component_id")), f"{place}/named")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    known = nodes.select("id", "vec_id", "weight").join(real.join(least_id, "component").select("id", "component_id"), "id", "left").join(counts, "id", "left")
    known = known.select("id", F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = stored(node_of.join(known, "id").drop("id"), f"{place}/classes")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("row", "vec_id").join(known, "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda e: e <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
   AND list_cosine_similarity(a.x, b.x) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       (SELECT min(b) FROM reach r WHERE r.a = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(b) FROM reach r WHERE r.a = e.vec_id) AS kept
FROM embeddings e
"""
