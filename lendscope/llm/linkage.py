"""Links between similar rows: candidates that share a bucket, exact checks, components.

A row has a list of buckets, and a pair of rows belongs to the least bucket that both have: there it
is compared and counted, once, whatever else the two share. In each bucket short sketches tell which
rows have a candidate of their own; only their payloads move to that bucket, where similarity is
computed exactly. Links are counted per row without writing one row a pair, and the spanning forest
of each bucket's verified links gives connected components. Buckets larger than a tile are cut into
tiles, and each pair of tiles is one piece of work, so a bucket that holds a third of all rows is
spread over many tasks and none holds more than two tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.shared import discard, give_back, stored

#: Rows of a tile, and bytes of payload.
TILE, TILE_BYTES = 512, 16_000_000


def spanning(linked: np.ndarray) -> np.ndarray:
    """For each row of a square link matrix the first row that it is connected with."""
    n = len(linked)
    root = np.full(n, -1)
    for start in range(n):
        if root[start] >= 0:
            continue
        reached = np.zeros(n, bool)
        reached[start] = True
        front = reached
        while front.any():
            front = linked[front].any(axis=0) & ~reached
            reached |= front
        root[reached & (root < 0)] = start
    return root


def tiles_for(rows, size=None):
    """How many tiles a group of that many rows (and bytes) is cut into."""
    n = F.ceil(rows / F.lit(TILE))
    return F.greatest(n if size is None else F.greatest(n, F.ceil(size / F.lit(TILE_BYTES))), F.lit(1)).cast("long")


def tiled(members: DataFrame, group: str, tiles: str) -> DataFrame:
    """members with tile, a key for each pair of the tiles of its group, and side: 0 and 1 for the
    two tiles, 2 for a tile against itself. A group of one tile has one key."""
    n = F.col(tiles)
    own = F.pmod(F.xxhash64("id", F.lit(7)), n)
    others = F.sequence(F.lit(0).cast("long"), n - 1)
    pairs = F.transform(
        others,
        lambda o: F.struct(
            F.xxhash64(F.col(group), F.least(o, own), F.greatest(o, own)).alias("tile"),
            F.when(o == own, 2).when(own < o, 0).otherwise(1).alias("side"),
        ),
    )
    return members.withColumn("at", F.explode(pairs)).select("*", "at.tile", "at.side").drop("at")


def runs(batches: Iterator, key: str) -> Iterator:
    """Arrow tables of equal keys, from batches sorted by key."""
    import pyarrow as pa

    waiting = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if waiting and waiting[-1].column(batch.schema.get_field_index(key))[0].as_py() != keys[a]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def in_tiles(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(table of one tile pair) -> dict of columns or None, for all tile pairs."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        kept: dict[str, list] = {c: [] for c in names}
        for table in runs(batches, "tile"):
            found = work(table)
            if found is not None:
                for c in names:
                    kept[c].append(found[c])
                if sum(map(len, kept[names[0]])) > 50_000:
                    yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(v)) for c, v in kept.items()})
                    kept = {c: [] for c in names}
        if kept[names[0]]:
            yield pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(v)) for c, v in kept.items()})
        give_back()

    return rows.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(run, schema)


def unique_rows(table):
    """table with each id once, in the order of ids."""
    _, first = np.unique(table["id"].to_numpy(), return_index=True)
    return table.take(first)


def keep_own(mask: np.ndarray, table) -> None:
    """Clear pairs that another piece of work owns: rows of one side of a tile pair, and rows that share a
    bucket before this one."""
    side, bucket = table["side"].to_numpy(), table["bucket"][0].as_py()
    np.fill_diagonal(mask, False)
    if side[0] != 2:
        mask &= side[:, None] != side[None, :]
    rows = np.flatnonzero(mask.any(axis=1))
    lists = table["buckets"].combine_chunks().take(rows)
    keys, of = lists.flatten().to_numpy(), np.repeat(rows, np.diff(lists.offsets.to_numpy()))
    keys, of = keys[keys < bucket], of[keys < bucket]
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    cuts = np.flatnonzero(np.diff(keys, prepend=np.nan, append=np.nan) != 0) if len(keys) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a > 1:
            mask[np.ix_(of[a:b], of[a:b])] = False


def covering(mask: np.ndarray) -> np.ndarray:
    """Rows that every pair of mask has one of, few where few rows have all pairs."""
    left, degree, chosen = mask.copy(), mask.sum(axis=1), []
    while len(chosen) < len(mask) // 4:
        row = int(degree.argmax())
        if degree[row] == 0:
            return np.array(chosen, int)
        chosen.append(row)
        degree -= left[:, row]
        degree[row] = 0
        left[row] = left[:, row] = False
    return np.flatnonzero(mask.any(axis=1))


def bucket_lists(compared: DataFrame) -> DataFrame:
    """id, buckets (rising) of compared (id, bucket)."""
    return compared.groupBy("id").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))


def candidates(compared: DataFrame, rows: DataFrame, similar: Callable) -> DataFrame:
    """id, bucket: rows with a candidate in a bucket that the pair belongs to.

    compared: id, bucket, n (rows of the bucket); rows: id, buckets, sketch; similar: of a table, a matrix.
    """

    def work(table):
        table = unique_rows(table)
        if table.num_rows < 2:
            return None
        linked = similar(table)
        keep_own(linked, table)
        some = linked.any(axis=1)
        return {"id": table["id"].to_numpy()[some], "bucket": table["bucket"].to_numpy()[some]} if some.any() else None

    members = compared.withColumn("tiles", tiles_for(F.col("n"))).join(rows, "id")
    return in_tiles(tiled(members, "bucket", "tiles"), work, "id long, bucket long").distinct()


def verified_links(found: DataFrame, sizes: DataFrame, rows: DataFrame, similar: Callable) -> DataFrame:
    """For each row and tile pair that has links: id, n (sum of the weights of the rows it is linked
    with), root (a row it is connected with).

    found: of candidates(); sizes: id, bytes (of the payload); rows: id, buckets, weight, payload columns;
    similar: of a table and some of its rows, a matrix of these against all.
    """

    def work(table):
        table = unique_rows(table)
        if table.num_rows < 2:
            return None
        mask = np.ones((table.num_rows, table.num_rows), bool)
        keep_own(mask, table)
        few = covering(mask)
        if len(few) == 0:
            return None
        linked = np.zeros_like(mask)
        linked[few] = similar(table, few)
        linked |= linked.T
        linked &= mask
        some = linked.any(axis=1)
        if not some.any():
            return None
        ids, weight = table["id"].to_numpy(), table["weight"].to_numpy().astype(np.int64)
        return {"id": ids[some], "n": (linked @ weight)[some], "root": ids[spanning(linked)][some]}

    tiles = found.join(sizes, "id").groupBy("bucket").agg(tiles_for(F.count(F.lit(1)), F.sum("bytes")).alias("tiles"))
    return in_tiles(tiled(found.join(tiles, "bucket").join(rows, "id"), "bucket", "tiles"), work, "id long, n long, root long")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, place: str) -> DataFrame:
    """id, component (its least member) for each id that has an edge (a, b).

    Large-star and small-star steps in turn until nothing changes: each step hangs neighbours
    on the least one, and the rounds grow with the logarithm of the largest component. Each
    round is a written table; the round before it is deleted.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{place}/round0")
    mark, n = _mark(now), 0
    while True:
        n += 1
        both = now.union(now.select("b", "a"))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), f"{place}/large{n}")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = stored(large, f"{place}/hung{n}")
        least = stored(large.groupBy("a").agg(F.min("b").alias("least")), f"{place}/small{n}")
        joined = large.join(least, "a")
        small = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", "least"))
        after = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{place}/round{n}")
        for gone in (f"round{n - 1}", f"large{n}", f"hung{n}", f"small{n}"):
            discard(spark, f"{place}/{gone}")
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
