"""Places and small pieces that several of these operators share."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Name of the tokenizer file; its place is looked up on each machine that needs it.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoder(name: str):
    """The tokenizer's merges as tiktoken ranks: the same ids, several times faster."""
    import base64
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    place = tokenizer_path(name)
    added = Tokenizer.from_file(place).get_added_tokens_decoder()
    with open(os.path.splitext(place)[0] + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t.content: i for i, t in added.items()})


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing a session whose executors are the driver's own process gets a
    temporary folder, and keeps it; any other session is an error, as its executors would not
    see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-lendscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    made = _OWN.get()
    made = PLACES if made is None else made
    made.append(f"{base.rstrip('/')}/lendscope-{uuid.uuid4().hex}")
    return made[-1]


#: Folders asked for outside of own_folders(), by any thread; those asked for in it, by this thread.
PLACES: list[str] = []
_OWN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("own_folders", default=None)


@contextlib.contextmanager
def own_folders(spark: SparkSession):
    """Delete, at the end, the folders that this thread has asked for meanwhile, and no others."""
    made: list[str] = []
    token = _OWN.set(made)
    try:
        yield
    finally:
        _OWN.reset(token)
        while made:
            discard(spark, made.pop())


def clear(spark: SparkSession) -> None:
    """Delete the tables in folders asked for outside of own_folders(); call it once what reads them is written."""
    while PLACES:
        discard(spark, PLACES.pop())


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as a table at path and read it back, which cuts its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    hadoop = spark._jsc.hadoopConfiguration()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(hadoop).delete(place, True)


#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(table: DataFrame, row_bytes: int) -> DataFrame:
    """table (stored, so that counting it is cheap) with a broadcast hint, where its rows fit."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def fresh(taken: list[str], *names: str) -> list[str]:
    """names, marked until no column of taken has them, whatever its case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def kept_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns.

    decided has for each row of docs (doc_id, text) doc_id, raw_sha256 (of its text, null as empty),
    stays, and once (of equal rows one stays). Only keys that go, or that several rows have, are
    joined with docs: broadcast where they are few, which leaves the texts in place.
    """
    keys = decided.groupBy("doc_id", "raw_sha256").agg(F.max("stays").alias("stays"), F.count(F.when(F.col("once"), 1)).alias("rows"))
    odd = stored(keys.where("NOT stays OR rows > 1"), f"{shared_dir(docs.sparkSession)}/odd")
    sha, of_id, of_sha, stay, rows, rank = fresh(docs.columns, "sha", "of_id", "of_sha", "stay", "rows", "rank")
    odd = odd.select(F.col("doc_id").alias(of_id), F.col("raw_sha256").alias(of_sha), F.col("stays").alias(stay), F.col("rows").alias(rows))
    tagged = docs.withColumn(sha, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (F.col(sha) == F.col(of_sha))
    plain = tagged.join(broadcast_if_small(odd, 120), same, "left_anti").select(*docs.columns)
    again = odd.where(F.col(stay))
    if again.isEmpty():
        return plain
    first = Window.partitionBy(of_id, sha).orderBy(*[F.col(c).cast("string") for c in docs.columns])
    repeated = tagged.join(broadcast_if_small(again, 120), same).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    return plain.unionByName(repeated.select(*docs.columns))


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    """Whether crc32(doc_id as text) mod parts is which; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(True))


def give_back() -> None:
    """Hand freed memory back to the system: workers stay after a task, beside those of the next one."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(work):
    """work on one group, or on two that meet, which hands freed memory back after each."""

    def of_one(group):
        out = work(group)
        give_back()
        return out

    def of_two(left, right):
        out = work(left, right)
        give_back()
        return out

    return of_one if work.__code__.co_argcount == 1 else of_two


# ---- arrays of bytes from Arrow text columns -------------------------------------------

#: Space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string or binary column, and the n+1 offsets; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(wide), b"" if wide == pa.large_binary() else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def owners(off: np.ndarray, a: int, b: int) -> tuple[int, np.ndarray]:
    """The first text that has one of bytes a to b, and for each of these bytes which text after it has it."""
    first, last = (np.searchsorted(off, [a, b - 1], side="right") - 1).tolist()
    held = np.minimum(off[first + 1 : last + 2], b) - np.maximum(off[first : last + 1], a)
    return first, np.repeat(np.arange(last - first + 1), held)


MULT = np.uint64(6364136223846793005)
MIX1 = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one-to-one."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * MIX1
        h = h ^ (h >> np.uint64(29))
        h = h * MIX2
        return h ^ (h >> np.uint64(32))


#: Bytes that are worked on at once, so that one long text or word takes little more memory than a short one.
PIECE = 1 << 20
#: A random value for each byte, and one for each of the first places of a word.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * MULT)
PLACE_VALUES = mix64(np.arange(1 << 12, dtype=np.uint64) * MIX2) | np.uint64(1)


def place_values(place: np.ndarray) -> np.ndarray:
    """A random odd value for each place in a word."""
    if len(place) == 0 or place.max() < len(PLACE_VALUES):
        return PLACE_VALUES[place]
    with np.errstate(over="ignore"):
        return mix64(place.astype(np.uint64) * MIX2) | np.uint64(1)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (ASCII white space apart, A-Z lowered) of all texts, and
    how many words each text has.

    A hash is the sum of a mixed value for each byte and its place, so texts and words of any length
    are worked on in pieces, and no arithmetic between places makes words of one length meet.
    """
    n_docs = len(off) - 1
    solid = ~SPACE[raw]
    first = solid.copy()
    edges = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]
    joined = solid[:-1].copy()
    joined[edges - 1] = False
    first[1:] &= ~joined
    del joined
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    hashes = np.zeros(len(starts), np.uint64)
    lengths = np.zeros(len(starts), np.int64)
    with np.errstate(over="ignore"):
        for a in range(0, len(raw), PIECE):
            at = np.flatnonzero(solid[a : a + PIECE])
            if len(at) == 0:
                continue
            new = first[a : a + PIECE][at]
            word = np.searchsorted(starts, a + at[0], side="right") - 1
            cuts = np.flatnonzero(new)
            if not new[0]:
                cuts = np.concatenate([np.zeros(1, np.int64), cuts])
            held = np.diff(np.append(cuts, len(at)))
            own = slice(word, word + len(cuts))
            value = BYTE_VALUES[LOWER[raw[a : a + PIECE][at]]]
            value *= place_values(at + a - np.repeat(starts[own], held))
            value ^= value >> np.uint64(32)
            hashes[own] += np.add.reduceat(value, cuts)
            lengths[own] += held
        hashes += lengths.astype(np.uint64) * MIX2
    return mix64(hashes), np.diff(np.searchsorted(starts, off))


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)
