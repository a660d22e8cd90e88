"""BPE encoding and decoding by a table of distinct words.

Texts are split into the tokenizer's words. A block of documents has distinct words, and a number
for each word of its texts; it asks once for each distinct word. Words meet by key, each distinct
word of the corpus is encoded once, and its ids are joined back to the block's word numbers, by
position. What is asked and what is numbered comes from two passes over docs, which must give the
same blocks (a scan of files or a stored table does); a difference is told by the words' keys and
raises. One stored pass would take 1.8 times the input's disk. Decoding joins the distinct ids of a block with the pieces of
the vocabulary, which is of fixed size (some 50,000 pieces) and so can be broadcast, and puts the
pieces of each text's ids together.

Defined cases: null text is empty; an empty text has no ids and decodes to the empty text.
Repeated rows and null ids give a row each. Special tokens in a text are encoded as such. An id
that the vocabulary lacks decodes to nothing. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.llm.blocks import BLOCK_ROWS, counts_in, counts_out, numbered, planes, unplanes
from lendscope.llm.shared import TOKENIZER, encoder, expand, shared_dir, squeeze, stored, text_bytes, tokenizer_path

#: Bytes of text in a block, and those whose words one part of the word table is asked for.
BLOCK_BYTES, PART_BYTES = 10_000_000, 40_000_000
#: Parts of the word table per shuffle partition, at least.
SPREAD = 2
#: Ids in a block of decode().
BLOCK_IDS = 2_000_000

BLANK, LETTER, NUMBER, OTHER = range(4)


@functools.cache
def kinds() -> np.ndarray:
    """BLANK, LETTER, NUMBER or OTHER for each code point."""
    import regex

    codes = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    every = codes.astype("<u4").tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((BLANK, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for found in regex.finditer(pattern, every):
            table[codes[found.start() : found.end()]] = kind
    return table


def byte_kinds(raw: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 the kind of its character."""
    table = kinds()
    out = table[raw]
    for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
        lead = np.flatnonzero((raw >= low) & (raw < high))
        code = raw[lead].astype(np.int64) & (0x3F >> more)
        for i in range(1, more + 1):
            code = code << 6 | raw[lead + i] & 0x3F
        for i in range(more + 1):
            out[lead + i] = table[code]
    return out


def word_starts(raw: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where words begin (one flag a byte) in texts that begin at the flags of edge, which has
    one more at the end of all.

    A word is a run of letters, of numbers, or of signs, with the blank (32) before it; of a run
    of blanks before a word the last one is apart; and an apostrophe that begins a word goes with
    the endings s, t, m, d, re, ve and ll.
    """
    n = len(raw)
    kind = byte_kinds(raw)
    run = edge[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(run)
    ends = np.append(starts[1:], n)
    of_run = kind[starts]
    begins = np.zeros(n + 1, bool)
    inner = starts > 0
    inner[inner] = ~edge[starts[inner]]
    spaced = inner.copy()
    spaced[inner] = raw[starts[inner] - 1] == 32
    begins[starts[(of_run == BLANK) | ~spaced]] = True
    last = ends[(of_run == BLANK) & ~edge[ends]] - 1
    for _ in range(3):
        last -= (raw[last] & 0xC0) == 0x80
    begins[last] = True
    at = np.flatnonzero((of_run == LETTER) & inner)
    at = at[(ends[at - 1] - starts[at - 1] == 1) & (raw[starts[at] - 1] == 39) & ~spaced[at - 1]]
    first, end = starts[at], ends[at]
    one, two = raw[first], np.where(end - first > 1, raw[np.minimum(first + 1, n - 1)], 0)
    size = np.isin(one, [*b"stmd"]) + 2 * (np.isin(one, [*b"rv"]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    first, size, end = first[size > 0], size[size > 0], end[size > 0]
    begins[first] = False
    begins[(first + size)[first + size < end]] = True
    return begins[:n]


def split(raw: np.ndarray, off: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in texts (bytes and offsets), and how many words each text has; marks
    are special tokens."""
    import re

    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    edge[-1] = True
    inside = []
    if marks:
        for found in re.finditer(b"|".join(map(re.escape, marks)), raw.tobytes()):
            a, b = found.span()
            if not edge[a + 1 : b].any():
                inside.append((a, b))
    for a, b in inside:
        edge[[a, b]] = True
    begins = word_starts(raw, edge)
    for a, b in inside:
        begins[a], begins[a + 1 : b] = True, False
    starts = np.flatnonzero(begins)
    return starts, np.diff(np.searchsorted(starts, off))


def packed_words(words) -> list[bytes]:
    """A binary array as packed lengths and bytes."""
    raw, off = text_bytes(words)
    return [counts_in(np.diff(off)), squeeze(raw.tobytes())]


def unpacked_words(payload: list[bytes]):
    import pyarrow as pa

    off = np.zeros(1, np.int64)
    off = np.append(off, np.cumsum(counts_out(payload[0])))
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(expand(payload[1]))])


def keys_of(words) -> np.ndarray:
    """The key of each word of a binary array, from 0 to 2**32 - 1."""
    return np.fromiter((zlib.crc32(w) for w in words.to_pylist()), np.int64, len(words))


def special_tokens(name: str) -> list[bytes]:
    return sorted((t.encode() for t in encoder(name).special_tokens_set), key=len, reverse=True)


class Block:
    """Distinct words of a block in the order of their keys, their keys, how often each occurs, the
    number of each word (by falling frequency, then key), and how many words each text has."""

    def __init__(self, number: int, table, marks: list[bytes]):
        import pyarrow as pa

        raw, off = text_bytes(table["text"])
        starts, self.sizes = split(raw, off, marks)
        ends = np.append(starts, len(raw))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        known, number_of = words.dictionary, words.indices.to_numpy()
        keys, times = keys_of(known), np.bincount(number_of, minlength=len(known))
        by_key = np.argsort(keys, kind="stable")
        place = np.empty(len(known), np.uint32)
        place[by_key[np.argsort(-times[by_key], kind="stable")]] = np.arange(len(known), dtype=np.uint32)
        self.block, self.doc_id = number, table["doc_id"]
        self.words, self.keys, self.times, self.numbers = known.take(pa.array(by_key)), keys[by_key], times[by_key], place[number_of]


ASKED, ANSWERED = "part int, block long, words array<binary>", "block long, part int, mark long, ids array<binary>, used array<int>"


def ask(parts: int, tokenizer: str):
    """The words of each block by part; parts follow the order of keys."""

    def run(batches):
        import pyarrow as pa

        marks = special_tokens(tokenizer)
        for number, table in numbered(batches, most=BLOCK_BYTES):
            own = Block(number, table, marks)
            part = own.keys * parts >> 32
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([int(part[a])], pa.int32()),
                        "block": pa.array([number], pa.int64()),
                        "words": pa.array([packed_words(own.words.slice(a, b - a))], pa.list_(pa.binary())),
                    }
                )

    return run


NUMBERED = "block long, mark long, times binary, numbers binary, sizes binary, doc_id array<long>"


def number_words(tokenizer: str):
    """The word numbers of each block; mark: the sum of its words' keys."""

    def run(batches):
        import pyarrow as pa

        marks = special_tokens(tokenizer)
        for number, table in numbered(batches, most=BLOCK_BYTES):
            own = Block(number, table, marks)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "mark": pa.array([int(own.keys.sum())], pa.int64()),
                    "times": pa.array([counts_in(own.times)], pa.binary()),
                    "numbers": pa.array([planes(own.numbers)], pa.binary()),
                    "sizes": pa.array([counts_in(own.sizes)], pa.binary()),
                    "doc_id": pa.array([own.doc_id.to_pylist()], pa.list_(pa.int64())),
                }
            )

    return run


def encode_words(words: list[bytes], name: str) -> list[list[int]]:
    """The ids of each word, whatever its length: words are merged as they are, no pattern splits them again."""
    tool = encoder(name)
    special = {t.encode(): tool.encode_single_token(t) for t in tool.special_tokens_set}
    return [[special[w]] if w in special else tool._encode_single_piece(w) for w in words]


def text_ids(texts, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of an Arrow column of texts, and how many each text has; distinct words are encoded once."""
    import pyarrow as pa

    raw, off = text_bytes(texts)
    starts, words_of = split(raw, off, special_tokens(name))
    ends = np.append(starts, len(raw))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
    found = encode_words(words.dictionary.to_pylist(), name)
    size = np.array([len(x) for x in found], np.int64)
    own, ids = gathered_ids(size, np.array([i for x in found for i in x], np.uint32), words.indices.to_numpy())
    return ids, np.diff(np.append(0, np.cumsum(own))[np.append(0, np.cumsum(words_of))])


def gathered_ids(size: np.ndarray, ids: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of words picked by number, out of all words' sizes and ids."""
    start = np.cumsum(size) - size
    own = size[which]
    inner = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
    return own, ids[np.repeat(start[which], own) + inner]


def answer(tokenizer: str):
    """Encodes the distinct words of a part, and gives each block the ids of its own."""

    def run(group):
        import pyarrow as pa

        asked = [unpacked_words(p) for p in group["words"].to_pylist()]
        every = pa.concat_arrays(asked).dictionary_encode()
        found = encode_words(every.dictionary.to_pylist(), tokenizer)
        size = np.array([len(x) for x in found], np.int64)
        ids = np.array([i for x in found for i in x], np.uint32)
        which, at, packed, used, mark = every.indices.to_numpy(), 0, [], [], []
        keys = keys_of(every.dictionary)
        for words in asked:
            own, some = gathered_ids(size, ids, which[at : at + len(words)])
            packed.append([counts_in(own), planes(some)])
            used.append(np.unique(some).astype(np.int32))
            mark.append(int(keys[which[at : at + len(words)]].sum()))
            at += len(words)
        return pa.table({"block": group["block"], "part": group["part"], "mark": pa.array(mark, pa.int64()), "ids": pa.array(packed, pa.list_(pa.binary())), "used": pa.array(used, pa.list_(pa.int32()))})

    return run


def piece_table(spark: SparkSession, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, piece (bytes) of the vocabulary, read from its file by one task."""

    def run(batches):
        import pyarrow as pa
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(tokenizer_path(tokenizer))
        marks = {t.content for t in tool.get_added_tokens_decoder().values()}
        # Printable Latin-1 characters stand for their own byte, the others count up from 256.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in set(own)]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        shown = [tool.id_to_token(i) or "" for i in range(tool.get_vocab_size(with_added_tokens=True))]
        pieces = [s.encode() if s in marks else bytes(byte_of[c] for c in s) for s in shown]
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"id": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.binary())})

    return spark.range(1, numPartitions=1).mapInArrow(run, "id int, piece binary")


def pieces_of(used: DataFrame, tokenizer: str) -> DataFrame:
    """block, pieces (id and bytes of each of its distinct ids), of used (block, used): ids joined
    with the piece table."""
    ids = used.select(F.col("block").alias("block"), "used").groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("ids"))
    joined = ids.select("block", F.explode("ids").alias("id")).join(F.broadcast(piece_table(used.sparkSession, tokenizer)), "id", "left")
    return joined.groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))


def texts_from(ids: np.ndarray, ends: np.ndarray, pieces):
    """The texts that runs of ids, which end where ends (0 first) says, decode to; pieces: an Arrow
    array of id and piece."""
    import pyarrow as pa

    known = pieces.field(0).to_numpy()
    place = np.zeros(int(known.max(initial=-1)) + 1, np.int64)
    place[known] = np.arange(len(known))
    raw, off = text_bytes(pieces.field(1).take(pa.array(place[ids])))
    data, bounds = raw.tobytes(), off[ends]
    try:
        data.decode()
        return pa.array([data[a:b].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.large_string())
    except UnicodeDecodeError:  # ids that are no whole characters
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.large_string())


CODED = "row long, doc_id long, ids array<int>, text string"
#: Bits of a row's number for its place in the block, and for the block's place in the partition.
ROW_BITS, BLOCK_BITS = 17, 23


def row_numbers(block: int, rows: int) -> np.ndarray:
    """Numbers of a block's rows; a block number has its partition in the bits from 32 on. 2**23 partitions have room."""
    partition, place = block >> 32, block & (1 << 32) - 1
    if rows > 1 << ROW_BITS or place >= 1 << BLOCK_BITS or partition >= 1 << 63 - ROW_BITS - BLOCK_BITS:
        raise ValueError("more rows, blocks or partitions than row numbers tell apart")
    return (partition << ROW_BITS + BLOCK_BITS) + (place << ROW_BITS) + np.arange(rows, dtype=np.int64)


def _coded(block: int, doc_ids: list, ids: np.ndarray, ends: np.ndarray, pieces):
    import pyarrow as pa

    return pa.table(
        {
            "row": pa.array(row_numbers(block, len(ends) - 1)),
            "doc_id": pa.array(doc_ids, pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))),
            "text": texts_from(ids, ends, pieces).cast(pa.string()),
        }
    )


def restore(rows, answers):
    """Ids and decoded texts of a block, from its word numbers, the ids of its words and their pieces."""
    import pyarrow as pa

    of_part = sorted((p, x) for p, x in zip(answers["part"].to_pylist(), answers["ids"].to_pylist(), strict=True) if x is not None)
    pieces = [x.values for x in answers["pieces"] if x.is_valid]
    row = rows.to_pylist()[0]
    if sum(x for x in answers["mark"].to_pylist() if x is not None) != row["mark"]:
        raise ValueError("a block differs from the one whose words were encoded: docs must be repeatable, so store them first")
    times, sizes = counts_out(row["times"]), counts_out(row["sizes"])
    size = np.concatenate([np.zeros(0, np.int64), *(counts_out(x[0]) for _, x in of_part)])
    ids = np.concatenate([np.zeros(0, np.uint32), *(unplanes(x[1], np.uint32) for _, x in of_part)])
    by_times = np.argsort(-times, kind="stable")
    own, found = gathered_ids(size, ids, by_times[unplanes(row["numbers"], np.uint32)])
    ends = np.append(0, np.cumsum(own))[np.append(0, np.cumsum(sizes))]
    none = pa.array([], pa.struct([("id", pa.int32()), ("piece", pa.binary())]))
    return _coded(row["block"], row["doc_id"], found, ends, pieces[0] if pieces else none)


def code_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """CODED of each row of docs (doc_id, text): a number of its own, its ids, and the text that
    they decode to."""
    spark = docs.sparkSession
    place = shared_dir(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    asked = texts.select("doc_id", "text").mapInArrow(ask(parts, tokenizer), ASKED)
    answers = stored(asked.groupBy("part").applyInArrow(answer(tokenizer), ANSWERED), f"{place}/answers")
    sides = answers.drop("used").unionByName(pieces_of(answers.select("block", "used"), tokenizer), allowMissingColumns=True)
    rows = texts.mapInArrow(number_words(tokenizer), NUMBERED)
    return rows.groupBy("block").cogroup(sides.groupBy("block")).applyInArrow(restore, CODED)


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """CODED of each row of encoded (doc_id, ids)."""

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            start = 0
            sizes = np.array([len(x or ()) for x in batch.column(1).to_pylist()], np.int64)
            while start < len(sizes):
                stop = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start : start + BLOCK_ROWS]), BLOCK_IDS)) + start)
                ids = batch.column(1).slice(start, stop - start).flatten().to_numpy()
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([block], pa.int64()),
                        "doc_id": pa.array([batch.column(0).slice(start, stop - start).to_pylist()], pa.list_(pa.int64())),
                        "sizes": pa.array([counts_in(sizes[start:stop])], pa.binary()),
                        "ids": pa.array([planes(ids.astype(np.uint32))], pa.binary()),
                        "used": pa.array([np.unique(ids)], pa.list_(pa.int32())),
                    }
                )
                block, start = block + 1, stop

    def unpack(rows, pieces):
        import pyarrow as pa

        row = rows.to_pylist()[0]
        none = pa.array([], pa.struct([("id", pa.int32()), ("piece", pa.binary())]))
        got = pieces["pieces"][0].values if len(pieces) else none
        return _coded(row["block"], row["doc_id"], unplanes(row["ids"], np.uint32), np.append(0, np.cumsum(counts_out(row["sizes"]))), got)

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    blocks = stored(rows.mapInArrow(pack, "block long, doc_id array<long>, sizes binary, ids binary, used array<int>"), f"{shared_dir(encoded.sparkSession)}/ids")
    return blocks.drop("used").groupBy("block").cogroup(pieces_of(blocks.select("block", "used"), tokenizer).groupBy("block")).applyInArrow(unpack, CODED)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of CODED rows."""
    line = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(line, 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256")
    )
