"""Packing of documents into windows of a fixed length by dynamic programming, in order.

The tokens of neighbouring documents form one stream a block. Windows are cut at document
ends (free), sentence ends (SENTENCE_CUT) or, so that there is always a way, at whole
multiples of the window and in the powers of two that the last part adds up to (TOKEN_CUT).
The cheapest sum of padding and cut penalties is found over all cuts: a window that is padded
to its full length comes from the least key in the reach of a monotone queue, and windows
whose length is a power of two need no padding.

Defined cases: null text is empty, and an empty document is its end mark alone. Repeated rows
are packed each. An empty table gives no rows; other columns are ignored. Sequence numbers
differ between partitions and blocks, and are the same when a task is repeated.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.blocks import numbered
from lendscope.llm.bpe_words import text_ids
from lendscope.llm.shared import TOKENIZER, encoder

WINDOW = 1024
#: Penalties of cuts inside a document, in tokens of padding.
SENTENCE_CUT, TOKEN_CUT = 1, 16
#: Shortest unpadded window below the full length, but for a block's last part.
SHORTEST = 128
#: Bytes of text in a block.
STREAM_BYTES = 4_000_000
END_ID = 0

#: tokens: the piece's ids, little-endian, four bytes each.
SCHEMA = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"


def sentence_ends(tool) -> np.ndarray:
    """For each id, whether its piece ends a sentence."""
    ends = np.zeros(tool.n_vocab, bool)
    for i in range(tool.n_vocab):
        try:
            piece = tool.decode_single_token_bytes(i)
        except KeyError:
            continue
        ends[i] = piece.rstrip(b"\"')")[-1:] in (b".", b"!", b"?", b"\n", b";")
    return ends


def candidates(total: int, doc_ends: np.ndarray, sentence: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted places where a window may end (0 first, total last), their penalties, and which
    of them belong to the last part."""
    whole = total // window * window
    grid = np.arange(0, whole + 1, window)
    rest, at, tail = total - whole, whole, [whole]
    for power in range(window.bit_length() - 1, -1, -1):
        if rest >> power & 1:
            at += 1 << power
            tail.append(at)
    places = np.unique(np.concatenate((grid, tail, sentence, doc_ends, [0, total]))).astype(np.int64)
    penalty = np.full(len(places), TOKEN_CUT, np.int64)
    penalty[np.isin(places, sentence)] = SENTENCE_CUT
    penalty[np.isin(places, doc_ends) | (places == 0) | (places == total)] = 0
    return places, penalty, np.isin(places, tail)


def cut(places: np.ndarray, penalty: np.ndarray, tail: np.ndarray, window: int, shortest: int = SHORTEST) -> list[int]:
    """Ends of the windows that cost least, from the cheapest way to each place."""
    n = len(places)
    exact: list[list[int]] = [[] for _ in range(n)]
    power = 1
    while power < window:
        before = np.searchsorted(places, places - power)
        fits = (places >= power) & (places[np.minimum(before, n - 1)] == places - power)
        if power < shortest:
            fits &= tail & tail[np.minimum(before, n - 1)]
        for j in np.flatnonzero(fits).tolist():
            exact[j].append(int(before[j]))
        power *= 2
    at, fee = places.tolist(), penalty.tolist()
    cost, came = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + place, place, index), keys rising
    for j in range(1, n):
        here = at[j]
        while here - queue[0][1] > window:
            queue.popleft()
        key, _, best = queue[0]
        least = key + window - here
        for i in exact[j]:
            if cost[i] < least:
                least, best = cost[i], i
        least += fee[j]
        cost[j], came[j] = least, best
        key = least + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    ends, j = [], n - 1
    while j > 0:
        ends.append(at[j])
        j = came[j]
    return ends[::-1]


def pack_block(doc_ids: list, ids: list[np.ndarray], is_end: np.ndarray, window: int, first_sequence: int) -> dict[str, list]:
    """Pieces of one block, in the order of the stream."""
    sizes = np.array([len(x) for x in ids], np.int64)
    stream = np.concatenate(ids).astype("<u4")
    ends = np.cumsum(sizes)
    sentence = np.flatnonzero(is_end[stream]) + 1
    stops = np.array(cut(*candidates(len(stream), ends, sentence, window), window), np.int64)
    edges = np.unique(np.concatenate((ends, stops)))
    begins = np.concatenate(([0], edges[:-1]))
    doc = np.searchsorted(ends, begins, side="right")
    sequence = np.searchsorted(stops, begins, side="right")
    starts = np.concatenate(([0], stops[:-1]))
    raw, four = stream.tobytes(), 4
    return {
        "doc_id": [doc_ids[d] for d in doc.tolist()],
        "start": (begins - (ends - sizes)[doc]).tolist(),
        "length": (edges - begins).tolist(),
        "tokens": [raw[four * a : four * b] for a, b in zip(begins.tolist(), edges.tolist(), strict=True)],
        "doc_tokens": sizes[doc].tolist(),
        "sequence_id": (first_sequence + sequence).tolist(),
        "offset": (begins - starts[sequence]).tolist(),
    }


def pack_documents(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a piece (SCHEMA) of each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def pack(batches):
        import pyarrow as pa

        is_end = sentence_ends(encoder(tokenizer))
        is_end[END_ID] = False
        used = 0
        for number, table in numbered(batches, most=STREAM_BYTES):
            flat, sizes = text_ids(table["text"], tokenizer)
            ids = [np.append(own, np.uint32(END_ID)) for own in np.split(flat, np.cumsum(sizes)[:-1])]
            first = (number >> 32 << 33) + used
            found = pack_block(table["doc_id"].to_pylist(), ids, is_end, window, first)
            used = found["sequence_id"][-1] - (number >> 32 << 33) + 1
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "tokens" else pa.int64()) for k, v in found.items()})

    return rows.mapInArrow(pack, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their tokens."""
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
