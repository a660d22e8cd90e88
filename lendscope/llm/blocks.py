"""Blocks of neighbouring documents, and exchanges of what blocks ask of a keyed table.

Work on single words would shuffle one row a word. Here a task gathers the documents of its
partition into blocks of bounded size; a block asks for each of its distinct keys once, in a
few packed arrays dealt by key, and answers come back in the order of the questions. So what
moves is proportional to the distinct keys of blocks, and a key that fills a third of the
corpus moves once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from lendscope.llm.shared import expand, give_back, squeeze

#: Bytes of text after which a block ends; a longer document is a block of its own.
BLOCK_BYTES = 12_000_000
#: Rows after which it ends, however short they are.
BLOCK_ROWS = 50_000

BLOCK_SCHEMA = "block long, payload binary"


def _pieces(batch, column: str, most: int, rows: int):
    """Slices of a record batch, each with at most that many bytes of text and rows, or one row."""
    from lendscope.llm.shared import text_bytes

    _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(off, off[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, stop - start), int(off[stop] - off[start])
        start = stop


def gathered(batches: Iterator, column: str = "text", most: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator:
    """Arrow tables of neighbouring rows, each of bounded bytes of text and rows."""
    import pyarrow as pa

    waiting, size, held = [], 0, 0
    for batch in batches:
        for piece, n in _pieces(batch, column, most, rows):
            if waiting and (size + n > most or held + piece.num_rows > rows):
                yield pa.Table.from_batches(waiting)
                waiting, size, held = [], 0, 0
            waiting.append(piece)
            size += n
            held += piece.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting)
    del waiting
    give_back()


def numbered(batches: Iterator, column: str = "text", most: int = BLOCK_BYTES) -> Iterator:
    """(block number, table); numbers differ between partitions and recur when a task is repeated."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    for i, table in enumerate(gathered(batches, column, most)):
        yield first + i, table


def to_bytes(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return squeeze(sink.getvalue().to_pybytes())


def from_bytes(data: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(expand(data)).read_all()


def blocks(docs: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """One row a block: its number and its packed rows."""

    def pack(batches):
        import pyarrow as pa

        for number, table in numbered(batches, most=most):
            yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "payload": pa.array([to_bytes(table)], pa.binary())})

    return docs.mapInArrow(pack, BLOCK_SCHEMA)


def planes(values: np.ndarray) -> bytes:
    """Packed numbers; equal bytes of neighbours stand together, so small numbers shrink."""
    kind = values.dtype
    wide = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), kind.itemsize)
    return squeeze(np.ascontiguousarray(wide.T).tobytes())


def unplanes(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    flat = np.frombuffer(expand(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(flat.T).reshape(-1).view(kind)


def rising(values: np.ndarray) -> bytes:
    """planes() of the steps between sorted 64-bit numbers."""
    return planes(np.diff(values, prepend=np.uint64(0)).astype(np.uint64))


def unrising(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def counts_in(values: np.ndarray) -> bytes:
    """planes() of whole numbers in the narrowest of 32 and 64 bits; the first byte tells which."""
    small = len(values) == 0 or int(values.max()) < 2**32
    return (b"4" if small else b"8") + planes(values.astype(np.uint32 if small else np.uint64))


def counts_out(data: bytes) -> np.ndarray:
    return unplanes(data[1:], np.uint32 if data[:1] == b"4" else np.uint64).astype(np.int64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of each 64-bit key; rises with the key."""
    return ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
