"""Chunks of rows with texts, and tables of 64-bit keys that travel between chunks and buckets.

A chunk holds whole rows, of at most a number of bytes of text or one row. What an
operator has to look up for a chunk's texts are its distinct keys: each goes to its
bucket once, and the answers come back to the chunk. No task holds a model.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard

from pathspring.llm._words import SLICE, U64, slices, text_bytes

CHUNK = 4 << 20


def chunked(text_col: str, ids: str | None = None, limit: int = CHUNK, level: int = 1, far: bool = False):
    """For mapInArrow: chunk (a random number), packed (the rows) and, if asked for, ids (that column's values). Far: repeats are looked for in the whole chunk."""

    def run(batches):
        whole = {"compression_params": zstandard.ZstdCompressionParameters.from_level(level, enable_ldm=True, window_log=24)}
        pack = zstandard.ZstdCompressor(**(whole if far else {"level": level}))

        def out(held):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as stream:
                for part in held:
                    stream.write_batch(part)
            row = {"chunk": pa.array([uuid.uuid4().int >> 65], pa.int64()), "packed": pa.array([pack.compress(sink.getvalue())], pa.binary())}
            if ids:
                row["ids"] = pa.array([[i for part in held for i in part.column(ids).to_pylist()]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_pydict(row)

        held, size = [], 0
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                n = int(text_bytes(part.column(text_col))[1][-1])
                if held and size + n > limit:
                    yield out(held)
                    held, size = [], 0
                held.append(part)
                size += n
        if held:
            yield out(held)

    return run


def rows_of(packed: bytes) -> list[pa.RecordBatch]:
    return [*pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed))]


def planes(x: np.ndarray) -> bytes:
    """Bytes of whole numbers, all lowest bytes first: the upper ones pack to almost nothing."""
    return np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(data, kind, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys in rising order, by their steps."""
    return planes(np.diff(keys, prepend=U64(0)))


def unpack_keys(data, n: int) -> np.ndarray:
    return np.cumsum(from_planes(data, U64, n), dtype=U64)


def pack_some(values: np.ndarray) -> bytes:
    """Floats of which many are NaN: how many, which of them are numbers, and those."""
    known = ~np.isnan(values)
    return np.array([len(values)], "<u4").tobytes() + np.packbits(known).tobytes() + planes(values[known])


def unpack_some(data, kind, at: int = 0) -> tuple[np.ndarray, int]:
    """The floats that pack_some packed at that place, and where they end."""
    n = int(np.frombuffer(data, "<u4", 1, at)[0])
    known = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at + 4), count=n).astype(bool)
    values, at = np.full(n, np.nan, dtype=kind), at + 4 + (n + 7) // 8
    values[known] = from_planes(data, kind, int(known.sum()), at)
    return values, at + int(known.sum()) * values.itemsize


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key; it grows with the key."""
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def in_order(batches, columns):
    """Rows of all batches, as tuples."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def bits(batches):
    """For mapInArrow: chunk and target, a bit for each of a chunk's rows up to the last one that is in places."""
    for name, places in in_order(batches, ("chunk", "places")):
        marks = np.zeros(max(places) + 1, dtype=np.uint8)
        marks[places] = 1
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([name], pa.int64()), "target": [np.packbits(marks).tobytes()]})
