"""Words of many texts at once, cut in the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text each, a longer text alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_buffer(texts: pa.Array, table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, edges): text i is bytes[edges[i] : edges[i + 1]], each byte replaced by the table; null is empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, values = texts.buffers()
    edges = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int32)
    data = memoryview(values)[edges[0] : edges[-1]] if values is not None else b""
    return np.frombuffer(bytes(data).translate(table) if table else data, dtype=np.uint8), (edges - edges[0]).astype(np.int64)


def byte_table(lower: bool, **kinds: bytes) -> bytes:
    """A table for text_buffer: A-Z lower-cased, the bytes of `space` to a space, those of `end` to a line end."""
    table = bytearray(range(256))
    if lower:
        table[65:91] = bytes(range(97, 123))
    for name, to in (("space", 32), ("end", 10)):
        for b in kinds.get(name, b""):
            table[b] = to
    return bytes(table)


def cut_words(data: np.ndarray, edges: np.ndarray, breaks: tuple[int, ...]) -> tuple[pa.Array, np.ndarray]:
    """(words, places): the maximal runs of bytes other than breaks, no run over two texts, and where each begins."""
    if not len(data):
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    inside = data != breaks[0]
    for b in breaks[1:]:
        inside &= data != b
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = edges[:-1][edges[:-1] < len(data)]
    begins[heads] = inside[heads]
    places = np.flatnonzero(begins)
    packed = data[inside]
    offsets = np.empty(len(places) + 1, dtype=np.int32)
    offsets[:-1] = np.cumsum(inside, dtype=np.int32)[places] - 1
    offsets[-1] = len(packed)
    return pa.Array.from_buffers(pa.string(), len(places), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed)]), places
