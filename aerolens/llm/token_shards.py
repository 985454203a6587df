"""Token-ID output: one wavelet matrix per shard of documents.

A shard holds the ids of consecutive documents (ascending doc_id) as succinct
bit-planes. Plane b holds bit b of all ids in the order that the higher planes
sorted them, zeros first. The ones before every chunk of a plane stand in the
shard's directory, those before every 512th bit in the chunk; rank reads one
chunk, select searches the counts. Together they answer which id stands at a
place, how often an id occurs in a range, and where. Chunks are compressed one by
one, so an answer decompresses one or two chunks a plane and not the shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .tokens import encoded

MAGIC = b"WMX2"
#: Bits to a count inside a chunk, and bits of a chunk.
BLOCK, CHUNK = 512, 1 << 15
#: Text encoded at once and words remembered by a worker: fewer words are looked up and encoded twice than in packing,
#: whose workers share their memory with the pipeline's other stages.
CHARS, WORDS = 12_000_000, 2_000_000


def wavelet_planes(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """The packed planes, highest bit first."""
    planes, seq = [], ids
    for b in range(bits - 1, -1, -1):
        plane = np.packbits((seq & seq.dtype.type(1 << b)).astype(bool), bitorder="little")
        planes.append(plane)
        if b:  # Arrow filters by the packed bits
            values = pa.array(seq)
            zero, one = (values.filter(pa.Array.from_buffers(pa.bool_(), len(seq), [None, pa.py_buffer(p)])) for p in (~plane, plane))
            seq = np.concatenate([zero.to_numpy(), one.to_numpy()])
    return planes


class WaveletMatrix:
    """Rank, select and access over compressed planes; chunks are read when they are needed.

    ranks: ones before each chunk of each plane and in all (planes x chunks + 1).
    places: where each chunk starts in data (planes * chunks + 1).
    """

    def __init__(self, n: int, ranks: np.ndarray, places: np.ndarray, data: bytes, held: int = 64) -> None:
        self.n, self.bits, self.ranks, self.places, self.data = n, len(ranks), ranks, places, data
        self.zeros = n - ranks[:, -1].astype(np.int64)
        self.chunks = ranks.shape[1] - 1
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.most_held, self.reads = held, 0

    @staticmethod
    def pack(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(ranks, places, data) of a sequence of ids."""
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        chunks = -(-len(ids) // CHUNK)
        ranks, out = np.zeros((bits, chunks + 1), dtype="<u4"), []
        for level, plane in enumerate(wavelet_planes(ids, bits)):
            padded = np.zeros(chunks * (CHUNK // 8), dtype=np.uint8)
            padded[: len(plane)] = plane
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(chunks, CHUNK // BLOCK, BLOCK // 64).sum(axis=2, dtype=np.int64)
            ranks[level, 1:] = np.cumsum(ones.sum(axis=1))
            counts = (np.cumsum(ones, axis=1) - ones).astype("<u2")
            out += [squeeze(c.tobytes() + p.tobytes()) for c, p in zip(counts, padded.reshape(chunks, -1), strict=True)]
        return ranks, np.concatenate([[0], np.cumsum([len(c) for c in out])]).astype("<u4"), b"".join(out)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        return cls(len(ids), *cls.pack(ids, bits))

    def _chunk(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ones before each block, packed bits) of a chunk."""
        import zstandard

        key = level * self.chunks + k
        if key not in self.held:
            if len(self.held) >= self.most_held:
                self.held.pop(next(iter(self.held)))
            self.reads += 1
            raw = zstandard.ZstdDecompressor().decompress(self.data[self.places[key] : self.places[key + 1]])
            head = 2 * CHUNK // BLOCK
            self.held[key] = np.frombuffer(raw[:head], dtype="<u2"), np.frombuffer(raw[head:], dtype=np.uint8)
        return self.held[key]

    def _bit_rank(self, level: int, i: int) -> tuple[int, int]:
        """The bit at place i (0 at the end) and the ones before it."""
        k, rest = divmod(i, CHUNK)
        if k == self.chunks:
            return 0, int(self.ranks[level, k])
        counts, plane = self._chunk(level, k)
        block = rest // BLOCK
        part = np.unpackbits(plane[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        at = rest - block * BLOCK
        return int(part[at]), int(self.ranks[level, k]) + int(counts[block]) + int(part[:at].sum())

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit_rank(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of value in [lo, hi) stand after the last plane."""
        if value >> self.bits:
            return 0, 0
        for level in range(self.bits):
            if lo >= hi:
                break
            a, b = self._bit_rank(level, lo)[1], self._bit_rank(level, hi)[1]
            zeros = int(self.zeros[level])
            lo, hi = (zeros + a, zeros + b) if value >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, max(lo, hi)

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of value in [lo, hi)."""
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit in a plane."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * CHUNK - ones
        chunk = int(np.searchsorted(before[:-1], k, side="right")) - 1
        k -= int(before[chunk])
        counts, plane = self._chunk(level, chunk)
        inside = counts.astype(np.int64) if bit else np.arange(len(counts)) * BLOCK - counts
        block = int(np.searchsorted(inside, k, side="right")) - 1
        part = np.unpackbits(plane[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return chunk * CHUNK + block * BLOCK + int(np.flatnonzero(part == bit)[k - int(inside[block])])

    def occurrence(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of value; -1 if there are fewer."""
        lo, hi = self._range(value, 0, self.n)
        if k >= hi - lo:
            return -1
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def all_ids(self) -> np.ndarray:
        """Every id in order, from the last plane up."""
        seq = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for b, level in enumerate(range(self.bits - 1, -1, -1)):
            plane = np.concatenate([self._chunk(level, k)[1] for k in range(self.chunks)]) if self.chunks else np.zeros(0, dtype=np.uint8)
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            zeros = int(self.zeros[level])
            up = np.empty_like(seq)
            up[np.flatnonzero(~ones)] = seq[:zeros]
            up[np.flatnonzero(ones)] = seq[zeros:] | seq.dtype.type(1 << b)
            seq = up
        return seq


class TokenShard:
    """The documents and the wavelet matrix of one blob."""

    def __init__(self, doc_ids: np.ndarray, known: np.ndarray, ends: np.ndarray, matrix: WaveletMatrix) -> None:
        self.doc_ids, self.known, self.ends, self.matrix = doc_ids, known, ends, matrix

    @staticmethod
    def pack(doc_ids: list, lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
        import zstandard

        known = np.array([d is not None for d in doc_ids], dtype=bool)
        numbers = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
        ranks, places, data = WaveletMatrix.pack(ids, bits)
        head = zstandard.ZstdCompressor(level=1).compress(b"".join([numbers.tobytes(), np.packbits(known).tobytes(), np.array(lengths, dtype="<u4").tobytes(), ranks.tobytes(), places.tobytes()]))
        return b"".join([MAGIC, struct.pack("<IQII", len(doc_ids), len(ids), bits, len(head)), head, data])

    @classmethod
    def unpack(cls, blob: bytes) -> TokenShard:
        """The shard with its directory read; planes stay compressed."""
        import zstandard

        if blob[:4] != MAGIC:
            raise ValueError("not a token shard")
        n_docs, n_ids, bits, size = struct.unpack_from("<IQII", blob, 4)
        at = 4 + struct.calcsize("<IQII")
        raw = zstandard.ZstdDecompressor().decompress(blob[at : at + size])
        chunks = -(-n_ids // CHUNK)
        parts, start = [], 0
        for length in (8 * n_docs, -(-n_docs // 8), 4 * n_docs, 4 * bits * (chunks + 1), 4 * (bits * chunks + 1)):
            parts.append(raw[start : start + length])
            start += length
        known = np.unpackbits(np.frombuffer(parts[1], dtype=np.uint8), count=n_docs).astype(bool)
        ends = np.cumsum(np.frombuffer(parts[2], dtype="<u4"), dtype=np.int64)
        matrix = WaveletMatrix(n_ids, np.frombuffer(parts[3], dtype="<u4").reshape(bits, chunks + 1), np.frombuffer(parts[4], dtype="<u4"), blob[at + size :])
        return cls(np.frombuffer(parts[0], dtype="<i8"), known, ends, matrix)


def id_bits(tokenizer: str, end_id: int) -> int:
    """Bits that hold every id of a tokenizer file and the end id."""
    from tokenizers import Tokenizer

    return max(1, max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()).bit_length())


def write_token_shards(docs: DataFrame, tokenizer: str, *, end_id: int = 2, bits: int | None = None, shard_ids: int = 500_000) -> DataFrame:
    """Encode all texts and write them as wavelet matrices in ascending doc_id order.

    Returns the written shard table: part, block (in order), n_docs, n_ids,
    start (ids in all shards before) and blob. Documents are dealt by ranges of
    doc_id; a task writes one blob for every shard_ids ids or so, a longer
    document stays whole. bits are those of the largest id of the tokenizer (or
    end_id) if not given; an id that does not fit is an error. Null texts are empty;
    null doc_ids come last; equal doc_ids are ordered by text.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, n = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        lengths: list[int] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            if len(ids) and int(ids.max()) >> bits:
                raise ValueError(f"id {ids.max()} does not fit {bits} bits")
            ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
            blob = TokenShard.pack(doc_ids, lengths, ids, bits)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "blob": pa.array([blob], pa.binary())})

        for batch in batches:
            known = batch.column("doc_id").to_pylist()
            for row, data in encoded(tokenizer, batch.column("text"), end_id, CHARS, WORDS):
                doc_ids.append(known[row])
                lengths.append(len(data) // 4)
                held.append(data)
                n += len(data) // 4
                if n >= shard_ids:
                    yield flush()
                    block, n, doc_ids, lengths, held = block + 1, 0, [], [], []
        if doc_ids:
            yield flush()

    bits = bits or id_bits(tokenizer, end_id)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(order[0]).sortWithinPartitions(*order)
    shards = staged(ranged.mapInArrow(pack, "part int, block int, n_docs long, n_ids long, blob binary"), "shards")
    # one row a part is summed over all, the rest inside its part
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("_base"))
    sums = shards.select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("_inside")).join(parts, "part")
    return shards.join(sums.select("part", "block", (F.col("_base") + F.col("_inside")).alias("start")), ["part", "block"])


def read_token_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blobs alone.

    start counts the ids of all documents before it; the crc is over the ids as
    little-endian unsigned 32-bit integers.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, block, blob in zip(batch["part"], batch["block"], batch["blob"], strict=True):
                shard = TokenShard.unpack(blob)
                data = shard.matrix.all_ids().astype("<u4").tobytes()
                starts = np.concatenate([[0], shard.ends[:-1]])
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), shard.ends.tolist(), strict=True)]
                doc_ids = pd.array(shard.doc_ids, dtype="Int64")
                doc_ids[~shard.known] = pd.NA
                yield pd.DataFrame({"part": part, "block": block, "doc_id": doc_ids, "at": starts, "n_tokens": shard.ends - starts, "ids_crc32": crcs})

    places = shards.select("part", "block", "start")
    rows = shards.select("part", "block", "blob").mapInPandas(unpack, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(places, ["part", "block"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """token, n and the place of the first occurrence (ids before it) in each shard that holds the token; a few chunks a plane are read."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for start, blob in zip(batch["start"], batch["blob"], strict=True):
                matrix = TokenShard.unpack(blob).matrix
                if n := matrix.count(token):
                    out.append((token, n, int(start) + matrix.occurrence(token, 0)))
            yield pd.DataFrame(out, columns=["token", "n", "first"])

    return shards.select("start", "blob").mapInPandas(look, "token long, n long, first long")
