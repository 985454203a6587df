"""Token counts: byte-pair merging with a heap and a linked list, without identifiers.

A text is cut into pieces, a piece starts as one symbol a byte, and the adjacent
pair of lowest rank merges until none has a rank. The count of a piece is its
initial symbols minus its merges. Equal pieces of a batch are merged once, and a
worker remembers the counts of a bounded number of pieces.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices, text_buffer

#: The cut into pieces that byte-level BPE files of this kind are made for (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_COUNTERS: dict[str, Counter] = {}
#: Bytes that may begin or be white space; a cut before a space is safe only where none of them follows.
_WHITE = bytes([*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level file: itself, or the next from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Counter:
    """Token counts by the merges of a byte-level BPE file, .json (tokenizers) or .tiktoken (ranks).

    max_pieces bounds the counts that are remembered, give or take a batch;
    beyond it those not seen of late are forgotten and made anew.
    """

    def __init__(self, path: str, pattern: str = PATTERN, max_pieces: int = 600_000) -> None:
        import regex

        self.pattern, self.max_pieces = regex.compile(pattern), max_pieces
        #: Counts of the pieces seen of late, and of those seen before them.
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        special: list[str] = []
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            symbols = {t: ord(t) if len(t) == 1 else 256 + r for t, r in ranks.items()}
            made = [(t[:i], t[i:], t, r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        else:
            with open(path, encoding="utf-8") as f:
                described = json.load(f)
            cut, model = described.get("pre_tokenizer") or {}, described["model"]
            plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True)
            if model.get("type") != "BPE" or not plain or described.get("normalizer") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
                raise ValueError(f"{path} is no plain byte-level BPE file")
            vocabulary = model["vocab"]
            symbols = {c: b for b, c in enumerate(_byte_symbols())}
            if not symbols.keys() <= vocabulary.keys():
                raise ValueError(f"{path} lacks tokens of single bytes")
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            made = [(a, b, a + b, r) for r, (a, b) in enumerate(pairs)]
            for _, _, token, r in made:
                symbols.setdefault(token, 256 + r)
            if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in described["added_tokens"]):
                raise ValueError(f"{path} has added tokens that take in what surrounds them")
            special = sorted((t["content"] for t in described["added_tokens"]), key=len, reverse=True)
        #: Rank of the merge of two symbols, and the symbol that the merge of a rank makes. A byte is its own symbol.
        self.ranks = {symbols[a] << 32 | symbols[b]: r for a, b, _, r in made}
        self.made = {r: symbols[token] for _, _, token, r in made}
        #: Strings that the tokenizer takes out of a text first, each one token.
        self.special = tuple(special)
        self.cut_special = regex.compile("|".join(map(regex.escape, special))) if special else None
        follows = np.ones(256, dtype=bool)
        follows[list(_WHITE)] = False
        follows[[s.encode()[0] for s in special]] = False
        #: Bytes that a piece cut before a space or after a line end may go on with.
        self.follows = follows
        self.before = follows & (np.arange(256) < 128)
        self.letters = np.zeros(256, dtype=bool)
        self.letters[[*range(65, 91), *range(97, 123)]] = True
        self.marks = np.zeros(256, dtype=bool)
        self.marks[[b for b in b".,;:!?" if not any(b in s.encode() for s in special)]] = True

    def merged(self, symbols: list[int]) -> int:
        """How many symbols are left when no adjacent pair has a rank."""
        size = n = len(symbols)
        if n < 2:
            return n
        rank, made = self.ranks.get, self.made
        #: Rank of the pair that begins at a place, -1 for none; an entry of the heap that differs is out of date.
        current = [rank(a << 32 | b, -1) for a, b in pairwise(symbols)]
        current.append(-1)
        heap = [r << 32 | i for i, r in enumerate(current) if r >= 0]
        heapify(heap)
        right, left = list(range(1, size + 1)), list(range(-1, size - 1))
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if current[i] != r:
                continue
            n -= 1
            symbol = symbols[i] = made[r]
            gone, before = right[i], left[i]
            current[gone] = current[i] = -1
            after = right[i] = right[gone]
            if after < size:
                left[after] = i
                r = current[i] = rank(symbol << 32 | symbols[after], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            if before >= 0:
                r = current[before] = rank(symbols[before] << 32 | symbol, -1)
                if r >= 0:
                    heappush(heap, r << 32 | before)
        return n

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if any(s in text for s in self.special):
            parts = self.cut_special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        if (text[1:] if text[:1] == " " else text).isalpha():
            return self.merged(list(text.encode()))
        return sum([self.merged(list(piece.encode())) for piece in self.pattern.findall(text)])

    def _cuts(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Places at which the pattern cuts for certain.

        A space before a visible character belongs to it, letters end at a mark,
        and a line end between two visible characters stands alone. Anything less
        clear is left together.
        """
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[edges] = True
        following = self.follows[data[1:]]
        cut[:-2] |= (data[:-1] == 32) & following
        cut[1:-1] |= self.letters[data[:-1]] & self.marks[data[1:]]
        if len(data) > 2:
            lone = 1 + np.flatnonzero((data[1:-1] == 10) & self.before[data[:-2]] & following[1:])
            # not where a text begins or ends beside it
            lone = lone[~cut[lone] & ~cut[lone + 1]]
            cut[lone] = cut[lone + 1] = True
        return np.flatnonzero(cut)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null is empty."""
        data, edges = text_buffer(texts)
        out = np.zeros(len(texts), dtype=np.int64)
        if not len(data):
            return out
        cuts = self._cuts(data, edges)
        pieces = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data)]).dictionary_encode()
        each = []
        for piece in pieces.dictionary.to_pylist():
            n = self.known.get(piece)
            if n is None:
                n = self.older.get(piece)
                if n is None:
                    n = self.count(piece)
                if len(piece) <= 64:  # a long one hardly comes again
                    self.known[piece] = n
            each.append(n)
        if len(self.known) > self.max_pieces // 2:
            self.known, self.older = {}, self.known
        totals = np.concatenate([[0], np.cumsum(np.array(each, dtype=np.int64)[pieces.indices.to_numpy()])])
        at = np.searchsorted(cuts, edges)
        return totals[at[1:]] - totals[at[:-1]]


def counter(path: str) -> Counter:
    """The counter of this worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, *, limit: int = 512, carry: tuple[str, ...] = ()) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens pass the limit.

    path names a byte-level BPE file that lies on every machine. Special strings
    inside a text are one token each where the file lists them; none is added.

    Returns doc_id, n_bytes, n_tokens, over_limit and the carried columns for
    every row, repeated ones as often as they come. A null or empty text has no
    bytes and no tokens; a null doc_id stays null. No row moves between tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = pa.array(counter(path).counts(part.column("text")), pa.int64())
                at = part.schema.get_field_index("text")
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != at), n], names=[*(f for i, f in enumerate(part.schema.names) if i != at), "n_tokens"])
            pa.default_memory_pool().release_unused()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "text",
        *(F.col(c).alias(f"carry_{c}") for c in carry),
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", n_tokens long"
    out = rows.mapInArrow(count, schema)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *(F.col(f"carry_{c}").alias(c) for c in carry))
