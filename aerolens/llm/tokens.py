"""Token ids of whole texts, fast: a batch is cut into words by Arrow, and the worker remembers the ids of words."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

_ENCODERS: dict[tuple[str, int], Encoder] = {}
#: Words that a worker remembers; an entry takes some 30 bytes.
MAX_WORDS = 500_000
#: Words whose ids depend on their surroundings: white space at an edge, or the start of a special token.
_ODD = r"^[\s\v\x1c-\x1f\x85\pZ]|[\s\v\x1c-\x1f\x85\pZ]$|<\|"
#: A mark after letters is a piece of its own.
_MARKED = r"^(\pL+)[,.]$"


def _binaries(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ids between consecutive starts."""
    edges = (4 * np.append(starts, len(ids))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(ids.tobytes())])


class _Words:
    """Ids of the words seen so far, each encoded with the same character before it."""

    def __init__(self, encoder: Encoder, before: str) -> None:
        self.encoder, self.before = encoder, before
        self.clear()

    def clear(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def _encode(self, words: list[str]) -> pa.Array:
        """The ids of plain words, encoded together and cut apart again."""
        if self.before:
            ids = self.encoder.ids_of(self.before + self.before.join(words))
            starts = np.flatnonzero(self.encoder.leads[ids])
        else:
            ids = self.encoder.ids_of("\n".join(words))
            marks = ids == self.encoder.newline
            cuts = np.flatnonzero(marks)
            starts = np.concatenate([[0], cuts + 1 - np.arange(1, len(cuts) + 1)])
            ids = ids[~marks]
        if len(starts) != len(words):
            raise ValueError("words do not stand alone in this tokenizer")
        return _binaries(ids, starts)

    def look_up(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words; null for those that do not stand alone."""
        if len(self.words) > self.encoder.max_words:
            self.clear()
        at = pc.index_in(words, value_set=self.words).to_numpy(zero_copy_only=False)
        missing = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), dtype=bool)
        at = np.where(missing, 0, at).astype(np.int32)
        if missing.any():
            fresh = words.filter(pa.array(missing))
            plain = pc.and_(pc.greater(pc.binary_length(fresh), 0), pc.invert(pc.match_substring_regex(fresh, _ODD))).to_numpy(zero_copy_only=False)
            fresh = fresh.filter(pa.array(plain))
            found = [self._encode(fresh.slice(i, 4096).to_pylist()) for i in range(0, len(fresh), 4096)]
            places = np.flatnonzero(missing)[plain]
            at[places] = len(self.words) + np.arange(len(fresh))
            missing[places] = False
            self.words, self.ids = pa.concat_arrays([self.words, fresh]), pa.concat_arrays([self.ids, *found])
        return self.ids.take(pa.array(at, mask=missing))


class Encoder:
    """Ids of a byte-level BPE tokenizer file.

    Such a tokenizer cuts a text into pieces before it merges bytes, and a
    single space belongs to the word after it. So a text without runs of white
    space is the sequence of its lines and of their space-led words, each with
    ids of its own; any other text goes to the tokenizer whole, and so do all
    texts where the file describes another kind of tokenizer. Unknown words are
    encoded many at a time in one call and cut apart again where a token begins
    with a space. max_words bounds memory.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        cut = described.get("pre_tokenizer") or {}
        self.by_words = described.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True)
        if not self.by_words:
            return
        vocabulary = self.tokenizer.get_vocab()
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        self.leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.leads[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
        self.newline = int(self.ids_of("\n")[0])
        self.later, self.first = _Words(self, " "), _Words(self, "")
        self.marks = pa.array([b"", *(self.ids_of(m).tobytes() for m in ",.")], pa.binary())

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _table(self, words: pa.Array, known: _Words) -> pa.Array:
        """The ids of words, a mark at their end apart."""
        stems = pc.replace_substring_regex(words, _MARKED, r"\1").dictionary_encode()
        ids = known.look_up(stems.dictionary).take(stems.indices)
        cut = pc.not_equal(pc.binary_length(words), pc.binary_length(stems.dictionary).take(stems.indices))
        mark = pc.if_else(cut, pc.if_else(pc.ends_with(words, ","), 1, 2), 0)
        return pc.binary_join_element_wise(ids, self.marks.take(mark), b"")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i] : offsets[i + 1]]; null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_words or not len(texts):
            return _joined([self.ids_of(t) for t in texts.to_pylist()])
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        flat = lists.flatten().dictionary_encode()
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        code, words = flat.indices.to_numpy().copy(), flat.dictionary
        newline = pc.index(words, "\n").as_py()
        heads = np.zeros(len(code), dtype=bool)
        heads[edges[:-1]] = True
        heads[1:] |= code[:-1] == newline
        # a word's ids depend on whether it starts a line
        leading = np.flatnonzero(np.bincount(code[heads], minlength=len(words)))
        where = np.zeros(len(words), dtype=np.int32)
        where[leading] = len(words) + np.arange(len(leading))
        code[heads] = where[code[heads]]
        table = pa.concat_arrays([self._table(words, self.later), self._table(words.take(pa.array(leading)), self.first)])
        if newline >= 0:
            # the two entries of the line end itself
            breaks = np.zeros(len(table), dtype=bool)
            breaks[[newline, *([where[newline]] if where[newline] else [])]] = True
            table = pc.if_else(pa.array(breaks), pa.scalar(np.array([self.newline], dtype="<u4").tobytes(), pa.binary()), table)
        found = table.take(pa.array(code))
        ends = np.frombuffer(found.buffers()[1], dtype=np.int32)[: len(found) + 1]
        out, offsets = np.frombuffer(found.buffers()[2] or b"", dtype="<u4")[: ends[-1] // 4], (ends // 4)[edges]
        if not found.null_count:
            return out, offsets
        strange = np.add.reduceat(found.is_null().to_numpy(zero_copy_only=False), edges[:-1]) > 0
        # an empty text is one empty word and needs no tokenizer
        strange &= pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        return _joined([self.ids_of(texts[i].as_py()) if s else out[offsets[i] : offsets[i + 1]] for i, s in enumerate(strange.tolist())])


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4"), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


def encoder(path: str, max_words: int = MAX_WORDS) -> Encoder:
    """The encoder of this worker process."""
    if (path, max_words) not in _ENCODERS:
        _ENCODERS[path, max_words] = Encoder(path, max_words)
    return _ENCODERS[path, max_words]


def encoded(path: str, texts: pa.Array, end_id: int, chars: int = 3_000_000, max_words: int = MAX_WORDS) -> Iterator[tuple[int, bytes]]:
    """(row, ids with the end id as little-endian unsigned 32-bit bytes), worked on about so many bytes at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    end = np.array([end_id], dtype="<u4").tobytes()
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars, side="right")))
        ids, offsets = encoder(path, max_words).encode(texts.slice(at, to - at))
        data = ids.tobytes()
        for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
            yield at + i, data[4 * a : 4 * b] + end
        at = to
        del ids, data
        give_back()
