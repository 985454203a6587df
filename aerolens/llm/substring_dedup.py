"""Substring dedup: long passages found through difference-cover anchors.

Let D be a difference cover modulo v: for any two places i and j some shift
d < v puts both i + d and j + d at places of D modulo v. Two equal windows of n
words therefore share an anchor, the n - v + 1 words after such places, aligned
in both documents. Only places of D are hashed (6 of 31), and a window is looked
at further only where one of its anchors occurs in another document: there it is
extended, that is the full windows around the anchor are hashed with 128 bits and
matched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, staged

_WORD = re.compile(WORD)
#: 2^64-invertible bases of the rolling hashes, 3 modulo 8.
_BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: A perfect difference set: each difference modulo 31 occurs once.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _WordHashes()
#: So many hashes a worker remembers; workers live on from job to job, so what they hold counts beside other operators' memory.
MAX_WORDS = 200_000


def word_hashes(text: str | None) -> tuple[list[str], np.ndarray]:
    """The words of a whole text and their 64-bit hashes."""
    words = _WORD.findall(text) if text else []
    if len(_HASHES) > MAX_WORDS:
        _HASHES.clear()
    return words, np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2^64 for i up to n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(1 << 15, 1 << int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            up, down = np.full(size, base, dtype=np.uint64), np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[base]


def rolling(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """The polynomial hash of each n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(base, len(hashes))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
        out = (sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1]
        return out ^ (out >> np.uint64(29))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """A second hash of the words, for the upper half of a window's 128 bits."""
    with np.errstate(over="ignore"):
        z = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _anchors(hashes: np.ndarray, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the cover and the anchors that start there; none in texts without a window."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    values = rolling(hashes, window - period + 1, _BASES[0])
    residues = np.zeros(period, dtype=bool)
    residues[list(cover)] = True
    places = np.flatnonzero(residues[np.arange(len(values)) % period])
    return places, values[places]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")


def whole_copies(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash of texts that equal one of a smaller doc_id, by 128 bits of hash."""
    heads = _keyed(docs).select("doc_id", "row_hash", F.xxhash64(F.lit(3), "text").alias("second"))
    firsts = heads.groupBy("row_hash", "second").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc < last_doc")
    return heads.join(firsts, ["row_hash", "second"]).filter("doc_id > first_doc").select("doc_id", "row_hash").distinct()


def repeated_windows(docs: DataFrame, copies: DataFrame, *, window: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, row_hash, places: starts of windows that also start in a smaller doc_id.

    Whole copies need no search: their windows start in the text that they copy.
    row_hash is xxhash64 of the text, so that repeated rows of a doc_id with
    different texts stay apart.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(_anchors(word_hashes(t)[1], window, period, cover)[1]) for t in batch.column("text").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(_signed(np.concatenate(found)) if found else [], pa.int64()), "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64()))})

    texts = _keyed(docs)
    known = texts.join(copies, ["doc_id", "row_hash"], "left_anti")
    work, found_anchors = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    every = found_anchors.staged(known.select("doc_id", "text").mapInArrow(anchors, "anchor long, doc_id long"), "anchors")
    shared = every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    by_doc = work.staged(every.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "shared")
    found_anchors.clear()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs, starts_, counts, firsts = [], [], [], [], []
            total = 0
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("anchors"), strict=True):
                _, hashes = word_hashes(text)
                places, values = _anchors(hashes, window, period, cover)
                places = places[np.isin(_signed(values), wanted.values.to_numpy())]
                # a window may start up to period - 1 words before its anchor
                n = max(len(hashes) - window + 1, 0)
                edge = np.zeros(n + 1, dtype=np.int32)
                np.add.at(edge, np.maximum(places - period + 1, 0), 1)
                np.add.at(edge, np.minimum(places + 1, n), -1)
                starts = np.flatnonzero(np.cumsum(edge[:n]) > 0)
                low, high = rolling(hashes, window, _BASES[0])[starts], rolling(_mixed(hashes), window, _BASES[1])[starts]
                order = np.lexsort((starts, high, low))
                low, high, starts = low[order], high[order], starts[order]
                first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else np.zeros(0, dtype=np.int64)
                lows.append(low[first])
                highs.append(high[first])
                starts_.append(starts)
                firsts.append(first + total)
                counts.append(len(first))
                total += len(starts)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())
            offsets = pa.array(np.concatenate([*firsts, [total]]).astype(np.int32))
            places = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(starts_).astype(np.int32) if starts_ else [], pa.int32()))
            low, high = (pa.array(_signed(np.concatenate(x)) if x else [], pa.int64()) for x in (lows, highs))
            yield pa.RecordBatch.from_pydict({"low": low, "high": high, "doc_id": batch.column("doc_id").take(rows), "row_hash": batch.column("row_hash").take(rows), "places": places})

    found = known.join(by_doc, "doc_id").mapInArrow(extend, "low long, high long, doc_id long, row_hash long, places array<int>")
    windows = work.staged(found, "windows")
    firsts = windows.groupBy("low", "high").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc < last_doc").select("low", "high", "first_doc")
    later = windows.join(firsts, ["low", "high"]).filter("doc_id > first_doc")
    places = staged(later.groupBy("doc_id", "row_hash").agg(F.flatten(F.collect_list("places")).alias("places")), "places")
    work.clear()
    return places


def substring_dedup(docs: DataFrame, *, window: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """Whole texts without words covered by a window that starts in a smaller doc_id too.

    Windows are judged on the input: what is cut from one document still counts
    as a source for others. Returns doc_id, n_words, n_removed, kept_text (kept
    words joined by one space) and the carried columns for every row.

    A null text has no words. A text shorter than a window keeps all words.
    Repeats inside one document, or in rows of one doc_id, are not removed. A row
    without doc_id is no document: it keeps all its words and is no source.
    """
    copies = staged(whole_copies(docs), "copies")
    places = repeated_windows(docs, copies, window=window)
    verdicts = places.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text", *(F.col(c).alias(f"carry_{c}") for c in carry))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, starts, copy in zip(batch.pop("text"), batch.pop("places"), batch.pop("copy"), strict=True):
                words = _WORD.findall(text) if text else []
                total.append(len(words))
                if copy and len(words) >= window:
                    removed.append(len(words))
                    kept.append("")
                    continue
                if starts is None:
                    removed.append(0)
                    kept.append(" ".join(words))
                    continue
                edge = np.zeros(len(words) + 1, dtype=np.int32)
                at = np.asarray(starts, dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                stay = (np.cumsum(edge[:-1]) == 0).tolist()
                removed.append(len(words) - sum(stay))
                kept.append(" ".join([w for w, s in zip(words, stay, strict=True) if s]))
            batch["n_words"], batch["n_removed"], batch["kept_text"] = total, removed, kept
            yield batch.drop(columns="row_hash")

    fields = [f for f in rows.schema if f.name not in ("text", "row_hash")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_words long, n_removed long, kept_text string"
    out = rows.join(verdicts, ["doc_id", "row_hash"], "left").select(*(f.name for f in fields), "row_hash", "text", "places", F.coalesce("copy", F.lit(False)).alias("copy")).mapInPandas(cut, schema)
    return out.select("doc_id", "n_words", "n_removed", "kept_text", *(F.col(f"carry_{c}").alias(c) for c in carry))
