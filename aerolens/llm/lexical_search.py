"""Ranked lexical search over bit-sliced Bloom signatures.

A block holds a few hundred documents of about the same length. Its signature is a
bit matrix: each term of a document, and each level of how often it occurs, sets
one bit of the document's column in a few rows chosen by hash. The rows of a query
term, combined by AND, are a bitmap of the documents that may hold the term; none
that holds it is missing. Summing the slices of a query's terms, each weighted by
what its level can add to a score, bounds every document's score from above.

A search takes the documents of the highest bounds first and scores them exactly.
The k-th best of these scores is reached by k documents at least, so a document
whose bound lies below it is excluded for certain. Of the others again those of the
highest bounds come first, many more than before and in proportion to the table, as
the larger it is the more of the highest bounds are chance; their k-th best score
excludes most of the rest. Each round reads the signatures again, so no list of what
only the first seeds leave is ever made. All that are not excluded in the end are
scored exactly from their whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, lower_ascii, staged
from .words import byte_table, cut_words, slices, text_buffer

#: A term is a run of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = byte_table(True, space=_BETWEEN)
#: A document has the levels that its number of occurrences reaches (any rising list from 1 gives right results).
LEVELS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 26, 34, 44, 56, 72, 96, 128, 192, 256, 512, 1024])
#: Rows a key sets, and keys a row holds of each document on average: a third of all bits is set, and a term seems to
#: be in one of a hundred documents without it.
ROWS_A_KEY, LOAD = 4, 0.38
KEYS_A_BLOCK = 2_000_000
#: The second seeds of an item are one of so many documents, if that is more than more_seeds * k. A task offers four
#: times its share of them, as the documents that an item resembles may stand together.
DOCS_A_SEED, OFFERED = 256, 4
#: So many (item, document) pairs go to all tasks; more are joined.
FEW_PAIRS = 1_000_000


def terms(text: Column) -> Column:
    """All terms of a text in order, A-Z lower-cased."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"({TERM})"), F.lit(1))


def _mix(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = values * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _term_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), dtype=np.uint64, count=len(words))


def _rows_of(hashes: np.ndarray, levels: np.ndarray, n_rows: int) -> np.ndarray:
    """The rows of each (term, level): one column a row that a key sets."""
    with np.errstate(over="ignore"):
        keys = _mix(hashes + levels.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return np.stack([(_mix(keys + np.uint64(i)) % np.uint64(n_rows)).astype(np.int64) for i in range(ROWS_A_KEY)], axis=1)


def _blocks(doc_ids: np.ndarray, row_hashes: np.ndarray, lengths: np.ndarray, doc: np.ndarray, hashes: np.ndarray, tf: np.ndarray, size: int) -> Iterator[dict]:
    """Signatures of documents given as (doc, term hash, occurrences), blocks of like lengths."""
    order = np.argsort(lengths, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    by = np.argsort(place[doc], kind="stable")
    doc, hashes, tf = place[doc][by], hashes[by], tf[by]
    reached = np.searchsorted(LEVELS, tf, side="right")
    keys = np.cumsum(np.bincount(doc, reached, minlength=len(order)))
    to = 0
    while to < len(order):
        # fewer documents a block where they are long
        at, to = to, min(to + size, max(to + 1, int(np.searchsorted(keys, (keys[to - 1] if to else 0) + KEYS_A_BLOCK, side="right"))))
        docs = order[at:to]
        lo, hi = np.searchsorted(doc, [at, to])
        n = reached[lo:hi]
        # one key for each level that a term reaches
        first = np.repeat(np.cumsum(n) - n, n)
        levels = np.arange(int(n.sum())) - first
        column = np.repeat(doc[lo:hi] - at, n)
        n_rows = max(8, int(ROWS_A_KEY * len(levels) / len(docs) / LOAD))
        bits = np.zeros((n_rows, -(-len(docs) // 8) * 8), dtype=bool)
        for rows in _rows_of(np.repeat(hashes[lo:hi], n), levels, n_rows).T:
            bits[rows, column] = True
        yield {
            "doc_ids": doc_ids[docs].tobytes(), "row_hashes": row_hashes[docs].tobytes(), "lengths": lengths[docs].tobytes(),
            "rows": n_rows, "top": int(n.max()) if len(n) else 0, "bits": np.packbits(bits, axis=1).tobytes(),
        }


def build_index(docs: DataFrame, *, block: int = 512, docs_at_once: int = 8 * 512) -> DataFrame:
    """A staged table of signature blocks and of the documents that hold each term.

    Rows with bits are blocks: doc_ids, row_hashes (xxhash64 of the text) and
    lengths in terms, the number of rows of the signature, its highest level and
    its bits, row by row. Rows with a term count documents of a part of the table
    that hold it; their sum is the term's df. Neither depends on any query.
    Documents without terms are in no block, rows without doc_id are no documents.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        counted: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            ids, texts, lengths = (np.concatenate([h[i] for h in held]) for i in range(3))
            firsts = np.cumsum([0, *(len(h[0]) for h in held)])
            doc = np.concatenate([h[3] + f for h, f in zip(held, firsts, strict=False)])
            hashes, tf = np.concatenate([h[4] for h in held]), np.concatenate([h[5] for h in held])
            for b in _blocks(ids, texts, lengths, doc, hashes, tf, block):
                yield pa.RecordBatch.from_pydict({k: pa.array([v]) for k, v in b.items()} | {"term": pa.array([None], pa.string()), "df": pa.array([None], pa.int64())})
            n = len(counted)
            nothing = {k: pa.nulls(n, t) for k, t in (("doc_ids", pa.binary()), ("row_hashes", pa.binary()), ("lengths", pa.binary()), ("rows", pa.int64()), ("top", pa.int64()), ("bits", pa.binary()))}
            yield pa.RecordBatch.from_pydict(nothing | {"term": pa.array(list(counted), pa.string()), "df": pa.array(list(counted.values()), pa.int64())})
            held.clear()
            counted.clear()

        n = 0
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                doc_ids, row_hashes = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "row_hash"))
                data, edges = text_buffer(part.column("text"), _TABLE)
                words, places = cut_words(data, edges, (32,))
                words = words.dictionary_encode()
                doc = np.searchsorted(edges, places, side="right") - 1
                lengths = np.bincount(doc, minlength=part.num_rows).astype(np.int64)
                vocabulary = len(words.dictionary)
                keys, tf = np.unique(doc * max(vocabulary, 1) + words.indices.to_numpy(), return_counts=True)
                doc, code = keys // max(vocabulary, 1), keys % max(vocabulary, 1)
                strings = words.dictionary.to_pylist()
                for w, c in zip(strings, np.bincount(code, minlength=vocabulary).tolist(), strict=True):
                    counted[w] += c
                some = np.flatnonzero(lengths)
                held.append((doc_ids[some], row_hashes[some], lengths[some], np.searchsorted(some, doc), _term_hashes(strings)[code], tf))
                n += len(some)
                if n >= docs_at_once or len(counted) > 400_000 or sum(len(h[4]) for h in held) > KEYS_A_BLOCK:
                    n = 0
                    yield from out()
            give_back()
        if held:
            yield from out()

    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    found = rows.mapInArrow(index, "doc_ids binary, row_hashes binary, lengths binary, rows long, top long, bits binary, term string, df long")
    return staged(found, "signatures")


@dataclass
class Corpus:
    """What scores need of all documents: those with a term, and all terms."""

    n_docs: int
    n_terms: int

    def damping(self, length):
        """m of a document with so many terms."""
        return 100 - 25 + (25 * length * self.n_docs) // self.n_terms


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _gain(tf, m):
    """What an occurrence count adds to a score per unit of weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class _Queries:
    """A bounded set of queries ready for a task: their distinct terms, weights and how often each term stands in each."""

    def __init__(self, plan: list[tuple[int, str, int, int]]) -> None:
        """plan: (query, term, times, weight)."""
        self.terms = sorted({t for _, t, _, _ in plan})
        place = {t: i for i, t in enumerate(self.terms)}
        self.hashes = _term_hashes(self.terms)
        self.of: dict[int, list[tuple[str, int]]] = {}
        self.places: dict[int, np.ndarray] = {}
        self.weights: dict[int, np.ndarray] = {}
        for q, t, times, weight in plan:
            self.of.setdefault(q, []).append((t, times * weight))
        for q, own in self.of.items():
            self.places[q] = np.array([place[t] for t, _ in own])
            self.weights[q] = np.array([w for _, w in own], dtype=np.float64)

    def bounds(self, corpus: Corpus, lengths: np.ndarray, n_rows: int, top: int, bits: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(query, upper bounds of the scores of a block's documents)."""
        matrix = np.frombuffer(bits, dtype=np.uint8).reshape(n_rows, -1)
        m = int(corpus.damping(int(lengths.min())))
        gains = np.zeros((len(self.terms), len(lengths)))
        # above the last level of the block nothing occurs more often than the next level says
        reach = [int(LEVELS[j + 1]) - 1 if j + 1 < len(LEVELS) else None for j in range(top)]
        before = 0
        for level in range(top):
            now = _gain(reach[level], m) if reach[level] else 1_000_000
            rows = _rows_of(self.hashes, np.full(len(self.hashes), level), n_rows)
            slice_ = matrix[rows[:, 0]]
            for i in range(1, ROWS_A_KEY):
                slice_ = slice_ & matrix[rows[:, i]]
            gains += np.unpackbits(slice_, axis=1, count=len(lengths)) * float(now - before)
            before = now
        for q, places in self.places.items():
            # whole numbers below 2^53, so doubles are exact
            yield q, self.weights[q] @ gains[places]

    def score(self, corpus: Corpus, counts: dict[str, int], length: int, q: int) -> int:
        m = corpus.damping(length)
        return sum(w * _gain(tf, m) for t, w in self.of[q] if (tf := counts.get(t)))


def _bounded(blocks: DataFrame, queries: _Queries, corpus: Corpus, least: dict[int, int], most: int | None, share: float = 0.0) -> DataFrame:
    """q, doc_id, row_hash, bound of all bounds that reach a query's least score (1, where none is given) or of a task's highest of these: `most`, or this share of its documents if that is more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        seen = 0

        def rows(q: int, found: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"q": pa.array(np.full(found.shape[1], q), pa.int32()), "doc_id": pa.array(found[1]), "row_hash": pa.array(found[2]), "bound": pa.array(found[0])})

        for batch in batches:
            for b in batch.to_pylist():
                ids, texts, lengths = (np.frombuffer(b[c], dtype=np.int64) for c in ("doc_ids", "row_hashes", "lengths"))
                seen += len(ids)
                for q, bound in queries.bounds(corpus, lengths, b["rows"], b["top"], b["bits"]):
                    take = np.flatnonzero(bound >= max(1, least.get(q, 1)))
                    if not len(take):
                        continue
                    found = np.stack([bound[take].astype(np.int64), ids[take], texts[take]])
                    if most is None:
                        yield rows(q, found)
                        continue
                    if q in best:
                        found = np.concatenate([best[q], found], axis=1)
                    best[q] = found[:, np.lexsort((found[1], -found[0]))[: max(most, math.ceil(share * seen))]]
        for q, found in best.items():
            yield rows(q, found)

    return blocks.mapInArrow(run, "q int, doc_id long, row_hash long, bound long")


def _best(scores: DataFrame, by: str, k: int) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(by), "doc_id", "row_hash"))).filter(F.col("rank") <= k)


def _scored(docs: DataFrame, wanted: DataFrame, queries: _Queries, corpus: Corpus, *, few: bool = False) -> DataFrame:
    """q, doc_id, row_hash, score of the wanted (q, doc_id, row_hash), exact, from whole texts; a row for each repeated row. few: so many a query that all tasks can have them."""
    of_doc = wanted.select("q", "doc_id", "row_hash").distinct().groupBy("doc_id", "row_hash").agg(F.collect_list("q").alias("qs"))
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for part in slices(batch, "text"):
                data, edges = text_buffer(part.column("text"), _TABLE)
                words, places = cut_words(data, edges, (32,))
                firsts = np.searchsorted(places, edges).tolist()
                for i, (doc_id, row_hash, qs) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "row_hash", "qs")), strict=True)):
                    own = words.slice(firsts[i], firsts[i + 1] - firsts[i])
                    counts = Counter(own.filter(pc.is_in(own, value_set=pa.array(queries.terms, pa.string()))).to_pylist())
                    for q in qs:
                        if s := queries.score(corpus, counts, len(own), q):
                            for o, v in zip(out, (q, doc_id, row_hash, s), strict=True):
                                o.append(v)
            yield pa.RecordBatch.from_pydict({"q": pa.array(out[0], pa.int32()), "doc_id": pa.array(out[1], pa.int64()), "row_hash": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.int64())})

    return rows.join(F.broadcast(of_doc) if few else of_doc, ["doc_id", "row_hash"]).mapInArrow(score, "q int, doc_id long, row_hash long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, *, index: DataFrame | None = None, k: int = 20, seeds: int = 5, more_seeds: int = 50, terms_at_once: int = 50_000) -> DataFrame:
    """The k documents of the highest score above 0 for each item, all if there are fewer.

    The seeds * k documents of the highest bounds are scored first, then more_seeds * k
    (or one of 256 documents of the table, if that is more) of those that they do not
    exclude: the more they are, the better is the score that others must reach,
    whatever their number the result is the same. index is what build_index made of
    docs (made here if not given). Items are searched in sets of at most terms_at_once distinct terms each, an item of
    more alone; every set is matched with all documents.

    Returns item_id, rank (from 1), doc_id, score; equal scores go to the smaller
    doc_id. A null or empty text of an item finds nothing, a null text of a
    document is never found, and rows without doc_id are no documents. Rows of
    one doc_id are documents of their own, equal rows too. Equal rows of items
    are one item; other texts under the same item_id are ranked apart.
    """
    spark, work = docs.sparkSession, Scratch(docs.sparkSession)
    if index is None:
        index = build_index(docs)
    blocks = index.filter("bits is not null").select("doc_ids", "row_hashes", "lengths", "rows", "top", "bits")
    sizes = blocks.mapInPandas(_sizes, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    corpus = Corpus(sizes["n"] or 0, sizes["terms"] or 0)
    asked = items.select("item_id", "text").distinct().select("item_id", F.xxhash64("text").alias("item_hash"), F.explode(terms(F.col("text"))).alias("term")).groupBy("item_id", "item_hash", "term").agg(F.count("*").alias("times"))
    frequencies = index.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    plan = work.staged(asked.join(frequencies, "term"), "plan")
    results = []
    for number, chosen in enumerate(_query_sets(plan, terms_at_once)):
        queries = _Queries([(q, term, times, term_weight(corpus.n_docs, df)) for q, (_, own) in enumerate(chosen) for term, times, df in own])
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(chosen)], f"q int, item_id {items.schema['item_id'].dataType.simpleString()}")
        first = work.staged(_best(_bounded(blocks, queries, corpus, {}, seeds * k), "bound", seeds * k), f"seeds{number}")
        exact = _scored(docs, first, queries, corpus, few=True)
        # the k-th best exact score of the seeds is reached by k documents
        least = {r["q"]: r["score"] for r in _best(exact, "score", k).filter(F.col("rank") == k).select("q", "score").collect()}
        more = max(more_seeds * k, corpus.n_docs // DOCS_A_SEED)
        offered = _bounded(blocks, queries, corpus, least, k, OFFERED * more / max(1, corpus.n_docs))
        second = work.staged(_best(offered, "bound", more).select("q", "doc_id", "row_hash").distinct(), f"more{number}")
        exact = work.staged(_best(_scored(docs, second, queries, corpus, few=len(chosen) * more <= FEW_PAIRS), "score", k), f"exact{number}")
        reached = {r["q"]: max(r["score"], least.get(r["q"], 1)) for r in exact.filter(F.col("rank") == k).select("q", "score").collect()}
        rest = _bounded(blocks, queries, corpus, least | reached, None).select("q", "doc_id", "row_hash")
        rest = work.staged(rest.join(second, ["q", "doc_id", "row_hash"], "left_anti"), f"rest{number}")
        ranked = _best(exact.drop("rank").unionByName(_scored(docs, rest, queries, corpus)), "score", k)
        results.append(ranked.join(names, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    out = staged(out, "ranked")
    work.clear()
    return out


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"n": [len(x) // 8 for x in batch["lengths"]], "terms": [int(np.frombuffer(x, dtype=np.int64).sum()) for x in batch["lengths"]]})


def _query_sets(plan: DataFrame, most: int) -> Iterator[list[tuple[object, list[tuple[str, int, int]]]]]:
    """Items with their (term, times, df), read in order and a set at a time, so the driver holds one set."""
    rows = plan.orderBy("item_id", "item_hash", "term").toLocalIterator()
    chosen: list[tuple[object, list]] = []
    last, n = None, 0
    for r in rows:
        if (key := (r["item_id"], r["item_hash"])) != last:
            if n >= most:
                yield chosen
                chosen, n = [], 0
            chosen.append((r["item_id"], []))
            last = key
        chosen[-1][1].append((r["term"], r["times"], r["df"]))
        n += 1
    if chosen:
        yield chosen
