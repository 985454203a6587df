"""Collocations: frequent phrases by multikey quicksort of suffix pointers.

A suffix is a word with those that follow it in its piece, five at most. Suffixes
are routed to tasks by their leading two words. A task sorts pointers to its
suffixes by three-way partitions, one word deeper in each partition of equal
words; the size of such a partition is the count of the phrase of its words.
Partitions below the least count are abandoned, as no longer phrase in them can
reach it.

For the same reason no suffix needs to travel whose leading pair is rare, or to
go on beyond a rare pair. Two passes before the routing find words and pairs that
are frequent; tasks know them by bit filters of a fixed size, whose false
positives only cost work. Suffixes of a pair that leads very many of them are
routed by three words or more, and what is counted in part is summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, give_back, staged
from .words import byte_table, cut_words, text_buffer

_TABLE = byte_table(True, space=b"\t", end=b".,;:!?\n\x0b\x0c\r")
#: Each filter has so many bits, whatever the input.
FILTER_BITS = 1 << 26
#: Hot prefixes are few (four a task): a worker holds a filter of 128 KB of each length beside that of the pairs.
HOT_BITS = 1 << 20
_PARTS = 64
#: So much text is worked on at a time; what a task holds is some twenty times that.
SLICE_BYTES = 2_000_000


def _mix(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = values * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return z ^ (z >> np.uint64(32))


def _hashes(words: pa.Array, lang: str) -> np.ndarray:
    """Hashes of words of a language."""
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), seed) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def _pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(left * np.uint64(3) + right)


def _bits_of(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(_mix(hashes + np.uint64(i)) % np.uint64(bits)).astype(np.int64) for i in range(2)]


class HashFilter:
    """A Bloom filter of a fixed number of bits that Spark builds in parts; a part is bounded, and so is the whole."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    @staticmethod
    def of(hashes: DataFrame, bits: int = FILTER_BITS) -> HashFilter:
        """The filter of a column `hash`."""

        def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                at = np.concatenate(_bits_of(batch["hash"].to_numpy().view(np.uint64), bits))
                at = np.unique(at)
                cell, mask = at >> 6, np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))
                heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                yield pd.DataFrame({"cell": cell[heads], "mask": np.bitwise_or.reduceat(mask, heads).view(np.int64)})

        size = bits // 64 // _PARTS

        def part(key: tuple[int], cells: pd.DataFrame) -> pd.DataFrame:
            out = np.zeros(size, dtype=np.int64)
            out[cells["cell"].to_numpy() % size] = cells["mask"].to_numpy()
            return pd.DataFrame({"part": [key[0]], "data": [out.tobytes()]})

        cells = hashes.mapInPandas(places, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask"))
        found = cells.withColumn("part", F.expr(f"cast(cell div {size} as int)")).groupBy("part").applyInPandas(part, "part int, data binary")
        words = np.zeros(bits // 64, dtype=np.uint64)
        for row in found.collect():  # _PARTS rows of a fixed size at most
            words[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["data"], dtype=np.uint64)
        return HashFilter(bits, words)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may be in it; none that is in it is missing."""
        out = np.ones(len(hashes), dtype=bool)
        for at in _bits_of(hashes, self.bits):
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """(lang, distinct words, code of each word in order, whether the next word is in the same piece) of a bounded part of the texts of a language."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            # a language is copied slice by slice
            own = np.flatnonzero(pc.equal(langs.indices, code).to_numpy(zero_copy_only=False))
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)[own].astype(np.int64))
            at = 0
            while at < len(own):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
                data, edges = text_buffer(batch.column("text").take(pa.array(own[at:to])), _TABLE)
                at = to
                words, places = cut_words(data, edges, (32, 10))
                if not len(words):
                    continue
                words = words.dictionary_encode()
                piece = np.cumsum(data == 10, dtype=np.int32)[places]
                doc = np.searchsorted(edges, places, side="right")
                goes_on = np.zeros(len(places), dtype=bool)
                goes_on[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
                del data, edges, piece, doc
                yield lang, words.dictionary, words.indices.to_numpy(), goes_on
                del words, places, goes_on
                give_back()


def quicksort_counts(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weights: np.ndarray, depth: int, least: int, whole_from: int = 0) -> Iterator[tuple[int, int, int]]:
    """(a suffix that begins with it, its words, count) of each phrase that occurs least times.

    Suffix i is codes[starts[i] : starts[i] + lengths[i]] and stands for weights[i]
    equal ones. Multikey quicksort: pointers are parted three ways by the code at
    the current depth, the equal ones go on one word deeper. Partitions of fewer
    than least are abandoned; phrases of fewer words than whole_from are counted
    in part here, so these are given whatever their count.
    """
    stack = [(np.arange(len(starts)), 0)]
    while stack:
        at, d = stack.pop()
        need = least if d + 1 >= whole_from else 1
        # suffixes that end here are in no longer phrase
        at = at[lengths[at] > d]
        while len(at):
            key = codes[starts[at] + d]
            pivot = int(np.median(key[[0, len(key) // 2, -1]]))
            same = at[key == pivot]
            if (n := int(weights[same].sum())) >= need:
                yield int(same[0]), d + 1, n
                if d + 1 < depth:
                    stack.append((same, d + 1))
            if len(same) == len(at):
                break
            sides = [s for s in (at[key < pivot], at[key > pivot]) if len(s) and int(weights[s].sum()) >= need]
            if not sides:
                break
            at = sides[0]
            if len(sides) == 2:
                stack.append((sides[1], d))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, phrase, f of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes, _ in _streams(batches):
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words)), "phrase": words, "f": pa.array(np.bincount(codes, minlength=len(words)))})

    return docs.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _word_hashes(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang)).column("phrase")
                yield pa.RecordBatch.from_pydict({"hash": pa.array(_hashes(own, lang).view(np.int64))})

    return words.mapInArrow(run, "hash long")


def counted_pairs(docs: DataFrame, words: HashFilter) -> DataFrame:
    """hash, n of the pairs of frequent words, and of few others."""
    shared = docs.sparkSession.sparkContext.broadcast((words.bits, words.words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = HashFilter(*shared.value)
        for lang, distinct, codes, goes_on in _streams(batches):
            hashes = _hashes(distinct, lang)
            some = known.has(hashes)[codes]
            at = np.flatnonzero(goes_on[:-1] & some[:-1] & some[1:])
            # equal pairs are counted before they are hashed
            pairs, n = np.unique(codes[at].astype(np.int64) * len(distinct) + codes[at + 1], return_counts=True)
            pairs = _pair_hashes(hashes[pairs // len(distinct)], hashes[pairs % len(distinct)])
            yield pa.RecordBatch.from_pydict({"hash": pa.array(pairs.view(np.int64)), "n": pa.array(n)})

    return docs.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


class _Suffixes:
    """The suffixes of a stream that begin with a frequent pair, each up to the first rare one; at: their places, words: their numbers of words."""

    def __init__(self, pairs: HashFilter, longest: int, lang: str, distinct: pa.Array, codes: np.ndarray, goes_on: np.ndarray) -> None:
        self.hashes = np.append(_hashes(distinct, lang), np.uint64(0))
        good = np.zeros(len(codes) + longest, dtype=bool)
        at = np.flatnonzero(goes_on)
        good[at] = pairs.has(_pair_hashes(self.hashes[codes[at]], self.hashes[codes[at + 1]]))
        self.at = np.flatnonzero(good)
        self.words = np.full(len(self.at), 2)
        for i in range(2, longest):
            self.words += (self.words == i) & good[self.at + i - 1]
        self.codes = np.concatenate([codes, np.full(longest, len(distinct), dtype=codes.dtype)])

    def prefix(self, n: int, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of the first n words."""
        at = self.at[of]
        out = self.hashes[self.codes[at]]
        for i in range(1, n):
            out = _pair_hashes(out, self.hashes[self.codes[at + i]])
        return out

    def routes(self, hot: list[HashFilter]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the words that route each suffix, how many words these are, one more for a suffix that ends inside a hot route)."""
        route, deep = self.prefix(2), np.full(len(self.at), 2)
        for n, known in enumerate(hot, 2):
            on = np.flatnonzero(deep == n)
            on = on[known.has(route[on])]
            deep[on] = n + 1
            on = on[self.words[on] > n]
            route[on] = self.prefix(n + 1, on)
        return route, deep


def hot_prefixes(docs: DataFrame, pairs: HashFilter, hot: list[HashFilter], longest: int, more: int) -> DataFrame:
    """hash of the prefixes, one word longer than the hot ones known, that begin more suffixes than `more`."""
    shared = docs.sparkSession.sparkContext.broadcast([(f.bits, f.words) for f in (pairs, *hot)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *longer = (HashFilter(*x) for x in shared.value)
        for stream in _streams(batches):
            found = _Suffixes(known, longest, *stream)
            route, deep = found.routes(longer)
            hashes, n = np.unique(route[(deep == len(longer) + 2) & (found.words >= deep)], return_counts=True)
            yield pa.RecordBatch.from_pydict({"hash": pa.array(hashes.view(np.int64)), "n": pa.array(n)})

    return docs.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") > more).select("hash")


def hot_routes(docs: DataFrame, counted: DataFrame, pairs: HashFilter, longest: int, more: int) -> list[HashFilter]:
    """Filters of the prefixes of two words, three and so on that begin more suffixes than `more`, as far as there are any.

    Pairs are counted already; each further length is a pass over the texts that
    only looks at suffixes with a hot prefix. Hot prefixes are few (n / more).
    """
    found: list[HashFilter] = []
    hot = counted.filter(F.col("n") > more).select("hash")
    while len(found) < longest - 2:
        filtered = HashFilter.of(hot, HOT_BITS)
        if not filtered.words.any():
            break
        found.append(filtered)
        hot = hot_prefixes(docs, pairs, found, longest, more)
    return found


def routed_suffixes(docs: DataFrame, pairs: HashFilter, hot: list[HashFilter], longest: int, tasks: int) -> DataFrame:
    """lang, task, deep, suffixes, n: for each part of the texts and each task that counts, its suffixes (a line each) and their numbers.

    A suffix is routed by its leading two words, or by more where these begin
    very many. A phrase of `deep` words and more has all its suffixes in one
    task; of shorter ones a task holds a part. Equal suffixes of a part of the
    texts go as one.
    """
    shared = docs.sparkSession.sparkContext.broadcast([(f.bits, f.words) for f in (pairs, *hot)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *longer = (HashFilter(*x) for x in shared.value)
        for lang, distinct, codes, goes_on in _streams(batches):
            found = _Suffixes(known, longest, lang, distinct, codes, goes_on)
            del codes, goes_on
            columns = [distinct.take(pa.array(found.codes[found.at + i], mask=found.words <= i)) for i in range(longest)]
            whole = pc.binary_join_element_wise(*columns, " ", null_handling="skip").dictionary_encode()
            del columns
            n = np.bincount(whole.indices.to_numpy(), minlength=len(whole.dictionary)).astype(np.int64)
            # one place of each distinct suffix
            one = np.zeros(len(n), dtype=np.int64)
            one[whole.indices.to_numpy()] = np.arange(len(found.at))
            route, deep = found.routes(longer)
            place = (_mix(route[one]) % np.uint64(tasks)).astype(np.int64) * (longest + 2) + deep[one]
            order = np.argsort(place, kind="stable")
            place, n = place[order], n[order].tobytes()
            edges = np.concatenate([np.flatnonzero(np.append(True, place[1:] != place[:-1])), [len(place)]]) if len(place) else np.zeros(1, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), whole.dictionary.take(pa.array(order)))
            del found, whole, distinct, one, route, deep, order
            heads = place[edges[:-1]]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(heads), pa.string()), "task": pa.array(heads // (longest + 2), pa.int64()), "deep": pa.array(heads % (longest + 2), pa.int32()),
                "suffixes": pc.binary_join(lists, "\n"), "n": pa.array([n[8 * a : 8 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()),
            })
            del lists, n, place, edges, heads

    return docs.mapInArrow(cut, "lang string, task long, deep int, suffixes string, n binary")


def frequent_phrases(routed: DataFrame, tasks: int, longest: int, least: int) -> DataFrame:
    """lang, phrase, k, f of the phrases of two words and more that occur least times, from staged suffixes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[pa.Array, bytes]]] = {}
        for batch in batches:
            lines = pc.split_pattern(batch.column("suffixes"), "\n")
            for i, (lang, deep, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "deep", "n")), strict=True)):
                held.setdefault((lang, deep), []).append((lines[i].values, n))
        for (lang, deep), parts in held.items():
            lists = pc.split_pattern(pa.concat_arrays([p for p, _ in parts]), " ")
            weights = np.frombuffer(b"".join(n for _, n in parts), dtype=np.int64)
            words = lists.flatten().dictionary_encode()
            edges = lists.offsets.to_numpy().astype(np.int64)
            codes, starts = words.indices.to_numpy(), edges[:-1] - edges[0]
            out: list[list] = [[], [], [], []]
            for i, k, n in quicksort_counts(codes, starts, np.diff(edges), weights, longest, least, 0 if deep == 2 else deep):
                if k > 1:
                    phrase = words.dictionary.take(pa.array(codes[starts[i] : starts[i] + k])).to_pylist()
                    for o, v in zip(out, (lang, " ".join(phrase), k, n), strict=True):
                        o.append(v)
                if len(out[0]) >= 50_000:
                    yield _phrases(out)
                    out = [[], [], [], []]
            yield _phrases(out)

    dealt = routed.repartition(tasks, "task").select("lang", "deep", "suffixes", "n")
    counted = dealt.mapInArrow(count, "lang string, phrase string, k int, f long")
    return counted.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _phrases(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.array(out[0], pa.string()), "phrase": pa.array(out[1], pa.string()), "k": pa.array(out[2], pa.int32()), "f": pa.array(out[3], pa.int64())})


def _ranked(rows: DataFrame, order: list, k: int) -> DataFrame:
    """rank of each row within its lang, the first k of each: a range sort over all tasks, no task holds a language."""
    ranged = rows.repartitionByRange("lang", *order).sortWithinPartitions("lang", *order)
    placed = staged(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranked")
    parts = placed.groupBy("lang", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first_at"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("lang", "part", "first_at", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")).filter(F.col("before") < k)
    rank = F.col("before") + F.col("at") - F.col("first_at") + 1
    return placed.join(offsets, ["lang", "part"]).withColumn("rank", rank).filter(F.col("rank") <= k).drop("part", "at", "first_at", "before")


def collocations(docs: DataFrame, *, least: int = 100, longest: int = 5, top: int | None = 2000, rows_a_task: int = 1_000_000) -> DataFrame:
    """Phrases of 2 to `longest` words that occur least times, scored by how much more often than their parts' counts say.

    Texts are lower-cased (A-Z) and split at `.,;:!?` and line ends into pieces,
    these at spaces and tabs into words. Counts are per lang, overlaps included.
    A phrase's score is the smallest floor(1000 * a * n / (l * r)) over the ways
    to cut it in two, ties to the shorter first part; arithmetic is exact. Phrases
    inside a longer one that is as frequent are dropped.

    A task that counts suffixes has about rows_a_task of them.

    Returns lang, rank, phrase, a, l, r, n, score, each lang's `top` by score and
    a descending, phrase ascending in UTF-8 bytes; all where top is None. A null
    lang is `und`; null and empty texts have no words; a missing doc_id does not
    matter and repeated rows count each.
    """
    work = Scratch(docs.sparkSession)
    texts = docs.filter("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = work.staged(count_words(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= least)
    counted = work.staged(counted_pairs(texts, HashFilter.of(_word_hashes(frequent))).filter(F.col("n") >= least), "pairs")
    pairs = HashFilter.of(counted.select("hash"))
    n_suffixes = counted.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_suffixes // rows_a_task))
    hot = hot_routes(texts, counted, pairs, longest, max(500, n_suffixes // (4 * tasks)))
    phrases = work.staged(frequent_phrases(work.staged(routed_suffixes(texts, pairs, hot, longest, tasks), "suffixes"), tasks, longest, least), "phrases")
    scored = _scored(phrases, frequent, totals)
    # a phrase one word longer that is as frequent; longer ones only if that is, too
    split = F.split("phrase", " ")
    inner = phrases.filter("k > 2").select("lang", "f", F.explode(F.array(F.array_join(F.slice(split, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(split, F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    within = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    out = staged(_ranked(left.select("lang", "phrase", "a", "l", "r", "n", "score"), order, top if top is not None else (1 << 62)), "collocations")
    work.clear()
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the lowest-scoring cut."""
    counts = words.select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", "f"))
    split = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice(split, F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice(split, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(totals, "lang")
    score = F.expr("cast((cast(1000 as decimal(4,0)) * (cast(a as decimal(16,0)) * cast(n as decimal(17,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")
