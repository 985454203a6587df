"""Best-fit packing: a grouping genetic algorithm on islands.

Pieces shorter than a sequence are dealt to shards of a few thousand by hash. A
shard is evolved by several islands; an individual is a grouping of pieces into
sequences. A child takes its first parent's groups, gets whole well-filled groups
of the second injected, loses the groups that now hold duplicates, and the
displaced pieces are placed by best fit. Between rounds each island sends its
elite to the next one. All islands of all shards run as separate Spark rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, staged
from .tokens import encoded


def cut_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 of every piece of every document.

    Only documents of more than capacity ids are cut; all their pieces are full
    but perhaps the first. A null text is empty and has the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, data in encoded(tokenizer, batch.column("text"), end_id):
                n = len(data) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    pieces = docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")
    return pieces.select(F.monotonically_increasing_id().alias("uid"), "*")


class Grouping:
    """One individual: the group of each piece."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity

    def place(self, group: np.ndarray, free: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Best fit of the pieces in order into groups with room, new ones where none fits.

        A set bit of `room` says that a group with exactly that room exists, so
        the tightest group is the lowest bit not under the piece's size.
        """
        group = group.copy()
        by_room: dict[int, list[int]] = {}
        room = 0
        for g in np.flatnonzero((free > 0) & (free < self.capacity)).tolist():
            r = int(free[g])
            by_room.setdefault(r, []).append(g)
            room |= 1 << r
        fresh = int(group.max(initial=-1)) + 1
        for i, size in zip(order.tolist(), self.sizes[order].tolist(), strict=True):
            fit = room >> size
            if fit:
                r = size + (fit & -fit).bit_length() - 1
                groups = by_room[r]
                g = groups.pop()
                if not groups:
                    room ^= 1 << r
            else:
                r, g, fresh = self.capacity, fresh, fresh + 1
            group[i] = g
            if r > size:
                by_room.setdefault(r - size, []).append(g)
                room |= 1 << (r - size)
        return np.unique(group, return_inverse=True)[1].astype(np.int32)

    def fresh(self, order: np.ndarray) -> np.ndarray:
        return self.place(np.full(len(self.sizes), -1, dtype=np.int32), np.zeros(0, dtype=np.int64), order)

    def fills(self, group: np.ndarray) -> np.ndarray:
        return np.bincount(group, weights=self.sizes).astype(np.int64)

    def fitness(self, group: np.ndarray) -> float:
        """Fewer sequences first, then fuller ones: the mean squared fill."""
        fills = self.fills(group) / self.capacity
        return float((fills**2).sum() / len(fills)) - len(fills)

    def child(self, first: np.ndarray, second: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        fills = self.fills(second)
        well = fills >= max(np.median(fills), 0.98 * self.capacity)
        injected = (well & (rng.random(len(fills)) < rng.uniform(0.2, 0.7)))[second]
        hit = np.zeros(int(first.max()) + 1, dtype=bool)
        hit[first[injected]] = True
        # a few poorly filled groups are opened as well
        own = self.fills(first)
        hit |= (own < 0.9 * self.capacity) | ((own < self.capacity) & (rng.random(len(own)) < 0.3))
        group = np.where(injected, second + len(own), np.where(hit[first], -1, first)).astype(np.int32)
        displaced = np.flatnonzero(group < 0)
        used = np.bincount(group[group >= 0], weights=self.sizes[group >= 0], minlength=1)
        free = np.where(used > 0, self.capacity - used, 0).astype(np.int64)
        noise = rng.uniform(0.9, 1.1, len(displaced)) if rng.random() < 0.5 else 1.0
        return self.place(group, free, displaced[np.argsort(-self.sizes[displaced] * noise, kind="stable")])


def evolve(sizes: np.ndarray, capacity: int, population: list[np.ndarray], seed: int, *, keep: int = 4, children: int = 12) -> list[np.ndarray]:
    """The best `keep` individuals after so many children, best first."""
    rng, rules = np.random.default_rng(seed), Grouping(sizes, capacity)
    falling = np.argsort(-sizes, kind="stable")
    if not population:
        population = [rules.fresh(falling)]
    while len(population) < keep:
        population.append(rules.fresh(falling[np.argsort(-sizes[falling] * rng.uniform(0.8, 1.2, len(sizes)), kind="stable")]))
    ranked = sorted(((rules.fitness(g), n, g) for n, g in enumerate(population)), key=lambda x: (-x[0], x[1]))[:keep]
    least = -(-int(sizes.sum()) // capacity)
    for n in range(children):
        if int(ranked[0][2].max(initial=-1)) + 1 <= least:
            break
        a, b = rng.choice(len(ranked), 2, replace=len(ranked) < 2)
        made = rules.child(ranked[min(a, b)][2], ranked[max(a, b)][2], rng)
        ranked = sorted([*ranked, (rules.fitness(made), len(population) + n, made)], key=lambda x: (-x[0], x[1]))[:keep]
    return [g for _, _, g in ranked]


def pack(pieces: DataFrame, *, capacity: int = 1024, shard_pieces: int = 4096, islands: int = 2, rounds: int = 8, children: int = 24, seed: int = 1) -> DataFrame:
    """sequence_id and offset for every piece (uid, length and further columns).

    A full piece is a sequence of its own. Others are dealt by hash of uid to
    shards of about shard_pieces, so no shard grows with the data; each shard
    loses at most part of one sequence. islands evolve each shard in rounds,
    until a round saves no sequence or every shard is at its lower bound, at
    most `rounds` of them.
    """
    columns = pieces.columns
    full = pieces.filter(F.col("length") >= capacity).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.filter(F.col("length") < capacity)
    n_shards = max(1, -(-short.count() // shard_pieces))
    item = F.struct(*([F.col("uid")] + [F.col(c) for c in columns if c != "uid"]))
    shards = staged(short.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_shards)).alias("shard")).agg(F.sort_array(F.collect_list(item)).alias("items")), "packing")
    sizes = F.transform("items", lambda x: x["length"].cast("int"))

    def step(turn: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for shard, island, lengths, groups in zip(batch["shard"], batch["island"], batch["sizes"], batch["groups"], strict=True):
                    start = [np.asarray(g, dtype=np.int32) for g in groups]
                    found = evolve(np.asarray(lengths, dtype=np.int64), capacity, start, hash((seed, turn, int(shard), int(island))) & 0xFFFFFFFF, children=children)
                    out.append((shard, island, lengths, found, int(found[0].max(initial=-1)) + 1))
                yield pd.DataFrame(out, columns=["shard", "island", "sizes", "groups", "n"])

        return run

    work = Scratch(pieces.sparkSession)
    kind = "shard long, island int, sizes array<int>, groups array<array<int>>, n int"
    state = shards.select("shard", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), sizes.alias("sizes"), F.lit(None).cast("array<array<int>>").alias("groups")).withColumn("groups", F.coalesce("groups", F.array().cast("array<array<int>>")))
    # an island costs seconds for a few kilobytes, so tasks are not merged by size; a task has some islands where there are many
    n_islands = n_shards * islands
    tasks = max(min(n_islands, 2000), n_islands // 16)
    fewest = None
    for turn in range(rounds):
        if turn:
            elite = state.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.slice("groups", 1, 1).alias("elite"))
            state = state.join(elite, ["shard", "island"]).withColumn("groups", F.concat("elite", F.slice("groups", 1, 3))).drop("elite", "n")
        state = work.staged(state.repartition(tasks, "shard", "island").mapInPandas(step(turn), kind), "islands")
        now, least = state.groupBy("shard").agg(F.min("n").alias("n"), F.first(F.ceil(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x) / capacity)).alias("least")).agg(F.sum("n"), F.sum("least")).first()
        if now == least or now == fewest:
            break
        fewest = now
    best = staged(state.groupBy("shard").agg(F.min_by(F.get("groups", F.lit(0)), F.struct("n", "island")).alias("group")), "groupings")
    work.clear()

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, lengths, group in zip(batch["shard"], batch["sizes"], batch["group"], strict=True):
                lengths, group = np.asarray(lengths, dtype=np.int64), np.asarray(group, dtype=np.int64)
                order = np.argsort(group, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.searchsorted(group[order], group[order])
                offset = np.empty_like(lengths)
                offset[order] = before - before[first]
                yield pd.DataFrame({"shard": [shard], "bins": [group], "offsets": [offset]})

    placed = shards.select("shard", sizes.alias("sizes")).join(best, "shard").mapInPandas(lay, "shard long, bins array<long>, offsets array<long>")
    rows = shards.join(placed, "shard").select("shard", F.explode(F.arrays_zip("items", "bins", "offsets")).alias("x"))
    packed = rows.select(*(F.col(f"x.items.{c}").alias(c) for c in columns), (F.col("shard") * (1 << 24) + F.col("x.bins")).alias("sequence_id"), F.col("x.offsets").alias("offset"))
    return full.unionByName(packed)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, **options) -> DataFrame:
    """Pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty texts have one piece, the end id. Repeated rows are separate
    documents. Null doc_ids are carried. No documents: no rows. Other columns
    are not carried, so their names cannot clash.
    """
    pieces = staged(cut_pieces(docs, tokenizer, capacity=capacity, end_id=end_id), "pieces")
    return pack(pieces, capacity=capacity, **options).drop("uid")
