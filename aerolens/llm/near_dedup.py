"""MinHash near-dedup: a chosen-path set similarity join, then exact confirmation.

Documents become sets of word shingles; equal sets are one class from then on.
Each class has a signature of minwise values. A tree starts with all classes in
one node; a node selects a few coordinates by its own hash and sends a class to
one child for each of them, named by the class's value there. With two
coordinates a node, sets of similarity 0.8 stay together somewhere below with
probability 0.94 in each tree, at any depth; independent trees raise that to
1 - 2e-5. Small nodes are compared exhaustively on signatures. In larger nodes
all classes are compared with a pivot; those close to it are done, the others
branch further.

Candidates only group classes. Inside a group the full shingle sets decide:
small groups as a whole, large ones by a pivot and then in blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WORD, Scratch, give_back, staged
from .components import connected_components
from .substring_dedup import _HASHES, MAX_WORDS
from .words import slices

_WORD = re.compile(WORD)
_LOWER = str.maketrans(UPPER, UPPER.lower())
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * _C2
        z = (z ^ (z >> np.uint64(27))) * _C3
        return z ^ (z >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A text with fewer words than a shingle has its whole sequence as one; a text
    without words has none.
    """
    found = _WORD.findall(text.translate(_LOWER)) if text else []
    if len(_HASHES) > MAX_WORDS:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(words, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = _mix(out * _C1 + h[i : i + n])
    return np.unique(out)


def signature(values: np.ndarray, size: int) -> np.ndarray:
    """For each of `size` hash functions 16 bits of the smallest value."""
    seeds = _mix(np.arange(1, size + 1, dtype=np.uint64) * _C1)
    best = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 2048):
            z = values[at : at + 2048, None] ^ seeds[None, :]
            z = (z ^ (z >> np.uint64(32))) * _C2
            best = np.minimum(best, z.min(axis=0))
    return (_mix(best) >> np.uint64(48)).astype("<u2")


def branch(nodes: np.ndarray, signatures: np.ndarray, width: int) -> np.ndarray:
    """Children of each class's nodes (rows x nodes -> rows x nodes * width)."""
    size, rows = signatures.shape[1], np.arange(len(signatures))[:, None]
    with np.errstate(over="ignore"):
        start = _mix(nodes + _C1)
        stride = start // np.uint64(size) % np.uint64(size // width)
        children = []
        for k in range(width):
            # the k-th coordinate comes from the k-th part of the signature, so they differ
            at = (start // np.uint64(size**2) * np.uint64(k + 1) + stride) % np.uint64(size // width) + np.uint64(k * (size // width))
            children.append(_mix((nodes ^ at) * _C1 + signatures[rows, at.astype(np.int64)].astype(np.uint64) + np.uint64(1)))
    return np.concatenate(children, axis=1)


class _Forest:
    """Union-find over places 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)

    def edges(self, ids: list[int]) -> list[tuple[int, int]]:
        return [(ids[r], ids[x]) for x in range(len(self.up)) if (r := self.root(x)) != x]


def _links(sets: list[np.ndarray], left: int, percent: int) -> np.ndarray:
    """left x n: pairs of similarity of at least percent, counted exactly on the full sets.

    The sets become rows of 0 and 1 over their distinct shingles; products of
    slices of columns count what two sets share, so memory stays bounded.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    columns = np.unique(np.concatenate(sets), return_inverse=True)[1]
    rows = np.repeat(np.arange(n), sizes)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    # shingles of one set only are in no intersection
    shared = np.bincount(columns)[columns] > 1
    rows, columns = rows[shared], np.unique(columns[shared], return_inverse=True)[1]
    both = np.zeros((left, n), dtype=np.float32)
    width = 1 << 14
    for at in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        lo, hi = np.searchsorted(columns, [at, at + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[rows[lo:hi], columns[lo:hi] - at] = 1
        both += part[:left] @ part.T
    common = both.astype(np.int64)
    return 100 * common >= percent * (sizes[:left, None] + sizes[None, :] - common)


def shingle_sets(docs: DataFrame, words: int, signature_size: int) -> DataFrame:
    """doc_id, row_hash, n_shingles, class hash (c1, c2) and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[], [], [], []]
                for text in part.column("text").to_pylist():
                    s = shingles(text, words)
                    with np.errstate(over="ignore"):
                        c1, c2 = int(_mix(s).sum(dtype=np.uint64).view(np.int64)), int(_mix(_mix(s ^ _C1)).sum(dtype=np.uint64).view(np.int64))
                    for o, v in zip(out, (len(s), c1, c2, signature(s, signature_size).tobytes() if len(s) else None), strict=True):
                        o.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_hash"), *map(pa.array, out, kinds)], ["doc_id", "row_hash", "n_shingles", "c1", "c2", "sig"])
            batch = part = None
            give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, row_hash long, n_shingles long, c1 long, c2 long, sig binary")


def _matrix(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), dtype="<u2").reshape(len(signatures), -1)


def candidate_groups(classes: DataFrame, work: Scratch, *, trees: int, width: int, small: int, close: float, done: float, far: float, pivots: int = 6) -> DataFrame:
    """Pairs (a, b) of classes that tie each candidate group together; linear in the nodes.

    close: estimate from which two classes of a small node are tied. In a larger
    node a class is tied to a pivot from `far` on and leaves from `done` on:
    whatever is linked to it then resembles the pivot enough to be tied too.
    """
    n = classes.count()
    # so deep that a node of unrelated sets, which share few values, is small
    depth = max(1, math.ceil(math.log(max(2.0, n / 16)) / math.log(32)))

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sig = _matrix(batch["sig"])
            nodes = np.repeat(_mix(np.arange(1, trees + 1, dtype=np.uint64))[None, :], len(sig), axis=0)
            for _ in range(depth):
                nodes = branch(nodes, sig, width)
            yield pd.DataFrame({"node": nodes.ravel().view(np.int64), "id": np.repeat(batch["id"].to_numpy(), nodes.shape[1])})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ids, sigs in zip(batch["ids"], batch["sigs"], strict=True):
                sig, forest = _matrix(sigs), _Forest(len(ids))
                for i in range(len(ids) - 1):
                    for j in (np.flatnonzero((sig[i + 1 :] == sig[i]).mean(axis=1) >= close) + i + 1).tolist():
                        forest.join(i, j)
                out += forest.edges([int(x) for x in ids])
            yield pd.DataFrame(out, columns=["a", "b"])

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sig, ids = _matrix(batch["sig"]), batch["id"].to_numpy()
            ps = [(batch[f"p{k}"].to_numpy(), _matrix(batch[f"s{k}"])) for k in range(pivots)]
            near = np.stack([(sig == s).mean(axis=1) for _, s in ps])
            best = near.argmax(axis=0)
            out = []
            for k, (p, s) in enumerate(ps):
                # the best pivot, and others that are not tied to it themselves
                same = np.zeros(len(ids), dtype=bool)
                for j, (_, t) in enumerate(ps):
                    same |= (best == j) & (j != k) & ((s == t).mean(axis=1) >= far)
                # a pivot's own row ties it to the other pivots
                own = np.any([ids == q for q, _ in ps], axis=0)
                tied = (near[k] >= far) & (ids != p) & ((best == k) | ~same | own)
                out.append(pd.DataFrame({"edge": True, "x": p[tied], "id": ids[tied]}))
            on = near.max(axis=0) < done
            children = branch(batch["node"].to_numpy()[on].view(np.uint64)[:, None], sig[on], width)
            out.append(pd.DataFrame({"edge": False, "x": children.ravel().view(np.int64), "id": np.repeat(ids[on], width)}))
            yield pd.concat(out)

    signed = classes.select("id", "sig")
    rows = signed.mapInPandas(plant, "node long, id long")
    edges: DataFrame | None = None
    nodes: DataFrame | None = None
    while True:
        counts = rows.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        live = work.staged(rows.join(counts, "node"), "nodes")
        part = live.filter(F.col("n") <= small).select("node", "id")
        nodes = part if nodes is None else nodes.unionByName(part)
        large = live.filter(F.col("n") > small).select("node", "id")
        if large.isEmpty():
            break
        with_sig = large.join(signed, "id")
        # the same few classes become pivots of many nodes, so their ties repeat
        chosen = with_sig.groupBy("node").agg(*(F.min_by(F.struct("id", "sig"), F.xxhash64("id", F.lit(k))).alias(f"m{k}") for k in range(pivots)))
        chosen = chosen.select("node", *(c for k in range(pivots) for c in (F.col(f"m{k}.id").alias(f"p{k}"), F.col(f"m{k}.sig").alias(f"s{k}"))))
        parts = work.staged(with_sig.join(chosen, "node").mapInPandas(split, "edge boolean, x long, id long").distinct(), "branches")
        found = parts.filter("edge").select(F.col("x").alias("a"), F.col("id").alias("b"))
        edges = found if edges is None else edges.unionByName(found)
        rows = parts.filter("not edge").select(F.col("x").alias("node"), "id")
    # small nodes of all rounds at once; equal nodes of several trees are compared once
    groups = nodes.groupBy("node").agg(F.sort_array(F.collect_set("id")).alias("ids")).filter("size(ids) > 1").select("ids").distinct()
    members = groups.select(F.xxhash64("ids").alias("node"), F.explode("ids").alias("id"))
    compared = members.join(signed, "id").groupBy("node").agg(F.collect_list(F.struct("id", "sig")).alias("m")).select(F.col("m.id").alias("ids"), F.col("m.sig").alias("sigs"))
    ties = compared.mapInPandas(compare, "a long, b long").distinct()
    return ties if edges is None else ties.unionByName(edges)


def _compare_groups(groups: DataFrame, percent: int, by: list[str]) -> DataFrame:
    """Edges (a, b) that span the links inside each group of rows (id, left, set).

    Rows marked left are compared with all rows of the group.
    """
    packed = groups.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((~F.col("left")).alias("right"), "id", "set"))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, right, sets in zip(batch["ids"], batch["right"], batch["sets"], strict=True):
                left = int(np.sum(~np.asarray(right, dtype=bool)))
                if not left or len(ids) < 2:
                    continue
                links = _links([np.frombuffer(s, dtype="<u8") for s in sets], left, percent)
                forest = _Forest(len(ids))
                for i, j in np.argwhere(links).tolist():
                    if forest.root(i) != forest.root(j):
                        forest.join(i, j)
                yield pd.DataFrame(forest.edges([int(x) for x in ids]), columns=["a", "b"])
            del batch
            give_back()

    return packed.select(F.col("m.id").alias("ids"), F.col("m.right").alias("right"), F.col("m.set").alias("sets")).mapInPandas(run, "a long, b long")


def exact_links(docs: DataFrame, groups: DataFrame, work: Scratch, *, words: int, percent: int, block: int = 128, pivots: int = 4) -> DataFrame:
    """Edges (a, b) that span the exact links inside each group of classes (id, doc_id, row_hash, group)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["set"] = [shingles(t, words).astype("<u8").tobytes() for t in batch.pop("text")]
            yield batch
            del batch
            give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    picked = groups.join(texts, ["doc_id", "row_hash"]).select("group", "id", "text").dropDuplicates(["id"])
    sets = work.staged(picked.mapInPandas(read, "group long, id long, set binary"), "sets")
    sizes = work.staged(sets.groupBy("group").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", F.lit(1))).alias("p0"), *(F.min_by("id", F.xxhash64("id", F.lit(k + 1))).alias(f"p{k}") for k in range(1, pivots))).filter("n > 1"), "groups")
    small = sets.join(sizes.filter(F.col("n") <= block).select("group"), "group").select("group", "id", F.lit(True).alias("left"), "set")
    edges = _compare_groups(small, percent, ["group"])
    large = sizes.filter(F.col("n") > block)
    if large.isEmpty():
        return edges

    # large groups: everything against a few pivots; what links to the best of them is one component
    chosen = large.select("group", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(pivots))))).alias("pivot"))
    pivot_sets = chosen.join(sets.select(F.col("id").alias("pivot"), F.col("set").alias("pivot_set")), "pivot")

    def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["set"], batch["pivot_set"], strict=True):
                x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[np.array(keep, dtype=bool), ["group", "id", "pivot"]]

    members = sets.join(large.select("group", "n"), "group")
    linked = work.staged(members.join(pivot_sets, "group").select("group", "id", "set", "pivot", "pivot_set").mapInPandas(against, "group long, id long, pivot long"), "pivots")
    edges = edges.unionByName(linked.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    counts = linked.groupBy("group", "pivot").agg(F.count("*").alias("k"))
    best = counts.groupBy("group").agg(F.max_by("pivot", F.struct("k", "pivot")).alias("pivot"))
    core = linked.join(best, ["group", "pivot"]).select("id", F.lit(True).alias("core"))
    # the rest, in blocks of its own, against itself and against the blocks of the core
    sides = members.select("group", "id").join(core, "id", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    many = sides.groupBy("group", "core").agg(F.ceil(F.count("*") / block).alias("k"))
    placed = work.staged(sides.join(many, ["group", "core"]).select("group", "id", "core", F.pmod(F.xxhash64("id", F.lit(99)), F.col("k")).cast("int").alias("own")), "blocks")
    held = placed.select("group", "core", F.col("own").alias("other")).distinct()
    with_rest = placed.join(held.filter("not core").drop("core"), "group")
    with_core = placed.filter("not core").join(held.filter("core").drop("core"), "group")
    cells = (
        with_rest.filter("core").select("group", "id", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(True).alias("with_core"), F.lit(False).alias("left"))
        .unionByName(with_core.select("group", "id", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(True).alias("with_core"), F.lit(True).alias("left")))
        .unionByName(with_rest.filter("not core").select("group", "id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.lit(False).alias("with_core"), (F.col("own") <= F.col("other")).alias("left")))
    )
    dealt = cells.join(sets, ["group", "id"])
    return edges.unionByName(_compare_groups(dealt, percent, ["group", "i", "j", "with_core"]))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, trees: int = 4, width: int = 2, signature_size: int = 128, small: int = 128) -> DataFrame:
    """doc_id, row_hash, n_shingles, component_id, kept for every row.

    row_hash is xxhash64 of the text. Two documents are linked when 100 * shared >= percent * union of their
    shingle sets; a component's id is its smallest doc_id. Empty sets (null or
    blank texts) link with nothing. Equal sets, repeated rows included, are one
    class and always linked. Rows without doc_id are no documents: component
    null, kept true. Rows of one doc_id with different texts are judged each by
    its own text.
    """
    work = Scratch(docs.sparkSession)
    margin = 5 * math.sqrt(percent / 100 * (1 - percent / 100) / signature_size)
    rows = staged(shingle_sets(docs, words, signature_size), "signatures")
    sets = rows.filter("doc_id is not null and n_shingles > 0")
    classes = work.staged(sets.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "row_hash", "n_shingles", "sig")).alias("m")).select("c1", "c2", "m.*"), "classes")
    # a doc_id with several texts has several classes, so classes have ids of their own
    seed = 0
    while not (named := classes.withColumn("id", F.xxhash64("c1", "c2", F.lit(seed)))).groupBy("id").count().filter("count > 1").isEmpty():
        seed += 1
    classes = named
    # fewer shingles than this cannot be similar without being equal
    least = math.ceil(percent / (100 - percent))
    large = classes.filter(F.col("n_shingles") >= least)
    apart = 1 - percent / 100
    done = 1 - 2 * apart
    pairs = candidate_groups(large, work, trees=trees, width=width, small=small, close=1 - apart - margin, done=done, far=max(0.1, done - apart - 0.1))
    groups = work.staged(connected_components(pairs, work).select("id", F.col("component").alias("group")), "candidates")
    members = groups.join(classes.select("id", "doc_id", "row_hash"), "id")
    links = work.staged(exact_links(docs, members, work, words=words, percent=percent), "exact")
    components = connected_components(links, work).join(classes.select("id", "doc_id"), "id")
    smallest = components.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = components.join(smallest, "component").select("id", "component_id")
    labels = classes.select("c1", "c2", "id", "doc_id").join(linked, "id", "left").select("c1", "c2", F.coalesce("component_id", "doc_id").alias("component_id"))
    labels = staged(labels, "labels")
    work.clear()
    known = sets.select("doc_id", "row_hash", "n_shingles", "c1", "c2").join(labels, ["c1", "c2"]).select("doc_id", "row_hash", "n_shingles", "component_id")
    rest = rows.filter("doc_id is null or n_shingles = 0").select("doc_id", "row_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
