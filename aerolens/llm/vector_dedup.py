"""Embedding near-dedup: Euclidean p-stable hashing with exact cosine checks.

Vectors of length one with cosine c lie sqrt(2 - 2c) apart. A table hashes a
vector to the integer parts of a few Gaussian projections over a bucket width;
near vectors fall into one bucket with known probability, so the number of tables
follows from the recall wanted. Inside a bucket every pair is checked by its
cosine in double precision. A pair that meets in several tables counts in the
first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, staged
from .components import connected_components
from .near_dedup import _Forest
from .vectors import matrix, usable


def collision(distance: float, width: float) -> float:
    """Probability that one projection puts two vectors so far apart into one bucket."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def hash_plan(n: int, cosine: float, recall: float, width: float) -> tuple[int, int]:
    """Projections a table, so that unrelated vectors seldom meet, and tables for the recall at the threshold."""
    far, near = collision(math.sqrt(2), width), collision(math.sqrt(2 - 2 * cosine), width)
    k = max(2, math.ceil(math.log(max(n, 2) / 32) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k))))


def best_width(n: int, cosine: float, recall: float) -> float:
    """The bucket width that needs fewest tables."""
    return min((w / 4 for w in range(2, 25)), key=lambda w: (hash_plan(n, cosine, recall, w)[1], w))


def bucket_keys(x: np.ndarray, projections: int, tables: int, width: float, seed: int) -> np.ndarray:
    """rows x tables: 32-bit bucket names of vectors of length one; chance equals only cost a comparison."""
    rng = np.random.default_rng([seed, x.shape[1]])
    a, b = rng.normal(size=(x.shape[1], tables * projections)), rng.uniform(0, width, tables * projections)
    cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, projections)
    mix = rng.integers(1, 1 << 62, (tables, projections), dtype=np.int64) * 2 + 1
    with np.errstate(over="ignore"):
        keys = (cells * mix[None]).sum(axis=2)
        return ((keys ^ (keys >> 29)) >> 17).astype(np.int32)


def vector_near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, recall: float = 0.9999, width: float | None = None, block: int = 256, seed: int = 11) -> DataFrame:
    """id_col, n_links, component_id, kept for every row.

    n_links counts the other rows with cosine >= `cosine`, equal vectors
    included; a component's id is the smallest id that links reach. Vectors that
    are null, zero or hold null or non-finite parts link with nothing, nor do
    vectors of different lengths. Repeated rows of an id count as rows, and
    different vectors of one id are judged apart. A row without id has component
    null and is kept. Other columns are not carried. Without a width the one
    that needs fewest tables is taken.
    """
    work = Scratch(vectors.sparkSession)
    rows = usable(vectors, id_col, vec_col)
    # equal vectors are one class from here on, however many there are; its id is its own, as one vec_id may have several
    classes = rows.groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    classes = work.staged(classes.select(F.monotonically_increasing_id().alias("id"), "first", "size", "vec", F.size("vec").alias("dim")), "vectors")
    # vectors travel in the type that they came in
    kind = vectors.schema[vec_col].dataType.simpleString()
    n = classes.count()
    width = width or best_width(n, cosine, recall)
    projections, tables = hash_plan(n, cosine, recall, width)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("dim"):
                x = matrix(part["vec"])
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "size": part["size"].to_numpy(), "dim": part["dim"].to_numpy(), "vec": list(part["vec"]), "keys": list(bucket_keys(x, projections, tables, width, seed))})

    hashed = work.staged(classes.select("id", "size", "dim", F.col("vec").cast(kind).alias("vec")).mapInPandas(keys, f"id long, size long, dim int, vec {kind}, keys array<int>"), "hashed")
    dealt = hashed.select("id", "dim", F.posexplode("keys").alias("t", "key"))
    counts = dealt.groupBy("t", "dim", "key").agg(F.count("*").alias("n")).filter("n > 1")
    live = dealt.join(counts, ["t", "dim", "key"])
    # a large bucket becomes cells, each with the rows of two of its blocks
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    live = live.withColumn("own", F.pmod(F.xxhash64("id", "t"), n_blocks).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = live.select("id", "t", "dim", "key", "own", F.explode(cells).alias("c")).select("id", "t", "dim", "key", "own", "c.i", "c.j")
    groups = dealt.join(hashed.select("id", "size", "vec", "keys"), "id").groupBy("t", "dim", "key", "i", "j").agg(F.collect_list(F.struct("id", "size", "own", "vec", "keys")).alias("m"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for t, i, j, ids, sizes, own, vecs, names in zip(*(batch[c] for c in ("t", "i", "j", "ids", "sizes", "own", "vecs", "names")), strict=True):
                if len(ids) < 2:
                    continue
                x, names = matrix(vecs), np.stack(list(names))
                norm = np.sqrt((x * x).sum(axis=1))
                near = np.triu((x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine, 1)
                if i != j:
                    near &= own[:, None] != own[None, :]
                a, b = np.nonzero(near)
                for at in range(0, len(a), 1 << 16):  # memory stays bounded in dense buckets
                    p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                    near[p, q] = (names[p] == names[q]).argmax(axis=1) == t
                a, b = np.nonzero(near)
                links = np.bincount(a, weights=sizes[b], minlength=len(ids)) + np.bincount(b, weights=sizes[a], minlength=len(ids))
                forest = _Forest(len(ids))
                for p, q in zip(a.tolist(), b.tolist(), strict=True):
                    forest.join(p, q)
                names_of = [int(v) for v in ids]
                out += [(names_of[k], None, int(links[k])) for k in np.flatnonzero(links).tolist()]
                out += [(p, q, 0) for p, q in forest.edges(names_of)]
            yield pd.DataFrame(out, columns=["a", "b", "n"]).astype({"a": "Int64", "b": "Int64", "n": "Int64"})

    found = work.staged(groups.select("t", "i", "j", *(F.col(f"m.{c}").alias(n) for c, n in (("id", "ids"), ("size", "sizes"), ("own", "own"), ("vec", "vecs"), ("keys", "names")))).mapInPandas(compare, "a long, b long, n long"), "pairs")
    links = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("outer")).withColumnRenamed("a", "id")
    components = connected_components(found.filter("b is not null").select("a", "b"), work).join(classes.select("id", "first"), "id")
    smallest = components.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = components.join(smallest, "component").select("id", "component_id")
    labels = classes.select("id", "first", "size", "vec").join(links, "id", "left").join(linked, "id", "left")
    labels = labels.select("vec", (F.col("size") - 1 + F.coalesce("outer", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    labels = staged(labels, "labels")
    work.clear()
    known = rows.join(labels, "vec").select("id", "n_links", "component_id")
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.coalesce(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0), F.lit(False))
    rest = every.filter(F.col("id").isNull() | ~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = known.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id_col)
