"""Toxicity: a factorization machine over hashed terms.

The score of a document is sigmoid(b + sum of w + sum over pairs of v.v) over the
buckets of the terms it contains, so a pair such as an insult and a group's name
can weigh more than the two alone. Every term has a bucket, and all are trained.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

TERM = re.compile(r"[^\W\d_]+")


#: Every term has one of so many buckets, whatever the input.
BUCKETS = 1 << 18


def hashed_terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the lower-cased terms of a whole text."""
    terms = set(TERM.findall(text.lower())) if text else ()
    return np.unique(np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in terms), dtype=np.uint32, count=len(terms)))


class FactorizationMachine:
    """Weights and factors of all buckets; those whose weight and factors are zero are left out, as they count nothing."""

    def __init__(self, keys: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.keys, self.bias, self.w, self.v = keys, bias, w, v

    def known(self, terms: np.ndarray) -> np.ndarray:
        """Indices of the buckets that have weights."""
        if not len(self.keys) or not len(terms):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, terms), len(self.keys) - 1)
        return at[self.keys[at] == terms]

    def score(self, terms: np.ndarray) -> float:
        at = self.known(terms)
        v = self.v[at]
        s = v.sum(axis=0)
        z = self.bias + self.w[at].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, *, factors: int = 4, epochs: int = 20, batch: int = 32, rate: float = 0.2, together: float = 6, l1: float = 1e-3, l1_unproven: float = 8.0, l2: float = 1e-3, seed: int = 7) -> FactorizationMachine:
        """Adaptive-gradient descent in mini-batches on log loss, all buckets trained, with an L1 step on weights and factors.

        Counts of the sample only set where training starts and how strong the
        L1 step is. Buckets that tell the labels apart by log-odds, alone (over
        two standard errors, and one more for each ten times 380 buckets up to
        3.5, as more pass by chance) or in a pair (over `together` beyond the two alone,
        see pair_effects), have a weak one and start with random factors.
        All others start at 0 and leave it only where so many rows of one batch
        that the model gets wrong share them.
        """
        n = len(rows)
        rate_of_label = float((labels.sum() + 0.5) / (n + 1)) if n else 0.0
        empty = cls(np.zeros(0, dtype=np.uint32), float(np.log(max(rate_of_label, 1e-4) / (1 - min(rate_of_label, 0.9999)))), np.zeros(0), np.zeros((0, factors)))
        if not n or labels.min() == labels.max():
            return empty
        keys, ids = np.unique(np.concatenate(rows), return_inverse=True)
        of = np.repeat(np.arange(n), [len(r) for r in rows])
        df = np.bincount(ids, minlength=len(keys))
        hit = np.bincount(ids, weights=labels[of], minlength=len(keys))
        odds, error = log_odds(hit, df - hit, labels.sum() - hit, n - labels.sum() - df + hit)
        paired = pair_effects(of, ids, labels, len(keys)) > together
        alone = min(3.5, max(2.0, 2 + np.log10(len(keys) / 380)))
        proven = paired | (np.abs(odds) / error > alone)
        shrink = np.where(proven, l1, l1_unproven)
        rng = np.random.default_rng(seed)
        model = cls(keys, empty.bias, np.zeros(len(keys)), np.where(proven[:, None], rng.normal(0, 0.05, (len(keys), factors)), 0))
        data = np.split(ids, np.cumsum([len(r) for r in rows])[:-1])
        gw, gv, gb = np.full(len(keys), 1e-8), np.full((len(keys), factors), 1e-8), 1e-8
        clip = lambda x, by: np.sign(x) * np.maximum(np.abs(x) - by, 0)
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                part = order[at : at + batch]
                terms = np.concatenate([data[i] for i in part])
                of = np.repeat(np.arange(len(part)), [len(data[i]) for i in part])
                v = model.v[terms]
                s = np.stack([np.bincount(of, weights=v[:, f], minlength=len(part)) for f in range(factors)], axis=1)
                squares = np.bincount(of, weights=(v * v).sum(axis=1), minlength=len(part))
                raw = model.bias + np.bincount(of, weights=model.w[terms], minlength=len(part)) + 0.5 * ((s * s).sum(axis=1) - squares)
                g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]
                gb += g.sum() ** 2
                model.bias -= rate * g.sum() / np.sqrt(gb)
                used, inverse = np.unique(terms, return_inverse=True)
                dw = np.bincount(inverse, weights=g[of], minlength=len(used))
                dv = np.stack([np.bincount(inverse, weights=g[of] * (s[of, f] - v[:, f]), minlength=len(used)) for f in range(factors)], axis=1) + l2 * model.v[used]
                gw[used] += dw * dw
                step = rate / np.sqrt(gw[used])
                model.w[used] = clip(model.w[used] - step * dw, step * shrink[used])
                gv[used] += dv * dv
                step = rate / np.sqrt(gv[used])
                model.v[used] = clip(model.v[used] - step * dv, step * np.where(proven[used], 0, l1_unproven)[:, None])
        some = (model.w != 0) | (model.v != 0).any(axis=1)
        return cls(keys[some].astype(np.uint32), model.bias, model.w[some], model.v[some])


def log_odds(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of (a / b) / (c / d) with half a row added to each count, and its standard error."""
    cells = [x + 0.5 for x in (a, b, c, d)]
    return np.log(cells[0] / cells[1]) - np.log(cells[2] / cells[3]), np.sqrt(sum(1 / x for x in cells))


def pair_effects(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, n_terms: int, least: int = 5, block: int = 256) -> np.ndarray:
    """For each term the largest effect, in standard errors, of a pair that it is in beyond the effects of the two alone.

    rows and terms say which of n_terms terms stand in which row. The effect is
    the change of one term's log-odds with the other's presence. A pair in fewer
    than `least` toxic rows cannot make its terms' rows toxic by six standard
    errors, so terms in fewer need no look. Pairs are counted a block of terms
    against another, so memory stays small.
    """
    most = np.zeros(n_terms)
    toxic = labels > 0
    often = np.flatnonzero((np.bincount(terms[toxic[rows]], minlength=n_terms) >= least) & (np.bincount(terms, minlength=n_terms) < len(labels)))
    place = np.full(n_terms, -1)
    place[often] = np.arange(len(often))
    found = np.zeros(len(often))
    present = np.zeros((len(labels), len(often)), dtype=bool)
    inside = place[terms] >= 0
    present[rows[inside], place[terms[inside]]] = True
    df, hit = present.sum(axis=0).astype(np.float32), present[toxic].sum(axis=0).astype(np.float32)
    n, pos = np.float32(len(labels)), np.float32(toxic.sum())
    for at in range(0, len(often), block):
        x = present[:, at : at + block].astype(np.float32)
        for to in range(0, at + 1, block):
            y = present[:, to : to + block].astype(np.float32)
            both, bad = x.T @ y, x[toxic].T @ y[toxic]
            di, hi, dj, hj = df[at : at + block, None], hit[at : at + block, None], df[to : to + block], hit[to : to + block]
            # toxic rows and others: with both terms, the first alone, the second alone, neither
            with_other, e1 = log_odds(bad, both - bad, hi - bad, di - both - hi + bad)
            without, e2 = log_odds(hj - bad, dj - both - hj + bad, pos - hi - hj + bad, n - di - dj + both - pos + hi + hj - bad)
            z = np.abs(with_other - without) / np.sqrt(e1 * e1 + e2 * e2)
            if at == to:
                np.fill_diagonal(z, 0)
            found[at : at + block] = np.maximum(found[at : at + block], z.max(axis=1))
            found[to : to + block] = np.maximum(found[to : to + block], z.max(axis=0))
    most[often] = found
    return most


def held_out(doc_id: Column) -> Column:
    """True for the fold that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8000, **options) -> FactorizationMachine:
    """Fit on at most max_rows labelled documents outside the held-out fold.

    The sample is the first max_rows labels in the order of xxhash64(doc_id), so
    it is bounded at every size. Several labels of a document count as their
    largest, of several texts of a doc_id the one with the smallest hash is
    read; null labels and ids are void. The label is the only thing joined in.
    """
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("label"))
        .filter(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "terms": [hashed_terms(t).astype("<u4").tobytes() for t in batch["text"]]})

    # at most max_rows rows of two numbers, so the broadcast is bounded
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    single = marked.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("m")).select("doc_id", "label", "m.text")
    rows = single.mapInPandas(terms, "doc_id long, label double, terms binary").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return FactorizationMachine.fit([np.frombuffer(t, dtype="<u4") for t in rows["terms"]], rows["label"].to_numpy(dtype=float), **options)


def toxicity(docs: DataFrame, model: FactorizationMachine, *, threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the carried columns for every row.

    The score reads the whole text and nothing else. Null and empty texts get
    the score of no terms. A null doc_id is scored as any other, never held out.
    Repeated rows are repeated.
    """

    whole = "text" in carry

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"] if whole else batch.pop("text")
            yield batch.assign(score=[model.score(hashed_terms(t)) for t in texts])
            del batch, texts
            give_back()

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", *(F.col(c) for c in carry if c not in ("doc_id", "text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if whole or f.name != "text") + ", score double"
    scored = rows.mapInPandas(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
