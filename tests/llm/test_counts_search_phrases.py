"""Token counts against the libraries; ranked search and collocations against plain loops over all documents."""

import base64
import math
import re
import subprocess
import sys
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from aerolens.llm import collocations as phrases_of
from aerolens.llm import lexical_search as search
from aerolens.llm.collocations import HashFilter, collocations, quicksort_counts
from aerolens.llm.lexical_search import LEVELS, Corpus, _blocks, _gain, _Queries, _term_hashes, build_index, lexical_search
from aerolens.llm.token_counts import Counter as TokenCounter
from aerolens.llm.token_counts import token_counts
from aerolens.llm.words import slices

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", None, " a", "a ", "a  b", "a\n\nb", "\n", "x\t y", "don't stop\n's", " ", "a <|endoftext|> b", "a  <|endoftext|>  b<|endoftext|>\n<|endoftext|>", "é́, ok.", "12,", "a\n b", "x" * 3000, "tab\tin word", "a \r\nb", "½² ³", "end\n", "a b", "a  b", "　 a", "  ", "\n\n a", "a\n", "\na", "日本語 text", "it's 'tis"]
DOC = "doc_id long, text string, lang string, n_tokens string"


def plain_counts(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_counts_equal_the_tokenizers():
    rng = np.random.default_rng(0)
    texts = ODD + ["".join(rng.choice(list("ab C.,'\n \t1é <| 　“"), rng.integers(1, 30))) for _ in range(2000)]
    want = plain_counts(texts)
    assert TokenCounter(PATH).counts(pa.array(texts)).tolist() == want
    # forgetting pieces changes nothing
    assert TokenCounter(PATH, max_pieces=10).counts(pa.array(texts)).tolist() == want
    # neither does the cut into pieces, which only saves work
    assert [TokenCounter(PATH).count(t or "") for t in texts[:200]] == want[:200]


def test_counts_equal_tiktokens():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t or "" for t in ODD]
    assert TokenCounter(str(path)).counts(pa.array(texts)).tolist() == [len(plain.encode_ordinary(t)) for t in texts]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        TokenCounter(str(public_tokenizers.path("word_bpe_49k.json")))


def test_token_counts_of_rows(spark):
    """Nulls, repeats, long texts, clashing columns and the limit."""
    texts = [*ODD, "word, " * 100_000, " ".join(["of"] * 512), " ".join(["of"] * 513), "a", "a"]
    rows = [(i if i % 7 else None, t, "en", "mine") for i, t in enumerate(texts)]
    out = token_counts(spark.createDataFrame(rows, DOC), PATH, carry=("n_tokens",))
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_tokens"]
    got = Counter(tuple(r) for r in out.collect())
    want = Counter((r[0], len((r[1] or "").encode()), n, n > 512, "mine") for r, n in zip(rows, plain_counts(texts), strict=True))
    assert got == want
    assert token_counts(spark.createDataFrame([], DOC), PATH).collect() == []


def test_a_long_piece_is_merged_in_bounded_time():
    """A heap takes n log n steps; rescanning after each merge would take minutes."""
    text = "ab" * 60_000
    assert TokenCounter(PATH).counts(pa.array([text])).tolist() == plain_counts([text])


def test_slices_hold_every_row():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * 10, None, "y" * 500, "", "z"])})
    parts = list(slices(batch, "text", 20))
    assert [p.num_rows for p in parts] == [2, 1, 2] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


TERM = re.compile(search.TERM)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_search(docs, items, k=20):
    """Scores of all documents, one by one."""
    held = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs if i is not None]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in TERM.findall(lower(text)) if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def search_fixture(n=300):
    rng = np.random.default_rng(5)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 40_000) % 900]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 200)))) for i in range(n)]
    docs += [(n + i, docs[i % 3][1]) for i in range(40)]  # copies: equal scores
    docs += [(1000, None), (1001, ""), (1002, "..."), (None, "w1 w2"), (1003, "Émile W1, É w1"), (1004, "w1 " * 30_000 + "w2"), (1004, "w3 w4"), (1004, "w3 w4")]
    items = [(i, " ".join(rng.choice(words, 12)) + " W1. w1") for i in range(15)] + [(90, None), (91, ""), (92, "nowhere"), (93, "Émile é"), (94, "w3 w4"), (94, "w3 w4"), (None, "w5 w6 w7")]
    return docs, items


@pytest.mark.parametrize("terms_at_once", [50_000, 30])
def test_search_equals_scores_of_all_documents(spark, terms_at_once):
    docs, items = search_fixture()
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in docs], DOC).repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string")
    out = lexical_search(df, asked, terms_at_once=terms_at_once)
    assert dict(out.dtypes) == {"item_id": "int", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_search(docs, items)


def test_search_with_an_index_made_before_and_few_hits(spark):
    docs, items = search_fixture(60)
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in docs], DOC)
    index = build_index(df, block=16, docs_at_once=32)
    out = lexical_search(df, spark.createDataFrame(items[:3], "item_id int, text string"), index=index, k=3)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_search(docs, items[:3], 3)


def test_a_second_round_of_seeds_excludes_most_of_the_rest(spark, monkeypatch):
    """After the first seeds many bounds reach their k-th score; few of them are left after the second, and no result is lost."""
    docs, items = search_fixture()
    items = items[:6] + [(94, "w3 w4"), (None, "w5 w6 w7")]
    scored, bounded, counts, left = search._scored, search._bounded, [], []
    monkeypatch.setattr(search, "_scored", lambda docs, wanted, *a, **b: counts.append(wanted.distinct().count()) or scored(docs, wanted, *a, **b))
    monkeypatch.setattr(search, "_bounded", lambda *a: left.append(out := bounded(*a)) or out)
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in docs], DOC).repartition(3)
    index = build_index(df, block=64)
    out = lexical_search(df, spark.createDataFrame(items, "item_id int, text string"), index=index, k=3, seeds=1, more_seeds=6)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_search(docs, items, 3)
    # first seeds, more seeds, the rest: all bounds that the first seeds do not exclude were scored before
    assert len(counts) == 3 and 0 < counts[2] and counts[1] + counts[2] < left[1].select("q", "doc_id", "row_hash").distinct().count()


def test_the_second_seeds_are_a_share_of_all_documents(spark, monkeypatch):
    """What the first seeds leave is not listed: a round gives its share and the rest only what the second seeds leave, and no result is lost."""
    docs, items = search_fixture()
    items = items[:6] + [(94, "w3 w4"), (None, "w5 w6 w7")]
    bounded, made = search._bounded, []
    monkeypatch.setattr(search, "_bounded", lambda *a: made.append((a, out := bounded(*a))) or out)
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in docs], DOC).repartition(3)
    index = build_index(df, block=64)
    out = lexical_search(df, spark.createDataFrame(items, "item_id int, text string"), index=index, k=2, seeds=1, more_seeds=4)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_search(docs, items, 2)
    (_, first), (given, second), *later = made
    blocks, queries, corpus, least = given[:4]
    # 8 seeds an item, four times as many offered by all tasks together, a task's last place rounded up
    assert second.groupBy("q").count().agg({"count": "max"}).first()[0] <= 4 * 8 + 3
    assert len(later) == 1 and second.count() < bounded(blocks, queries, corpus, dict(least), None).count()


def test_search_of_nothing(spark):
    none, asked = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical_search(none, asked).collect() == []
    assert lexical_search(spark.createDataFrame([(1, "a", None, None)], DOC), asked.limit(0)).collect() == []


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(8)
    n, vocabulary = 200, [f"t{i}" for i in range(60)]
    counts = [Counter({t: int(c) for t, c in zip(vocabulary, rng.zipf(1.5, 60) - 1, strict=True) if c}) for _ in range(n)]
    lengths = np.array([sum(c.values()) for c in counts])
    corpus = Corpus(n, int(lengths.sum()))
    plan = [(q, t, 1 + i % 2, 1000 + 37 * i) for q in range(5) for i, t in enumerate(vocabulary[q * 7 : q * 7 + 9])]
    queries = _Queries(plan)
    doc = np.repeat(np.arange(n), [len(c) for c in counts])
    terms = [t for c in counts for t in c]
    tf = np.array([v for c in counts for v in c.values()])
    pruned = 0
    for b in _blocks(np.arange(n), np.arange(n), lengths, doc, _term_hashes(terms), tf, 64):
        ids, own = np.frombuffer(b["doc_ids"], dtype=np.int64), np.frombuffer(b["lengths"], dtype=np.int64)
        for q, bound in queries.bounds(corpus, own, b["rows"], b["top"], b["bits"]):
            exact = np.array([queries.score(corpus, counts[i], int(lengths[i]), q) for i in ids])
            assert (bound >= exact).all()
            pruned += int((bound < np.sort(exact)[-5]).sum())
    assert pruned > 100  # the bounds are tight enough to exclude documents
    assert all(_gain(int(a), 100) < _gain(int(b), 100) for a, b in zip(LEVELS, LEVELS[1:], strict=False))


def plain_phrases(docs, least, top=2000):
    """Counts of all phrases of one to five words, and the rules said plainly."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    rows = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            s, k = min((math.floor(Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p)))
            rows[lang, p] = (s, a, f[lang, p[:k]], f[lang, p[k:]])
    inside = {(lang, p[i:j]) for lang, p in rows for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (i, j) != (0, len(p)) and rows[lang, p][1] >= f[lang, p[i:j]]}
    out = []
    for lang in n:
        best = sorted((-v[0], -v[1], " ".join(p).encode(), v) for (g, p), v in rows.items() if g == lang and (g, p) not in inside)[:top]
        out += [(lang, rank, p.decode(), v[1], v[2], v[3], n[lang], v[0]) for rank, (_, _, p, v) in enumerate(best, 1)]
    return sorted(out)


def phrase_fixture():
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(25)] + ["The", "of", "a b", "x-y", "\x01"])
    rows = []
    for i in range(250):
        text = " ".join(rng.choice(words, rng.integers(2, 60), p=np.r_[np.full(25, 0.5 / 25), 0.3, 0.1, 0.04, 0.03, 0.03]))
        text += rng.choice([". ", ",", "\n", "  ", "\t", "\r\n"]) + "in the end of all things it was"
        rows.append((i, text, rng.choice(["en", "de"]), "x"))
    rows += [(900, None, "en", "x"), (901, "", None, "x"), (None, "in the end, no words lost", None, "x"), (902, "hot pair and more words " * 400, "a b", "x"), (903, "z " * 5000, None, "x"), (903, "z " * 5000, None, "x")]
    return rows


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("least", "rows_a_task"), [(20, 250_000), (5, 300), (100, 250_000)])
def test_collocations_equal_plain_counts(spark, least, rows_a_task):
    rows = phrase_fixture()
    df = spark.createDataFrame(rows, DOC).repartition(4)
    want = plain_phrases(rows, least)
    assert want and found(collocations(df, least=least, rows_a_task=rows_a_task)) == want


def test_hot_pairs_are_split(spark, monkeypatch):
    """With nearly every route hot, suffixes go on by three words and more, and partial counts add up."""
    rows = phrase_fixture()
    routes = phrases_of.hot_routes
    made = []
    monkeypatch.setattr(phrases_of, "hot_routes", lambda docs, counted, pairs, longest, more: made.append(routes(docs, counted, pairs, longest, 12)) or made[0])
    assert found(collocations(spark.createDataFrame(rows, DOC).repartition(6), least=10)) == plain_phrases(rows, 10)
    assert len(made[0]) == 3


def test_a_worker_gives_back_what_slices_took():
    """In a process of its own: suffixes of 16 MB of text are routed in slices, and what was freed is the system's again."""
    run = """
import re, threading, time
import numpy as np, pyarrow as pa
from aerolens.llm import collocations as c
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
class Docs:
    sparkSession = sparkContext = property(lambda self: self)
    def broadcast(self, x):
        self.value = x
        return self
    def mapInArrow(self, f, schema):
        return f
rng = np.random.default_rng(0)
words = np.array(["".join(w) for w in rng.choice(list("abcdefghij"), (4000, 7))])
batch = pa.RecordBatch.from_pydict({"lang": pa.array(["en"] * 5000), "text": pa.array([" ".join(words[rng.integers(0, 4000, 400)]) for _ in range(5000)])})
full = c.HashFilter(1 << 20, np.full(1 << 14, ~np.uint64(0)))
cut = c.routed_suffixes(Docs(), full, [], 5, 4)
for _ in cut(iter([batch.slice(0, 50)])): pass
before, most, on = held(), 0, True
def watch():
    global most
    while on:
        most = max(most, held())
        time.sleep(0.002)
t = threading.Thread(target=watch); t.start()
for _ in cut(iter([batch])): pass
on = False; t.join()
print(most - before, held() - before)
"""
    most, kept = map(float, subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, check=True).stdout.split())
    print(most, kept)
    assert most < 180 and kept < 25, (most, kept)


def test_hot_filters_are_small(spark):
    rows = [(1, "a b c " * 60, "en", "x")]
    docs = spark.createDataFrame(rows, DOC).select("lang", "text")
    counted = phrases_of.counted_pairs(docs, HashFilter(64, np.full(1, ~np.uint64(0))))
    hot = phrases_of.hot_routes(docs, counted, HashFilter(64, np.full(1, ~np.uint64(0))), 5, 50)
    assert len(hot) == 3 and all(f.words.nbytes == 1 << 17 for f in hot)


def test_a_full_filter_only_costs_work(spark, monkeypatch):
    """Where every bit is set all suffixes travel, with the same result."""
    rows = phrase_fixture()[:80]
    monkeypatch.setattr(HashFilter, "has", lambda self, hashes: np.ones(len(hashes), dtype=bool))
    assert found(collocations(spark.createDataFrame(rows, DOC), least=15, top=7)) == plain_phrases(rows, 15, 7)


def test_collocations_of_nothing(spark):
    assert collocations(spark.createDataFrame([], DOC)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None, None), (2, "a b", "en", None)], DOC)).collect() == []


def test_scores_pass_64_bits(spark):
    """Exact beyond what a long or a double can hold."""
    a, l, r, n = 10**11 + 1, 10**11 + 7, 10**11 + 3, 10**13 + 9
    words = spark.createDataFrame([("en", "x", l), ("en", "y", r)], "lang string, phrase string, f long")
    out = phrases_of._scored(spark.createDataFrame([("en", "x y", 2, a)], "lang string, phrase string, k int, f long"), words, spark.createDataFrame([("en", n)], "lang string, n long"))
    assert out.first()["score"] == 1000 * a * n // (l * r)


def test_quicksort_counts():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 4, 500)
    starts, weights = np.arange(496), rng.integers(1, 4, 496)
    lengths = np.full(496, 4)
    want = Counter()
    for s, w in zip(starts, weights, strict=True):
        for k in range(1, 5):
            want[tuple(codes[s : s + k])] += int(w)
    for least in (1, 20):
        got = {tuple(codes[i : i + k]): n for i, k, n in quicksort_counts(codes, starts, lengths, weights, 4, least)}
        assert got == {p: n for p, n in want.items() if n >= least}
