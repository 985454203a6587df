"""Token ids against the tokenizer itself; the wavelet matrix against plain lists."""

import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from aerolens.llm import token_shards as shards_of
from aerolens.llm import tokens
from aerolens.llm.token_shards import CHUNK, TokenShard, WaveletMatrix, find_token, id_bits, read_token_shards, write_token_shards
from aerolens.llm.tokens import Encoder, encoded

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", None, " a", "a ", "a  b", "a\n\nb", "\n", "x\t y", "don't stop\n's", "a b c", " ", "a <|endoftext|> b", "é́, ok.", "12,", "a\n b", "x" * 3000, "tab\tin word", "a \r\nb", "ok, ok. OK", "½² ³", "end\n"]


def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers():
    rng = np.random.default_rng(0)
    texts = ODD + ["".join(rng.choice(list("ab C.,'\n \t1é <|"), rng.integers(1, 30))) for _ in range(400)]
    tokenizer = Tokenizer.from_file(PATH)
    want = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for t in texts]
    assert [data for _, data in encoded(PATH, pa.array(texts), 2)] == want
    assert [data for _, data in encoded(PATH, pa.array(texts), 2, chars=40)] == want


def test_a_worker_keeps_and_takes_little_memory():
    """In a process of its own: 20 MB of text are encoded in slices, and what was freed is the system's again."""
    run = """
import re, sys, threading, time
import numpy as np, pyarrow as pa
from aerolens.llm.tokens import encoded, encoder
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
rng = np.random.default_rng(0)
words = np.array(["".join(w) for w in rng.choice(list("abcdefghij"), (4000, 7))])
texts = pa.array([" ".join(words[rng.integers(0, 4000, 400)]) for _ in range(6500)])
for _ in encoded(sys.argv[1], texts.slice(0, 50), 2): pass
before, most, on = held(), 0, True
def watch():
    global most
    while on:
        most = max(most, held())
        time.sleep(0.002)
t = threading.Thread(target=watch); t.start()
for _ in encoded(sys.argv[1], texts, 2): pass
on = False; t.join()
print(most - before, held() - before)
"""
    most, kept = map(float, subprocess.run([sys.executable, "-c", run, PATH], capture_output=True, text=True, check=True).stdout.split())
    assert most < 70 and kept < 20, (most, kept)


def test_shards_encode_each_word_once(spark, monkeypatch):
    """A task with 700,000 words, each twice, encodes no word that starts no line twice."""
    made = []
    monkeypatch.setattr(tokens._Words, "_encode", lambda self, words, encode=tokens._Words._encode: made.append(len(words)) or encode(self, words))
    texts = [" ".join(f"q{i}" for i in range(at, at + 10_000)) for at in range(0, 700_000, 10_000)] * 2

    class Docs:
        def __getattr__(self, name):
            return lambda *a, **b: self

        def mapInArrow(self, f, schema):  # noqa: N802
            for _ in f(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})])):
                pass
            raise StopIteration

    monkeypatch.setattr(shards_of, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    with pytest.raises(StopIteration):
        write_token_shards(Docs(), PATH)
    assert 700_000 <= sum(made) <= 700_000 + len(texts)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (1, 7, 512, 513, 3000, CHUNK, CHUNK + 1, 3 * CHUNK - 5):
        ids = rng.integers(0, 300, n).astype(np.uint16)
        m = WaveletMatrix.build(ids, 16)
        assert m.all_ids().tolist() == ids.tolist()
        for i in rng.integers(0, n, 20).tolist():
            assert m.access(i) == ids[i]
        for v in [*ids[:5].tolist(), 299, 65535]:
            places = np.flatnonzero(ids == v).tolist()
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            assert m.count(v) == len(places)
            assert m.count(v, lo, hi) == sum(lo <= p < hi for p in places)
            assert [m.occurrence(v, k) for k in range(min(5, len(places)))] == places[:5]
            assert m.occurrence(v, len(places)) == -1


def test_answers_read_few_chunks():
    """Access, count and occurrence decompress at most two chunks a plane of a shard with hundreds."""
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.3, 400_000) % 50_000).astype(np.uint16)
    blob = TokenShard.pack([1], [len(ids)], ids, 16)
    assert 16 * -(-len(ids) // CHUNK) > 200
    for i in rng.integers(0, len(ids), 5).tolist():
        m = TokenShard.unpack(blob).matrix
        assert m.access(i) == ids[i] and m.reads <= 16
        m = TokenShard.unpack(blob).matrix
        places = np.flatnonzero(ids == ids[i])
        assert m.count(int(ids[i])) == len(places) and m.reads <= 32
        m = TokenShard.unpack(blob).matrix
        assert m.occurrence(int(ids[i]), len(places) - 1) == places[-1] and m.reads <= 48


def test_tokenizers_of_other_kinds_take_texts_whole(tmp_path):
    """A file whose pre-tokenizer puts a space before every text is not cut into words."""
    import json

    described = json.load(open(PATH))
    described["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "prefix.json"
    path.write_text(json.dumps(described))
    texts = ["a b", "word", "", "x  y"]
    ids, offsets = Encoder(str(path)).encode(pa.array(texts))
    tokenizer = Tokenizer.from_file(str(path))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_find_token(spark):
    texts = ["a b a", "b", "a a a a", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shards = write_token_shards(docs, PATH, shard_ids=4)
    flat = [i for t in texts for i in [*plain_ids(t), 2]]
    for token in (plain_ids("a")[0], plain_ids(" a")[0], 2, 40_000):
        out = find_token(shards, token).collect()
        assert sum(r["n"] for r in out) == flat.count(token)
        assert min((r["first"] for r in out), default=-1) == (flat.index(token) if token in flat else -1)


def test_shard_round_trip_keeps_null_ids():
    ids = np.array([5, 6, 2, 2, 9, 2], dtype=np.uint16)
    shard = TokenShard.unpack(TokenShard.pack([3, None, 4], [3, 1, 2], ids, 16))
    assert shard.known.tolist() == [True, False, True]
    assert shard.ends.tolist() == [3, 4, 6]
    assert shard.matrix.all_ids().tolist() == ids.tolist()


def test_files_give_back_all_documents(spark):
    texts = [*ODD, "same", "same"]
    docs = spark.createDataFrame([(i if i != 4 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start string")
    out = read_token_shards(write_token_shards(docs, PATH, shard_ids=50)).collect()
    order = sorted(range(len(texts)), key=lambda i: (i == 4, i))
    start, want = 0, []
    for i in order:
        ids = [*plain_ids(texts[i]), 2]
        want.append((None if i == 4 else i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_token_shards(write_token_shards(docs, PATH)).collect() == []


def test_ids_that_do_not_fit_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a few plain words"), (2, None)], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit 8 bits"):
        write_token_shards(docs, PATH, bits=8)
    with pytest.raises(Exception, match="does not fit 16 bits"):
        write_token_shards(docs, PATH, end_id=70_000, bits=16)
    # without a width it is that of the largest id
    assert id_bits(PATH, 2) == 16 and id_bits(PATH, 70_000) == 17
    got = {r["doc_id"]: r["ids_crc32"] for r in read_token_shards(write_token_shards(docs, PATH, end_id=70_000)).collect()}
    assert got == {1: zlib.crc32(np.array([*plain_ids("a few plain words"), 70_000], dtype="<u4").tobytes()), 2: zlib.crc32(np.array([70_000], dtype="<u4").tobytes())}
