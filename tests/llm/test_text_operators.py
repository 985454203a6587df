"""Text operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import random
import re

import pytest

from aerolens.llm.line_dedup import line_dedup
from aerolens.llm.mixing import mix_sources
from aerolens.llm.near_dedup import near_duplicates
from aerolens.llm.queries import op3_url_filter
from aerolens.llm.substring_dedup import COVER, PERIOD, substring_dedup
from aerolens.llm.toxicity import BUCKETS, FactorizationMachine, fit_toxicity, hashed_terms, toxicity
from aerolens.llm.url_filter import url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "row_hash long, bitmap string, dense string, taken long, words string, n long, component_id string, score string, anchors string"


def docs_of(spark, rows):
    """(doc_id, text, source) with columns whose names the operators use inside."""
    extra = (1, "b", "d", 2, "w", 3, "c", "s", "a")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, source string, {CLASH}")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- substring dedup


def cut(rows, window=50):
    out = []
    for doc_id, text, _ in rows:
        words = WORD.findall(text or "")
        starts = {}
        for other, t, _ in rows:
            if other is not None and doc_id is not None and other < doc_id:
                w = WORD.findall(t or "")
                starts.update(dict.fromkeys(tuple(w[i : i + window]) for i in range(len(w) - window + 1)))
        gone = set()
        for i in range(len(words) - window + 1):
            if tuple(words[i : i + window]) in starts:
                gone.update(range(i, i + window))
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_substring_dedup(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4)
    passage = [word() for _ in range(90)]
    rows = []
    for i in range(40):
        words = [word() for _ in range(rng.randrange(0, 160))]
        if i % 2:
            a, n = rng.randrange(0, 45), rng.randrange(40, 60)
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = passage[a : a + n]
        rows.append((i, " \t".join(words), "s"))
    long = " ".join(f"w{i}" for i in range(3000))
    rows += [(50, None, "s"), (51, "", "s"), (52, " \n", "s"), (53, rows[7][1], "s"), (54, rows[7][1] + " end", "s"), (None, rows[7][1], "s"), (55, long, None), (56, "x " + long, "s"), (57, long, "s"), (57, long, "s"), (57, rows[9][1], "s")]
    got = sorted(map(tuple, substring_dedup(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted(cut(rows), key=str)


# --- line dedup


def keep_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    first = {}
    for doc_id, text, _ in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 10:
                first.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(first.get(key(x), ())) < 2 or doc_id == min(first[key(x)])]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [f"a line of number {i}" for i in range(12)] + ["short", "", "  A LINE OF NUMBER 3\t", "ÄÖ line number x", "äö line number x"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))), "s") for i in range(40)]
    rows += [(60, None, "s"), (61, "", "s"), (62, "\n" * 200 + "a line of number 1", "s"), (63, rows[0][1], "s"), (63, rows[1][1], None), (63, rows[1][1], None), (None, rows[0][1], "s"), (64, "\n".join(pool * 30), "s")]
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup(docs_of(spark, rows)).filter("doc_id is not null").collect())
    want = sorted(r for r in keep_lines(rows) if r[0] is not None)
    assert got == want
    assert line_dedup(docs_of(spark, rows)).filter("doc_id is null").first()["kept_text"] == rows[0][1]


# --- near duplicates


def groups(rows, words, percent):
    sets = []
    for _, text, _ in rows:
        w = WORD.findall(lower(text or ""))
        n = min(words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and k and 100 * k >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    smallest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[root(i)] = min(smallest.get(root(i), r[0]), r[0])
    return sorted((r[0], len(s), smallest[root(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)) if r[0] is not None)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rng = random.Random(words)
    rows = []
    base = [f"t{rng.randrange(400)}" for _ in range(60)]
    for i in range(260):  # one group larger than a block, its members edited by differing amounts
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "s"))
    for i in range(300, 360):
        rows.append((i, " ".join(f"t{rng.randrange(400)}" for _ in range(rng.randrange(0, 40))), "s"))
    rows += [(400, None, "s"), (401, "", "s"), (402, "One", "s"), (403, "one", "s"), (404, rows[270][1], "s"), (405, "a b", "s"), (406, "a b c d e f", "s"), (None, rows[0][1], "s"), (407, rows[3][1], "s"), (407, rows[3][1], "s")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs_of(spark, rows), words=words).filter("doc_id is not null").collect())
    assert got == groups(rows, words, 80)
    kept = near_duplicates(docs_of(spark, rows[-2:] + rows[-4:-2]), words=words).filter("doc_id is null").first()
    assert kept["kept"] and kept["component_id"] is None


def test_texts_of_one_id_are_judged_apart(spark):
    """Of two texts of an id one is a near copy of another document and the other like nothing, whichever comes first."""
    rng = random.Random(11)
    rows = []
    for i in range(0, 120, 3):
        a, b = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2))
        rows += [(i, " ".join([*a, "end"]), "s"), (i + 1, " ".join(a), "s"), (i + 1, " ".join(b), "s")]
    rng.shuffle(rows)
    out = near_duplicates(docs_of(spark, rows), words=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == groups(rows, 2, 80)
    assert sum(r["kept"] for r in out) == 80


# --- mixing


def test_mixing(spark):
    rng = random.Random(1)
    sizes = {"a": 4000, "b": 300, "c": 50, None: 900, "empty": 0}
    rows = []
    for source, total in sizes.items():
        left = total
        while left > 0:
            n = min(left, rng.randrange(1, 60))
            rows.append((len(rows), " ".join(["w"] * n), source))
            left -= n
    rows += [(9000, None, "empty"), (9001, "", "empty"), (None, "x y", "a"), (9002, "one two three", "b"), (9002, "one two three", "b")]
    out = mix_sources(docs_of(spark, rows), carry=("row_hash",)).collect()
    assert len(out) == len(rows)
    total = {}
    for _, text, source in rows:
        total[source] = total.get(source, 0) + len(WORD.findall(text or ""))
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    taken = {}
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == total[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    again = mix_sources(docs_of(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in out)


# --- urls


def test_url_filter(spark):
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("b.net/", "allow"), (None, "block"), ("a.org", "block"), ("x.org/p", "allow"), ("x.org/p", "block")]
    urls = ["http://www.Example.com/en/7?x", "https://q.com/en/", "https://q.com/EN/", "http://xcom/en/", "com/en/", None, "", "http://a.b.net/de/1", "http://c.net/de/1#y", "ftp://a.org", "x://sub.a.org?z", "http://x.org/pq", "http://", "http://.com/en/", "://com/en/x", "http://a\nb.com/en/"]
    urls += ["http://q.com/en/"] * 3 + ["http://" + "a." * 500 + "com/en/" + "p" * 5000]
    pages = spark.createDataFrame([(i if i != 2 else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = sorted((r["page_id"] if r["page_id"] is not None else 2, r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect())
    want = []
    listed = {}
    for rule, verdict in rules:
        if rule:
            listed[rule] = max(listed.get(rule, ""), verdict)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = []
        for rule in listed:
            h, _, p = rule.partition("/")
            p = rule[len(h) :]
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                fits.append((len(rule), len(h), rule))
        rule = max(fits)[2] if fits else None
        want.append((i, host, path, rule, listed[rule] if rule else "allow"))
    assert got == want


def test_url_query_has_the_rules_of_its_contract(spark, tmp_path):
    """Each rule alone, and the longer rule against the shorter one that says otherwise."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"),
        "http://www.example.com/en/71": ("example.com/en/7", "allow"),
        "http://example.com/en/1": ("com/en/", "block"),
        "http://a.net/de/1": ("net/de/", "allow"),
        "http://example.net/de/1": ("net/de/", "allow"),
        "http://www.example.net/de/81": ("example.net/de/8", "block"),
        "http://a.org/es/": ("org/es/", "block"),
        "http://a.net/en/1": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op3_url_filter(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


# --- toxicity


def test_interactions_are_learned():
    """A pair weighs more than its terms: either alone is clean, both together are toxic."""
    rng = random.Random(0)
    rows, labels = [], []
    for _ in range(1200):
        terms = {f"n{rng.randrange(50)}" for _ in range(8)} | ({"insult"} if rng.random() < 0.4 else set()) | ({"group"} if rng.random() < 0.4 else set())
        rows.append(hashed_terms(" ".join(t.replace("n", "n" * (1 + int(t[1:]))) if t[0] == "n" else t for t in terms)))
        labels.append(float({"insult", "group"} <= terms))
    import numpy as np

    model = FactorizationMachine.fit(rows[:1000], np.array(labels[:1000]), epochs=30)
    right = sum((model.score(r) >= 0.5) == bool(y) for r, y in zip(rows[1000:], labels[1000:], strict=True))
    assert right >= 195


def test_terms_without_an_effect_alone_are_learned():
    """Insult and group each stand as often in toxic rows as in clean ones; only the pair tells."""
    import numpy as np

    rng = random.Random(3)
    rows, labels = [], []
    for _ in range(1500):
        two = [w for w in ("insult", "group") if rng.random() < 0.5]
        rows.append(hashed_terms(" ".join(["n" * (1 + rng.randrange(50)) for _ in range(8)] + two)))
        labels.append(float(len(two) != 1))
    model = FactorizationMachine.fit(rows[:1000], np.array(labels[:1000]))
    right = sum((model.score(r) >= 0.5) == bool(y) for r, y in zip(rows[1000:], labels[1000:], strict=True))
    assert right >= 490


def test_no_number_of_frequent_terms_hides_a_pair():
    """Thousands of more frequent terms do not keep a rare pair, or a rare insult, out of the model."""
    import numpy as np

    rng = random.Random(5)
    noise = [f"noise{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(4000)]
    rows, labels = [], []
    for _ in range(3000):
        own = {w for w in ("rarely", "seldom") if rng.random() < 0.15} | ({"scoundrel"} if rng.random() < 0.02 else set())
        rows.append(hashed_terms(" ".join([*rng.sample(noise, 150), *own])))
        labels.append(float({"rarely", "seldom"} <= own or "scoundrel" in own))
    model = FactorizationMachine.fit(rows[:2000], np.array(labels[:2000]))
    right = [(model.score(r) >= 0.5) == bool(y) for r, y in zip(rows[2000:], labels[2000:], strict=True)]
    assert sum(right) >= 990 and sum(r for r, y in zip(right, labels[2000:], strict=True) if y) >= 0.85 * sum(labels[2000:])


def test_scores_are_the_pairwise_sum(spark):
    """The scores of a query are recomputed term by term and pair by pair."""
    import math
    import zlib

    rng = random.Random(4)
    words = ["scum", "idiot", "they", "them", *(f"w{c}" for c in "abcdefghij")]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(300)] + ["", None, "scum " * 5000]
    docs = spark.createDataFrame([(i, t, 0.5, "p", True) for i, t in enumerate(texts)], "doc_id long, text string, score double, predicted string, held_out boolean")
    labels = spark.createDataFrame([(i, int("scum" in t or ("idiot" in t and "they" in t))) for i, t in enumerate(texts[:300])], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    weight = {int(k): (float(w), v) for k, w, v in zip(model.keys, model.w, model.v, strict=True)}
    out = toxicity(docs, model).collect()
    assert len(out) == len(texts)
    for r in out:
        found = {zlib.crc32(w.encode()) % BUCKETS for w in (texts[r["doc_id"]] or "").split()}
        terms = [weight[h] for h in sorted(found) if h in weight]
        z = model.bias + sum(w for w, _ in terms) + sum(float(a[1] @ b[1]) for i, a in enumerate(terms) for b in terms[:i])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5)


def test_one_text_of_a_labelled_id_is_learned(spark):
    """However often a labelled id is repeated, the driver reads one row of it."""
    docs = spark.createDataFrame([(i % 4 + 1, f"word{i % 3} bad") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, toxic int")
    seen = []
    original = FactorizationMachine.fit
    FactorizationMachine.fit = lambda rows, marks, **o: seen.append(len(rows)) or original(rows, marks, **o)
    try:
        fit_toxicity(docs, labels)
    finally:
        FactorizationMachine.fit = original
    assert seen[0] <= 4


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        words = [f"w{'abcdefghij'[rng.randrange(10)]}{'xyz'[rng.randrange(3)]}" for _ in range(20)]
        if bad:
            words[rng.randrange(20)] = rng.choice(["Scum!", "idiot,", "trash"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(bad)))
    rows += [(900, None, "s"), (901, "", "s"), (None, "idiot", "s"), (902, "clean " * 20000 + "scum", "s"), (5, rows[5][1], "s")]
    labels += [(None, 1), (3, None), (77_777, 1)]
    docs, marks = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, marks)
    out = toxicity(docs, model, carry=("text", "source")).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held) >= 0.95 * len(held)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[902]["predicted"] == 1 and by_id[900]["predicted"] == 0 and by_id[900]["score"] == by_id[901]["score"]


# --- no rows at all


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    assert substring_dedup(docs).count() == line_dedup(docs).count() == near_duplicates(docs).count() == mix_sources(docs).count() == 0
    none = fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity(docs, none).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    no_rules = spark.createDataFrame([], "rule string, verdict string")
    assert url_filter(pages.limit(0), no_rules).count() == 0 and url_filter(pages, no_rules).first()["verdict"] == "allow"




def test_near_duplicate_recall(spark):
    """Of hundreds of thousands of links near the threshold, all linked documents come together, also those with few links.

    Half of the group is a chain in which each document resembles only the next
    ones at about 0.8, half a cloud of one text with words replaced.
    """
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    text = list(base)
    for _ in range(400):  # the chain
        at = rng.randrange(len(text))
        text = [*text[:at], *(rng.choice(words) for _ in range(4)), *text[at + 4 :]]
        texts.append(" ".join(text))
    for _ in range(500):  # the cloud
        text = list(base)
        for _ in range(rng.randrange(1, 9)):
            text[rng.randrange(len(text))] = rng.choice(words)
        texts.append(" ".join(text))
    rng.shuffle(texts)
    sets = [frozenset(zip(w, w[1:], strict=False)) for w in (t.split() for t in texts)]
    up, links, degree = list(range(len(texts))), [], [0] * len(texts)

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                links.append((i, j))
                degree[i] += 1
                degree[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, words=2).collect()}
    together = sum(got[i] == got[j] for i, j in links)
    few = [(i, j) for i, j in links if min(degree[i], degree[j]) <= 3]
    print(f"{len(links)} links, recall {together / len(links):.4f}, of {len(few)} links of documents with three or fewer {sum(got[i] == got[j] for i, j in few) / max(1, len(few)):.4f}")
    assert len(links) > 30_000 and together >= 0.999 * len(links)
    assert sum(got[i] == got[j] for i, j in few) >= 0.99 * len(few)
    # and nothing apart from these links
    assert all(root(i) == root(got[i]) for i in got)


def test_staged_tables_can_be_cleared(spark):
    """What a lazy result reads stays until the caller is done with it, and goes then."""
    from aerolens.llm.common import clear_staged, staged

    clear_staged(spark)
    rows = staged(spark.range(1000), "rows")
    assert rows.count() == 1000
    files = rows.inputFiles()
    assert clear_staged(spark) == 1 and clear_staged(spark) == 0
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
