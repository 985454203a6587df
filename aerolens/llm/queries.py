"""The queries opN_<name> with production parameters, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .collocations import collocations
from .lexical_search import lexical_search
from .line_dedup import line_dedup
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack_documents
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .token_shards import read_token_shards, write_token_shards
from .toxicity import fit_toxicity, toxicity
from .url_filter import url_filter
from .vector_dedup import vector_near_duplicates

#: File name of the tokenizer in the folder of public tokenizers.
TOKENIZER = "byte_bpe_50k.json"

#: Fixed by the contract of op3.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the public tokenizer file lies on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter(_table(spark, sf_dir, "pages"), rules)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_shards(write_token_shards(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_url_filter": op3_url_filter,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_line_dedup": op6_line_dedup,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_token_shards": op8_token_shards,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_toxicity": op10_toxicity,
    "op11_token_counts": op11_token_counts,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS lo FROM k GROUP BY k),
s AS (SELECT doc_id, i FROM k JOIN f USING (k) WHERE doc_id > lo),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
c AS (
  SELECT x.doc_id, x.i, word,
         coalesce(max(CASE WHEN s.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS 49 PRECEDING), 0) AS gone
  FROM x LEFT JOIN s ON x.doc_id = s.doc_id AND x.i = s.i)
SELECT d.doc_id, count(c.i) AS n_words, count(*) FILTER (WHERE gone = 1) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY c.i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op7_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r(id, c) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.c) AS component_id, e.vec_id = min(r.c) AS kept
FROM embeddings e JOIN r ON r.id = e.vec_id GROUP BY e.vec_id
""",
    "op4_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
""",
    "op3_url_filter": rf"""
WITH rules(rule, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'block'), ('example.net/de/8', 'block'), ('org/es/', 'block')),
r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, length(split_part(rule, '/', 1)) + 1) AS p FROM rules),
u AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), {_AZ}) AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
m AS (
  SELECT n, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (n)
""",
    "op5_mix_sources": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('mix:', CAST(doc_id AS VARCHAR))) AS nth
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ([3.0, 1.0, 2.0])[1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS weight
  FROM d GROUP BY source),
w AS (  -- one step caps every source that is above its limit and shares the rest anew
  SELECT 0 AS step, source, source_size, weight, FALSE AS capped FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight,
         capped OR weight * (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (WHERE capped) OVER (), 0))::DOUBLE
                   / nullif(sum(weight) FILTER (WHERE NOT capped) OVER (), 0) >= 2.0 * source_size
  FROM w WHERE step < 200),
last AS (SELECT * FROM w WHERE step = 200),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN 2.0::DOUBLE * source_size
              ELSE weight * (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (WHERE capped) OVER (), 0))::DOUBLE
                   / sum(weight) FILTER (WHERE NOT capped) OVER () END AS target
  FROM last),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS part FROM p),
x AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.part,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.nth, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(size, greatest(0, part - (upto - size))) AS BIGINT) AS taken
FROM x
""",
    "op6_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, n, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), {_AZ}) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents)),
f AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, f.first_doc IS NOT NULL AND doc_id > f.first_doc AS gone FROM l LEFT JOIN f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op12_lexical_search": rf"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id,
         coalesce(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM t),
x AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM t),
c AS (SELECT row, doc_id, n, term, count(*) AS tf FROM x GROUP BY ALL),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
f AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM c, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
m AS (
  SELECT item_id, row, doc_id,
         CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN c USING (term), s GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM m WHERE score > 0 QUALIFY rank <= 20
""",
    "op13_collocations": rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, w
  FROM (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, {_AZ}), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents)
  WHERE len(w) > 0),
s AS (SELECT lang, w[i:i + 4] AS w FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p)),
g AS (
  SELECT lang, k, array_to_string(w[1:k], ' ') AS phrase, count(*) AS f
  FROM s, (VALUES (1), (2), (3), (4), (5)) AS sizes(k) WHERE len(w) >= k GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
v AS (
  SELECT cuts.lang, cuts.phrase, cuts.w, cuts.a, cut, x.f AS l, y.f AS r, n.n,
         (1000::HUGEINT * a::HUGEINT * n.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN g y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:], ' ') JOIN n ON n.lang = cuts.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM v),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3), (4)) AS sizes(m) WHERE m < k)
  GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank,
       b.phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 100 * a) QUALIFY rank <= 2000
""",
}
