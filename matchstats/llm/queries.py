"""The corpus operators as queries over whole tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchstats.llm import bpe, decontaminate, fingerprints, hard_negatives, licenses, ngram_join, spelling, substring_dedup, suffix_dedup, token_files, toxicity, url_filter, warc

#: Fixed values of the URL query.
URL_RULES = [
    url_filter.Rule("org/", "allow"),
    url_filter.Rule("example.org/es/", "block"),
    url_filter.Rule("example.org/en/1", "block"),
    url_filter.Rule("com/fr/", "allow"),
    url_filter.Rule("com/de/", "block"),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"), min_bytes=0)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed(read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.whole_vectors(read(spark, sf_dir, "embeddings"))
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_byte_bpe, op3_ngram_join, op4_fingerprints, op5_substring_dedup, op6_token_files, op7_toxicity, op8_decontamination, op9_licenses, op10_url_filter, op11_spelling_variants, op12_hard_negatives, op13_suffix_dedup)}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {shift}) & 31)::BIGINT + 1, 1)"
    for g in range(8)
    for shift in (15, 10, 5, 0)
)

SQL = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM m""",
    "op3_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE m >= 0.8 * (x.n + y.n - m)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT b, root FROM r JOIN p ON a = r.doc_id),
k AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id)
SELECT doc_id, class_id, (SELECT count(*) FROM p WHERE a = k.doc_id) AS n_links FROM k""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
low AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s),
gone AS (SELECT DISTINCT r, j FROM win JOIN low USING (s), unnest(range(i, i + 13)) AS t(j) WHERE low < doc_id),
marks AS (SELECT r, list(j) AS js, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE [w[x] FOR x IN range(1, len(w) + 1) IF NOT list_contains(js, x)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN marks USING (r)""",
    "op8_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
m AS (SELECT r, i, bw.k, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM m, unnest(range(i, i + k)) AS t(j) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
    "op10_url_filter": """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rule, rhost, rpath, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM h
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, CASE WHEN starts_with(host || path, 'ads.') OR contains(host || path, '.ads.')
  OR contains(host || path, '/login') OR ends_with(host || path, '.exe') OR ends_with(host || path, '.zip') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN fit USING (page_id)""",
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) AS v FROM range(256) AS r(b))),
runs AS (SELECT doc_id, run, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT run, m, flatten([CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')]) AS bs FROM runs),
hashed AS (SELECT run, m, xor(list_reduce(bs, lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM coded, crc),
words AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(m) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(m) >= 2),
plain AS (SELECT string_agg(chr(CAST(i + 192 AS INTEGER)), '' ORDER BY i) AS letters, string_agg(chr(CAST(i + 32 AS INTEGER)), '' ORDER BY i) AS marks FROM range(64) AS r(i)),
cut AS (SELECT DISTINCT word, n, v FROM (SELECT word, n, unnest([word] || [word[:i] || word[i + 2:] FOR i IN range(length(word))]) AS v FROM words)),
near AS (SELECT DISTINCT x.word, x.n, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.v = y.v AND x.word <> y.word, plain WHERE levenshtein(translate(x.word, letters, marks), translate(y.word, letters, marks)) = 1),
best AS (SELECT word, count(*) AS n_near, first(CASE WHEN near_n >= 10 * n THEN near END ORDER BY near_n DESC, near) AS form, first(CASE WHEN near_n >= 10 * n THEN near_n END ORDER BY near_n DESC, near) AS form_n FROM near GROUP BY word),
path(word, stop, step) AS (SELECT word, word, 0 FROM words UNION ALL SELECT p.word, form, step + 1 FROM path p JOIN best b ON p.stop = b.word WHERE form IS NOT NULL),
ends AS (SELECT word, arg_max(stop, step) AS root FROM path GROUP BY word)
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM words LEFT JOIN best USING (word) JOIN ends USING (word)""",
    "op12_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.r, a.vec_id AS anchor_id, a.label, a.q, b.vec_id AS positive_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS positive_score
  FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r WHERE a.vec_id % 50 = 0
  QUALIFY row_number() OVER (PARTITION BY a.r ORDER BY list_dot_product(a.q, b.q) DESC, b.vec_id) <= 5),
n AS (SELECT p.*, b.vec_id AS negative_id, CAST(list_dot_product(p.q, b.q) AS BIGINT) AS negative_score FROM p JOIN v b ON p.label <> b.label
  WHERE 50 * positive_score <= 100 * CAST(list_dot_product(p.q, b.q) AS BIGINT) AND 100 * CAST(list_dot_product(p.q, b.q) AS BIGINT) <= 95 * positive_score),
k AS (SELECT *, row_number() OVER (PARTITION BY r, positive_id ORDER BY negative_score DESC, negative_id) AS rank FROM n)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM k WHERE rank <= 3""",
}
