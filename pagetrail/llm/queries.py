"""The operators' queries: each applies one to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm import clusters, decontam, embedding, langid, license, lm, packing, quality, simhash, substring, urlfilter, variants, warc
from pagetrail.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", "removed_words", "text")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embedding_components(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_scores(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_language_id(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


#: A run loses a letter if this divides its hash.
DELETE_EVERY = 199


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"), DELETE_EVERY)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centroid_clusters(table(spark, sf_dir, "embeddings"))


#: Every vector pair of a label, in double precision, and reachability by recursion.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach(id, root) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b
)
SELECT v.vec_id, COALESCE(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT a, COUNT(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
JOIN (SELECT id, MIN(root) AS component_id FROM reach GROUP BY id) c ON c.id = v.vec_id
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH b AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, LEAST(13, len(w)) AS n, UNNEST(range(1, len(w) - LEAST(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, COALESCE({_WORDS}, []) AS w FROM documents
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, UNNEST(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.g = dw.g
), words AS (
  SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, UNNEST(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
  sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op8_sql() -> str:
    phrases = [(p.split(), label) for p, label in license.PHRASES]
    keys = [(k.split(), t.split(), label) for label, t, k in license.TEMPLATES]
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    at = lambda ws: f"list_filter(range(1, CAST(len(w) - {len(ws)} + 2 AS BIGINT)), lambda i: w[i:i + {len(ws) - 1}] = {quoted(ws)})"
    shares = []
    for k, (key, full, _) in enumerate(keys):
        shift = max(i for i in range(len(full)) if full[i : i + len(key)] == key)
        same = " + ".join(f"(CASE WHEN i - {shift} + {j} >= 1 AND w[i - {shift} + {j}] = '{x}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for j, x in enumerate(full))
        shares.append(f"COALESCE(list_max(list_transform(t{k}, lambda i: ({same}) / {float(len(full))}::DOUBLE)), 0.0)")
    label = lambda k, name, x: f"CASE WHEN len({x}{k}) > 0 THEN '{name}' END"
    base = "[" + ", ".join(label(k, n, "p") for k, (_, n) in enumerate(phrases)) + "]"
    more = "[" + ", ".join([label(k, n, "p") for k, (_, n) in enumerate(phrases)] + [label(k, n, "t") for k, (_, _, n) in enumerate(keys)]) + "]"
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda e: e IS NOT NULL))), ',')"
    every = "list_concat(" * (len(phrases) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(phrases)))
    return f"""
WITH d AS (SELECT doc_id, COALESCE({_WORDS}, []) AS w FROM documents),
f AS (SELECT doc_id, w, {", ".join([f"{at(p)} AS p{k}" for k, (p, _) in enumerate(phrases)] + [f"{at(key)} AS t{k}" for k, (key, _, _) in enumerate(keys)])} FROM d),
g AS (SELECT *, {every} AS a FROM f)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(a) AS BIGINT) AS n_base, list_min(a) - 1 AS first_word, list_max(a) - 1 AS last_word,
  {joined(base)} AS base_labels, {joined(more)} AS labels, GREATEST(CASE WHEN len(a) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, {", ".join(shares)}) AS score
FROM g
"""


OP11_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS payload_bytes, sha256(COALESCE(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, MIN(page_id) AS first FROM p WHERE payload_bytes >= {warc.LEAST_SHARED} GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

#: crc32 by its table of 256 remainders; near words through patterns with one letter left out.
OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, w, COUNT(*) AS n
  FROM (SELECT doc_id, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents)
  WHERE length(w) >= {variants.LEAST_LENGTH} GROUP BY doc_id, w
), hashed AS (
  SELECT w, n, xor(list_reduce(list_concat([4294967295], list_transform(string_split(regexp_replace(hex(encode(doc_id::VARCHAR || ':' || w)), '(..)', '\\1,', 'g'), ',')[:-2], lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) AS h
  FROM runs, crc
), words AS (
  SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {DELETE_EVERY} = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= {variants.LEAST_LENGTH} GROUP BY word HAVING SUM(n) >= {variants.LEAST_COUNT}
), cut AS (
  SELECT word, n, i, word[:i - 1] AS a, word[i + 1:] AS b FROM (SELECT word, n, UNNEST(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word, y.word AS other, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.a || x.b = y.word
), best AS (
  SELECT word, COUNT(*) AS n_near, first(other ORDER BY n DESC, other) AS form, MAX(n) AS form_n FROM near GROUP BY word
), forms AS (
  SELECT word, w.n, COALESCE(n_near, 0) AS n_near, CASE WHEN form_n >= {variants.RATIO} * w.n THEN form END AS form, CASE WHEN form_n >= {variants.RATIO} * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL
  SELECT k.word, f.form, step + 1 FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


def _op13_sql() -> str:
    far = "SUM((v.x - c.x) * (v.x - c.x))"
    steps = []
    for k in range(clusters.ROUNDS + 1):
        steps.append(f"""d{k} AS MATERIALIZED (
  SELECT v.r, c.cluster, CAST({far} AS BIGINT) AS distance FROM v JOIN c{k} c USING (i) GROUP BY v.r, c.cluster
), a{k} AS MATERIALIZED (
  SELECT r, first(cluster ORDER BY distance, cluster) AS cluster, MIN(distance) AS distance FROM d{k} GROUP BY r
)""")
        if k < clusters.ROUNDS:
            steps.append(f"""s{k} AS (
  SELECT cluster, i, CAST(SUM(x) AS BIGINT) AS s, COUNT(*) AS n FROM a{k} JOIN v USING (r) GROUP BY cluster, i
), c{k + 1} AS MATERIALIZED (
  SELECT c.cluster, c.i, COALESCE((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{k} c LEFT JOIN s{k} USING (cluster, i)
)""")
    last = clusters.ROUNDS
    return f"""
WITH e AS (
  SELECT vec_id, embedding, row_number() OVER (ORDER BY sha256('{clusters.SEED}:' || vec_id)) - 1 AS r FROM embeddings
  WHERE len(embedding) = {clusters.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), v AS MATERIALIZED (
  SELECT r, UNNEST(range(1, {clusters.DIMENSIONS} + 1)) AS i, CAST(floor({clusters.SCALE} * CAST(UNNEST(embedding) AS DOUBLE)) AS BIGINT) AS x FROM e
), c0 AS MATERIALIZED (
  SELECT r AS cluster, i, x FROM v WHERE r < {clusters.CLUSTERS}
), {", ".join(steps)}, h AS (
  SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY cluster
)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(SUM(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(SUM(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{last} JOIN e USING (r) JOIN h USING (cluster)
"""


_OPERATORS = (
    op1_substring_dedup,
    op2_url_filter,
    op3_embedding_near_dedup,
    op4_best_fit_packing,
    op5_lm_scoring,
    op6_simhash,
    op7_decontamination,
    op8_license_scan,
    op9_quality,
    op10_language_id,
    op11_warc,
    op12_spelling_variants,
    op13_centroid_clusters,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES = {"op3_embedding_near_dedup": OP3_SQL, "op7_decontamination": OP7_SQL, "op8_license_scan": _op8_sql(), "op11_warc": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_centroid_clusters": _op13_sql()}
