"""The corpus operators over the standard tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm import mixing, order_minhash, pii, simhash, sp_sampling, token_codec, token_counts, topk, toxicity, url_filter
from ruleloom.llm.common import read_table


#: Session setting that holds the secret of pseudonyms; without it the standard query uses a public one.
PSEUDONYM_KEY = "spark.ruleloom.pseudonyms.key"


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get(PSEUDONYM_KEY, "public key of the standard query")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.every_limit(token_counts.length_histogram(read_table(spark, sf_dir, "documents")))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.token_ids(read_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(read_table(spark, sf_dir, "documents"), pseudonym_key(spark))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_sampling.sampled_pieces(read_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_order_minhash, op3_length_histogram, op4_token_ids, op5_simhash, op6_url_filter, op7_pseudonyms, op8_sampled_pieces, op9_mixing, op10_inner_products)}


#: Dot segments of link targets aren't resolved here.
OP6_SQL = """
WITH RECURSIVE rules(verdict, rhost, rpath) AS (VALUES ('allow','org','/'),('block','example.org','/es/'),('block','example.org','/en/1'),('allow','com','/fr/'),('block','com','/de/')),
page AS (SELECT page_id, html, url, regexp_replace(url, '#.*', '', 's') AS u FROM pages),
parsed AS (SELECT page_id, html, u, url, CASE WHEN contains(u, '://') THEN lower(regexp_extract(u, '^(.*?://[^/?]*)', 1, 's')) || regexp_extract(u, '^.*?://[^/?]*(.*)$', 1, 's') ELSE u END AS address FROM page),
tags AS (SELECT u, address, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*>')) AS tag, 'canonical' AS kind FROM parsed
  UNION ALL SELECT u, address, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')), 'refresh' FROM parsed),
targets AS (SELECT u, address, regexp_replace(regexp_replace(regexp_extract(tag, CASE kind WHEN 'canonical' THEN '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)'
    ELSE '(?is)\\bcontent\\s*=\\s*["'']?[^"''>;]*;\\s*url\\s*=\\s*["'']?([^"''\\s>]+)' END, 1), '&(amp|#38|#x26);', '&', 'gi'), '#.*', '', 's') AS t,
    regexp_extract(u, '^(.*?)://', 1, 's') AS scheme, regexp_extract(u, '^(.*?://[^/?]*)', 1, 's') AS site, regexp_extract(u, '^.*?://[^/?]*([^?]*)', 1, 's') AS path
  FROM tags WHERE u IS NOT NULL AND regexp_matches(tag, CASE kind WHEN 'canonical' THEN '(?is)\\brel\\s*=\\s*["'']?canonical\\b' ELSE '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b' END)),
resolved AS (SELECT address AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN NOT contains(u, '://') OR t = '' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN site || t WHEN starts_with(t, '?') THEN site || path || t
    ELSE site || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)', 1, 's') ELSE '/' END || t END AS b FROM targets),
straight AS (SELECT a, lower(regexp_extract(b, '^(.*?://[^/?]*)', 1, 's')) || regexp_extract(b, '^.*?://[^/?]*(.*)$', 1, 's') AS b FROM resolved WHERE b IS NOT NULL),
links AS (SELECT a, b FROM straight UNION SELECT b, a FROM straight),
asked AS (SELECT page_id, address, url, true AS is_page FROM parsed UNION ALL SELECT NULL, a, a, false FROM links),
hosted AS (SELECT page_id, address, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path, row_number() OVER () AS n, is_page FROM asked),
own AS (SELECT p.n, p.page_id, p.address, p.host, p.path, p.is_page, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM hosted p LEFT JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY ALL),
tainted(address) AS (SELECT address FROM own WHERE verdict = 'block' AND address IN (SELECT a FROM links) UNION SELECT l.b FROM tainted t JOIN links l ON t.address = l.a)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN address IN (SELECT address FROM tainted) THEN 'block' ELSE 'allow' END) AS verdict FROM own WHERE is_page
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS rows,
  (CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS room, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS goal FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY room / weight, source IS NULL, encode(source)) AS n FROM r),
l AS (SELECT *, (goal - coalesce(sum(room) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
o AS (SELECT min(n) FILTER (level * weight <= room) AS first_open FROM l),
t AS (SELECT l.*, CASE WHEN n >= first_open THEN least(room, (SELECT level FROM l JOIN o ON n = first_open) * weight) ELSE room END AS target FROM l, o),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
x AS (SELECT d.doc_id, d.size, q.source_size, q.rows, q.target, q.source, floor(q.rate)::BIGINT AS whole, q.rate - floor(q.rate) AS p, q.target - floor(q.rate) * q.source_size AS rest,
  (('0x' || md5(coalesce(d.doc_id::VARCHAR, '') || '|' || md5(coalesce(d.text, '')))[1:13])::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
odds AS (SELECT *, (u / (1 - u)) / ((p / (1 - p)) * (greatest(size, 1) / (source_size / rows))) AS ratio FROM x WHERE p > 0 AND p < 1),
ranked AS (SELECT *, floor(ratio / (1 + ratio) * 4503599627370496.0::DOUBLE)::BIGINT AS place FROM odds),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place) AS upto, sum(size) OVER (PARTITION BY source, place) AS here FROM ranked)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN upto - here / 2.0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM summed
UNION ALL SELECT doc_id, size, source_size, target, (whole * size)::BIGINT FROM x WHERE NOT (p > 0 AND p < 1)
"""

OP10_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op9_mixing": OP9_SQL, "op10_inner_products": OP10_SQL}
