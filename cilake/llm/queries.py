"""Registered queries of the training-data operators, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cilake.llm import (
    bpe, exact, importance, infill, knn, langid, licenses, mixing, quality, shards, simhash, toxicity, urlfilter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.tiktoken"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn.knn_join(rows.filter("vec_id % 50 = 0"), rows, 5, factor=256.0)


ORACLES["op1_voronoi_knn"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p) WHERE k <= 5
"""


@query
def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.shard(shards.measured(docs).drop("text"), 40)


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "expressions", "places")


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.digest(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, chain).drop("text")


#: The block list of the url query: addresses of pages whose markup holds one of these words.
LISTED_WORDS = "|".join(w for words in toxicity.SEEDS.values() for w in words)


@query
def op6_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), F.col("html").rlike(LISTED_WORDS))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op6_bloom_cascade"] = f"""
WITH p AS (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
l AS (SELECT DISTINCT host || path AS k FROM h WHERE host <> '' AND regexp_matches(html, '{LISTED_WORDS}')),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host || path IN (SELECT k FROM l) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


@query
def op7_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit_text(table(spark, sf_dir, "documents").select("text", "lang"))
    return langid.identify(table(spark, sf_dir, "pages").select("page_id", "url", "html"), model)


@query
def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_plan(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLES["op9_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source) AS k FROM s),
p AS (SELECT k, 2.0::DOUBLE * source_size / w AS bound,
  (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
   / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM o),
l AS (SELECT level FROM p WHERE level <= bound ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT level FROM l) * w) AS target FROM s),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
  CAST(('0x' || substr(md5('20240:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE
  < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History is the half of the documents with the smaller ids, which came first; the rest arrives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    old = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    return exact.dedup(docs.filter(~old), docs.filter(old))


ORACLES["op11_exact_dedup"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256 FROM h
"""


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = importance.resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 in SQL: the byte table by eight shifts each, then one step a byte.
ORACLES["op12_importance_resampling"] = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
u AS (SELECT k, unnest(words) AS w FROM d),
v AS (SELECT DISTINCT w FROM (SELECT w FROM u UNION ALL SELECT w FROM b)),
c AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, strlen(w)),
  lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT))),
  lambda c, x: xor(c // 256, steps[(xor(c, x) % 256) + 1]))) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM u JOIN c USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN c USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
  / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
x AS (SELECT k, CAST(sum(gain) AS BIGINT) AS weight FROM u JOIN c USING (w) JOIN g USING (bucket) GROUP BY k),
y AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)
   + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN x USING (k)),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
  (count(*) FILTER (WHERE n_features >= 20) OVER ()) * 10 // 100 AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n THEN place END AS rank FROM z
"""


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.restore(infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x,
  regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS units FROM documents),
h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (len(units) + 1) AS a,
  CAST('0x' || substr(x, 9, 8) AS BIGINT) % (len(units) + 1) AS b, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3,
  CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
p AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
   THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(units[1:least(a, b)], ''), '') AS prefix, coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
  coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS suffix FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
