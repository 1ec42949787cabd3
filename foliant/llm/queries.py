"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bisectors, fim, license_scan, media, mixing, packing, parity_join, pii, quality, sharding, simhash, token_count, url_filter
from .common import new_path, table

#: The rules of the url query: (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
TOKEN_LIMIT, CAPACITY, SHARDS, WEIGHTS = 1024, 4096, 8, [5, 2, 1]
SHARD_DIMENSIONS = ["source", "lang", "n_chars", "doc_id"]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query's cache starts empty, in a new folder; a job would name the folder that it keeps."""
    counted = token_count.count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "token-cache"), tokenizer("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), CAPACITY)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the NPY tile its size and digest."""
    found = media.media_features(media.text_media(table(spark, sf_dir, "documents")))
    return found.withColumns({"tile_bytes": F.octet_length("tile").cast("long"), "tile_sha256": F.sha2("tile", 256)}).drop("tile")


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.kd_shards(table(spark, sf_dir, "documents"), SHARD_DIMENSIONS, shards=SHARDS)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents"), F.col("doc_id"))
    return judged.select(F.col("_k0").alias("doc_id"), *quality.STATS, "base_failed", "kept")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link_fingerprints(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[F.col(f"_{k}") for k in pii.BASE_KINDS])
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_string(base), 256).alias("base_sha256"), pii.span_string(F.col("spans")).alias("spans"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.keyed(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    mixed = mixing.take(docs, WEIGHTS)
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisectors.cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1, dimensions=64, scale=64)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output itself is left out, after the text has been restored from it."""
    made = fim.to_middle(table(spark, sf_dir, "documents"), seed=1)
    return fim.from_middle(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.join_near(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_token_counts, op3_best_fit_packing, op4_media_columns, op5_kd_sharding, op6_quality_rules, op7_simhash_dedup, op8_pii, op9_license_scan, op10_source_mixing, op11_centroid_clustering, op12_fill_in_middle, op13_ngram_join)}

ORACLE_SQL = {
    "op1_url_filter": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
judged AS (
  SELECT p.*, (SELECT max_by(r, length(r.rhost || r.rpath)) FROM rules r
               WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) AS best FROM parts p)
SELECT page_id, host, path, best.rhost || best.rpath AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
""",
    "op10_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', '42', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::BIGINT AS weight, 3 * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS others,
        sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
        sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, max((total - others)::DOUBLE / weights::DOUBLE) OVER () AS level FROM c),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target,
        CASE WHEN source_size > 0 THEN floor(least(cap::DOUBLE, weight * level) / source_size) ELSE 1 END AS epochs FROM l),
r AS (SELECT d.*, t.source_size, t.target, t.epochs,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((epochs + CASE WHEN epochs < 3 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
""",
    "op11_centroid_clustering": """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS cluster, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 16)),
a0 AS MATERIALIZED (SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
  SELECT k.rid, k.vec_id, k.v, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT AS d FROM kept k, c0 c) GROUP BY rid, vec_id, v),
m0 AS (SELECT cluster, list(s ORDER BY i) AS v FROM (SELECT cluster, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS s FROM a0, range(1, 65) r(i) GROUP BY cluster, i) GROUP BY cluster),
c1 AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c0 c LEFT JOIN m0 m USING (cluster)),
a1 AS MATERIALIZED (SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
  SELECT k.rid, k.vec_id, k.v, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT AS d FROM kept k, c1 c) GROUP BY rid, vec_id, v),
m1 AS (SELECT cluster, list(s ORDER BY i) AS v FROM (SELECT cluster, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS s FROM a1, range(1, 65) r(i) GROUP BY cluster, i) GROUP BY cluster),
c2 AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c1 c LEFT JOIN m1 m USING (cluster)),
a2 AS MATERIALIZED (SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
  SELECT k.rid, k.vec_id, k.v, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT AS d FROM kept k, c2 c) GROUP BY rid, vec_id, v),
m2 AS (SELECT cluster, list(s ORDER BY i) AS v FROM (SELECT cluster, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS s FROM a2, range(1, 65) r(i) GROUP BY cluster, i) GROUP BY cluster),
c3 AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c2 c LEFT JOIN m2 m USING (cluster)),
a3 AS MATERIALIZED (SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
  SELECT k.rid, k.vec_id, k.v, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT AS d FROM kept k, c3 c) GROUP BY rid, vec_id, v)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 c USING (cluster)
""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS two,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS three, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS four FROM d),
cuts AS (
  SELECT doc_id, t, n, least(one, two) AS a, greatest(one, two) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR three >= 90 THEN 'plain' WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
""",
    "op13_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS grams FROM w),
named AS MATERIALIZED (SELECT doc_id, len(grams)::BIGINT AS n, sha256(array_to_string(list_sort(grams), chr(10))) AS digest FROM s WHERE len(grams) > 0),
classes AS MATERIALIZED (SELECT digest, min(doc_id) AS least, any_value(n) AS n FROM named GROUP BY digest),
g AS MATERIALIZED (SELECT c.digest, c.n, hash(unnest(s.grams)) AS gram FROM classes c JOIN s ON s.doc_id = c.least),
links AS MATERIALIZED (
  SELECT a.digest AS x, b.digest AS y FROM g a JOIN g b ON a.gram = b.gram AND a.digest < b.digest AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.digest, b.digest, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(digest, other) AS (SELECT digest, digest FROM classes UNION SELECT r.digest, e.y FROM reached r JOIN both_ways e ON e.x = r.other),
parts AS (SELECT r.digest, min(c.least) AS component_id FROM reached r JOIN classes c ON c.digest = r.other GROUP BY r.digest)
SELECT doc_id, n AS n_shingles, component_id FROM named JOIN parts USING (digest)
UNION ALL SELECT doc_id, 0::BIGINT, doc_id FROM s WHERE len(grams) = 0
""",
}
