"""Where documents come from: the posts, their metadata and requests, as tables.

The driver's tables hold no shortcode markup, so the registered queries read posts that SQL projects from `documents`
and `labels`. The same text runs in Spark and in DuckDB. Real corpora come in through `read_posts` and `read_files`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTS = "id long, post_title string, post_type string, post_status string, post_date date, post_content string"
POSTMETA = "meta_id long, post_id long, meta_key string, meta_value string"
#: Metadata keys (fixed values of the data).
BACKUP_KEY, BACKUP_DATE_KEY, BUILDER_SNAPSHOT_KEY = "_d2g_divi_backup", "_d2g_backup_date", "_d2g_builder_meta"
BUILDER_KEYS = ("_et_pb_use_builder", "_et_pb_old_content")

POSTS_SQL = """
SELECT doc_id AS id, source || '-' || lang || '-' || CAST(doc_id % 97 AS STRING) AS post_title,
  CASE doc_id % 3 WHEN 0 THEN 'post' WHEN 1 THEN 'page' ELSE 'project' END AS post_type,
  CASE doc_id % 7 WHEN 0 THEN 'trash' WHEN 1 THEN 'private' WHEN 2 THEN 'pending' WHEN 3 THEN 'draft' ELSE 'publish' END AS post_status,
  DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS post_date,
  CASE doc_id % 5
    WHEN 0 THEN '[et_pb_section fb_built="1"][et_pb_text custom_padding="10px||20px|"]' || text || '[/et_pb_text][et_pb_button button_url="https://example.com/' || source || '/' || lang || '/" button_text="Go" /][/et_pb_section]'
    WHEN 1 THEN '[et_pb_text title=&quot;a[0]&quot;]' || text || '[/et_pb_text][et_pb_gallery gallery_ids="' || CAST(doc_id AS STRING) || ',999" /]'
    WHEN 2 THEN '<!-- wp:divi/text -->' || text || '<!-- /wp:divi/text -->'
    WHEN 3 THEN '<!-- wp:divi/placeholder /-->[et_pb_text]' || text || '[/et_pb_text]'
    ELSE text END AS post_content
FROM documents
"""
POSTMETA_SQL = f"""
SELECT doc_id * 10 + k AS meta_id, doc_id AS post_id,
  CASE k WHEN 0 THEN '{BACKUP_KEY}' WHEN 1 THEN '{BACKUP_DATE_KEY}' ELSE '{BUILDER_KEYS[0]}' END AS meta_key,
  CASE k WHEN 0 THEN 'backup-' || CAST(doc_id AS STRING) WHEN 1 THEN '2024-02-0' || CAST(1 + doc_id % 9 AS STRING) ELSE 'on' END AS meta_value
FROM labels, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks
WHERE quality = 1
"""
REQUESTS_SQL = """
SELECT id AS post_id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN md5('stale' || post_content) ELSE md5(post_content) END AS source_hash FROM posts
UNION ALL SELECT -1, md5('x')
"""
#: Views in order, for a WITH clause.
VIEWS = {"posts": POSTS_SQL, "postmeta": POSTMETA_SQL, "requests": REQUESTS_SQL}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str, *names: str) -> str:
    """`sql` after the named projections, for an engine that has the driver's tables as views."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + sql


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POSTS_SQL.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def postmeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows for each good label, from one pass over the labels: an explode, not a join."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    key = F.element_at(F.array(F.lit(BACKUP_KEY), F.lit(BACKUP_DATE_KEY), F.lit(BUILDER_KEYS[0])), F.col("k") + 1)
    day = F.concat(F.lit("2024-02-0"), (1 + F.col("doc_id") % 9).cast("string"))
    value = F.when(F.col("k") == 0, F.concat(F.lit("backup-"), F.col("doc_id").cast("string"))).when(F.col("k") == 1, day).otherwise("on")
    return good.select((F.col("doc_id") * 10 + F.col("k")).alias("meta_id"), F.col("doc_id").alias("post_id"), key.alias("meta_key"), value.alias("meta_value"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTS_SQL.replace("FROM posts", "FROM {posts}"), posts=posts(spark, sf_dir))


def read_posts(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """Posts from files of any format that Spark reads, or from a database (kind "jdbc", path the URL, option dbtable)."""
    reader = spark.read.format(kind).options(**options)
    return reader.option("url", path).load() if kind == "jdbc" else reader.load(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, post_content: whole text files, one document each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("post_content"))
