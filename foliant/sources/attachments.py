"""Attachments kept in buckets of their id, so that galleries are joined to them without moving them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_attachments(rows: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Writes `rows` (id and more) as table `name` at `path`, each bucket one sorted file, and returns it as read back. A join on id
    then moves only its other side, into as many partitions; take a multiple of the cores that read it, and buckets of some
    hundred MB."""
    # by the buckets' own hash, so that a task writes one bucket and not a file of each
    dealt = rows.repartition(buckets, F.col("id").cast("long")).withColumn("id", F.col("id").cast("long"))
    dealt.write.option("path", path).bucketBy(buckets, "id").sortBy("id").format("parquet").saveAsTable(name)
    return kept_attachments(rows.sparkSession, name)


def kept_attachments(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def listed_ids(nodes: DataFrame) -> DataFrame:
    """id of every attachment that a gallery lists, once: what has to be looked up, however many galleries list it."""
    ids = F.split(F.coalesce(F.element_at(F.map_from_entries("attrs"), "gallery_ids"), F.lit("")), ",")
    rows = nodes.where(F.col("tag") == "et_pb_gallery").select(F.explode(ids).alias("id"))
    return rows.select(F.expr("try_cast(trim(id) AS BIGINT)").alias("id")).where("id > 0").distinct()


def missing(nodes: DataFrame, attachments: DataFrame) -> DataFrame:
    """The ids that galleries list and no attachment has: dead since a site was moved, say."""
    return listed_ids(nodes).join(attachments.select("id"), "id", "left_anti")
