"""Listings that are kept: counts changed by what a plan changes, and pages found by key.

A listing that is asked for page after page is sorted once, into files by ranges of its key, with a count a range. A page is
then a look-up in those counts, one range to read and a sort of its rows; an offset would sort all rows before it each time.
Counts by filter are a small table, and a plan moves them by the difference between its rows before and after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from foliant.operators.inventory import NEWER, SHORTCODE, STATUSES, TYPES, ScanRequest, backups

#: Rows of one range of a kept listing.
RANGE_ROWS = 100_000
COUNTS = ("total_items", "newer_count")


def _contributions(posts: DataFrame) -> DataFrame:
    """id, post_type, listed (by its body alone), newer of the posts that a listing may hold."""
    held = posts.where(F.col("post_status").isin(*STATUSES) & F.col("post_type").isin(*TYPES))
    tagged = F.coalesce(F.contains("post_content", F.lit(SHORTCODE)), F.lit(False))
    return held.select("id", "post_type", tagged.alias("tagged"), (F.coalesce(F.contains("post_content", F.lit(NEWER)), F.lit(False)) & ~tagged).alias("newer"))


def _by_filter(rows: DataFrame, weight: Column) -> DataFrame:
    """filter (all or a type), total_items, newer_count: sums of `weight` (1 or -1)."""
    each = rows.select(F.explode(F.array(F.lit("all"), F.col("post_type"))).alias("filter"), weight.alias("w"), "listed", "newer")
    total = lambda c: F.sum(F.when(F.col(c), F.col("w")).otherwise(0)).cast("long").alias(COUNTS[c == "newer"])
    return each.groupBy("filter").agg(total("listed"), total("newer"))


def _listed(posts: DataFrame, meta: DataFrame) -> DataFrame:
    """With a backup a post is listed whatever its body holds."""
    kept = backups(meta).where("has_backup").select(F.col("post_id").alias("_backed"))
    rows = _contributions(posts).join(kept, F.col("id") == F.col("_backed"), "left")
    return rows.withColumn("listed", F.col("tagged") | F.col("_backed").isNotNull())


def count_table(posts: DataFrame, meta: DataFrame) -> DataFrame:
    """filter, total_items, newer_count for all posts and for each type; types without a post have no row. The full count, which
    the deltas of plans keep up to date."""
    return _by_filter(_listed(posts, meta), F.lit(1))


def count_deltas(before: DataFrame, after: DataFrame, meta: DataFrame) -> DataFrame:
    """What a change adds to `count_table`: `before` and `after` are the changed posts only, as they were and as they are (a post
    that comes or goes is in one of them); `meta` holds at least their metadata, which the change leaves alone."""
    marked = lambda rows, w: _listed(rows, meta).withColumn("_side", F.lit(w))
    return _by_filter(marked(before, -1).unionByName(marked(after, 1)), F.col("_side"))


def moved(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """The table after the deltas; a filter without a post left has zeros."""
    return counts.unionByName(deltas).groupBy("filter").agg(*[F.sum(c).alias(c) for c in COUNTS])


def build_pages(rows: DataFrame, request: ScanRequest, path: str, range_rows: int = RANGE_ROWS) -> None:
    """Writes the listing `rows` (of `inventory.matching`) in the request's order: path/rows/range=<k>, path/counts (range, n), and
    an empty table of its columns.
    Ranges are cut from a sample of the keys, so they are about equal; which rows a page holds doesn't depend on the cuts."""
    ranges = max(1, -(-rows.count() // range_rows))
    ranged = rows.repartitionByRange(ranges, *request.sort()).withColumn("range", F.spark_partition_id())
    ranged.write.partitionBy("range").parquet(f"{path}/rows")
    rows.limit(0).coalesce(1).write.parquet(f"{path}/columns")
    _ranged(rows.sparkSession, path).groupBy("range").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")


def _ranged(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a kept listing, which may have no file, with their range."""
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema.add("range", IntegerType())).parquet(f"{path}/rows")


def read_page(spark: SparkSession, request: ScanRequest, path: str) -> DataFrame:
    """The request's page of a listing that `build_pages` wrote in the same order: reads the ranges that hold it, mostly one. The
    driver sees one count a range. A page beyond the end is empty."""
    counts = sorted((r["range"], r["n"]) for r in spark.read.parquet(f"{path}/counts").collect())
    size = request.size or request.hard_cap
    first = max(0, (max(1, request.paged) - 1) * request.size)
    wanted, before, skipped = [], 0, 0
    for k, n in counts:
        if before + n <= first:
            skipped += n
        elif before < first + size:
            wanted.append(k)
        before += n
    rows = _ranged(spark, path).where(F.col("range").isin(*wanted) if wanted else F.lit(False)).drop("range")
    return rows.orderBy(*request.sort()).offset(first - skipped).limit(size)
