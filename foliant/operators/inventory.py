"""Inventory: which posts hold shortcodes or a backup, listed, sorted, paged and counted.

Metadata are collapsed to one row a post before they are joined, so repeated keys can't multiply rows and no post
body is ever a grouping key; bodies are reduced to a flag and a hash below the join and never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.corpus import BACKUP_DATE_KEY, BACKUP_KEY

#: Fixed values of the formats.
SHORTCODE, NEWER = "[et_pb_", "<!-- wp:divi/"
STATUSES, TYPES = ("publish", "draft", "private", "pending"), ("page", "post")
SORTABLE = {"title": "post_title", "date": "post_date", "type": "post_type", "status": "post_status"}
PAGE_SIZES, DEFAULT_SIZE, HARD_CAP = (20, 50, 100), 20, 500
#: Text is sorted without regard to case or accents.
COLLATION = "UNICODE_CI_AI"


@dataclass(frozen=True)
class ScanRequest:
    """What a listing asks for; anything out of range falls back as the fields' comments say."""

    post_type: str = "all"  # page, post; else all
    orderby: str = "title"  # a key of SORTABLE; else title
    order: str = "asc"  # desc; else ascending
    per_page: int | str = DEFAULT_SIZE  # one of PAGE_SIZES, or "all" up to the cap; else the user's own size, else 20
    paged: int = 1
    own_size: int = 0
    hard_cap: int = HARD_CAP

    @property
    def size(self) -> int:
        """Rows a page; 0 for all up to the cap."""
        if self.per_page == "all":
            return 0
        return self.per_page if self.per_page in PAGE_SIZES else self.own_size or DEFAULT_SIZE

    def types(self) -> tuple[str, ...]:
        return (self.post_type,) if self.post_type in TYPES else TYPES

    def sort(self) -> list[Column]:
        name = SORTABLE.get(self.orderby, "post_title")
        column = F.col(name) if name == "post_date" else F.collate(F.col(name), COLLATION)
        return [column.desc_nulls_last() if self.order.lower() == "desc" else column.asc_nulls_first(), F.col("id").asc()]


def backups(meta: DataFrame) -> DataFrame:
    """post_id, has_backup, backup_date: one row for each post with either key, the largest value of repeats."""
    kept = meta.where(F.col("meta_key").isin(BACKUP_KEY, BACKUP_DATE_KEY))
    is_key = lambda k: F.col("meta_key") == k
    return kept.groupBy("post_id").agg(F.max(is_key(BACKUP_KEY)).alias("has_backup"), F.max(F.when(is_key(BACKUP_DATE_KEY), F.col("meta_value"))).alias("backup_date"))


def matching(posts: DataFrame, meta: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """The listed posts, unsorted: has shortcodes or has a backup, in a listed status and type."""
    light = posts.where(F.col("post_status").isin(*STATUSES) & F.col("post_type").isin(*types)).select(
        "id", "post_title", "post_type", "post_status", "post_date",
        F.coalesce(F.contains("post_content", F.lit(SHORTCODE)), F.lit(False)).alias("has_shortcodes"), F.md5("post_content").alias("source_hash"),
    )
    joined = light.join(backups(meta), F.col("id") == F.col("post_id"), "left").drop("post_id")
    return joined.withColumn("has_backup", F.coalesce("has_backup", F.lit(False))).where("has_shortcodes or has_backup")


def scan(posts: DataFrame, meta: DataFrame, request: ScanRequest = ScanRequest()) -> DataFrame:
    """One page of the listing: a top-k of the sort, so no full sort is made."""
    rows = matching(posts, meta, request.types()).orderBy(*request.sort())
    return rows.offset(max(0, (max(1, request.paged) - 1) * request.size)).limit(request.size or request.hard_cap)


def counts(posts: DataFrame, meta: DataFrame, request: ScanRequest = ScanRequest()) -> DataFrame:
    """One row: total_items, total_pages, newer_count, truncated. Both counts come from one scan of the bodies."""
    flagged = posts.where(F.col("post_status").isin(*STATUSES) & F.col("post_type").isin(*request.types())).select(
        "id", F.contains("post_content", F.lit(SHORTCODE)).alias("has_shortcodes"), F.contains("post_content", F.lit(NEWER)).alias("newer")
    )
    joined = flagged.join(backups(meta), F.col("id") == F.col("post_id"), "left")
    listed = F.coalesce("has_shortcodes", F.lit(False)) | F.coalesce("has_backup", F.lit(False))
    total = F.count_if(listed)
    pages = F.ceil(total / request.size) if request.size else F.lit(1).cast("long")
    return joined.agg(total.alias("total_items"), pages.alias("total_pages"), F.count_if(F.col("newer") & ~F.col("has_shortcodes")).alias("newer_count"), ((total > request.hard_cap) & F.lit(not request.size)).alias("truncated"))


def delimiter_totals(posts: DataFrame) -> DataFrame:
    """literal_quotes, encoded_quotes: attribute delimiters of either form over the corpus."""
    return posts.agg(F.sum(F.regexp_count("post_content", F.lit(r'[\w-]+\s*=\s*"'))).alias("literal_quotes"), F.sum(F.regexp_count("post_content", F.lit("=&quot;"))).alias("encoded_quotes"))


def run_counters(posts: DataFrame, meta: DataFrame, builder_key: str) -> DataFrame:
    """Posts that still hold shortcodes, backups and builder flags, in one row."""
    left = posts.agg(F.count_if(F.contains("post_content", F.lit(SHORTCODE))).alias("residual"))
    facts = meta.agg(F.count_if(F.col("meta_key") == BACKUP_KEY).alias("backups"), F.count_if(F.col("meta_key") == builder_key).alias("builder_flags"))
    return left.join(facts)  # one row each


def resolve_attachments(ids: DataFrame, attachments: DataFrame, base_url: str, *also: str) -> DataFrame:
    """id, url of every wanted id: the attachment's own URL, else its file under `base_url`, else its guid; null if it is
    gone. One join for all ids, in place of a look-up each. `also` are further columns of the attachments."""
    url = F.coalesce("url", F.concat(F.lit(base_url + "/"), "file"), "guid")
    known = attachments.select(F.col("id").alias("_id"), url.alias("resolved_url"), *also)
    return ids.join(known, F.col("id") == F.col("_id"), "left").drop("_id")


def ids_of_urls(urls: DataFrame, attachments: DataFrame) -> DataFrame:
    """The reverse: attachment_id of every url, 0 if none has it (the least id of several)."""
    known = attachments.where("url is not null").groupBy(F.col("url").alias("_url")).agg(F.min("id").alias("_id"))
    return urls.join(known, F.col("url") == F.col("_url"), "left").select(*urls.columns, F.coalesce("_id", F.lit(0)).cast("long").alias("attachment_id"))


def menu_names(wanted: DataFrame, menus: DataFrame) -> DataFrame:
    """menu_name of every menu_id, null if the menu is gone."""
    return wanted.join(menus.select(F.col("id").alias("_id"), F.col("name").alias("menu_name")), F.col("menu_id") == F.col("_id"), "left").drop("_id")
