"""Change, backup and restore plans: what a guarded writer would do, as tables. Nothing is written in place; a plan names
the content hash that it was made for, and a publisher joins it to the latest snapshot before it acts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.sanitize import filter_losses
from foliant.functions.shortcodes import TEXT
from foliant.operators.documents import holds_converted_blocks
from foliant.operators.inventory import NEWER, SHORTCODE, STATUSES, TYPES
from foliant.sources.corpus import BACKUP_DATE_KEY, BACKUP_KEY, BUILDER_KEYS, BUILDER_SNAPSHOT_KEY

BLANKS = " \t\n\r\0\x0b"


def blank(c: Column) -> Column:
    """Null, or nothing but white space."""
    return F.coalesce(F.btrim(c, F.lit(BLANKS)), F.lit("")) == ""


def actionable(wanted: DataFrame, posts: DataFrame) -> DataFrame:
    """post_id, reason of every wanted id: no_post, bad_type, bad_status or null (may be changed)."""
    light = posts.select("id", "post_type", "post_status")
    reason = F.when(F.col("id").isNull(), "no_post").when(~F.col("post_type").isin(*TYPES), "bad_type").when(~F.col("post_status").isin(*STATUSES), "bad_status")
    return wanted.join(light, F.col("post_id") == F.col("id"), "left").select("post_id", reason.alias("reason"))


def check_tokens(requests: DataFrame, posts: DataFrame) -> DataFrame:
    """post_id, verdict: missing_token, gone, stale or ok. The body is hashed below the join."""
    hashed = posts.select("id", F.md5("post_content").alias("current_hash"))
    verdict = F.when(F.coalesce("source_hash", F.lit("")) == "", "missing_token").when(F.col("id").isNull(), "gone").when(F.col("source_hash") == F.col("current_hash"), "ok").otherwise("stale")
    return requests.join(hashed, F.col("post_id") == F.col("id"), "left").select("post_id", "source_hash", "current_hash", verdict.alias("verdict"))


def retries(checked: DataFrame) -> DataFrame:
    """The one retry: stale requests again, with the current hash, marked with the hash that they superseded."""
    return checked.where("verdict = 'stale'").select("post_id", F.col("current_hash").alias("source_hash"), F.col("source_hash").alias("superseded_hash"), F.lit(True).alias("superseded"))


def _facts(posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """post, convertible (has a complete opening tag), converted (holds blocks outside its modules) of every post that is
    either; both by the parsed documents, as a tag or delimiter in the wrong place counts for neither."""
    tagged = nodes.where(F.col("tag") != TEXT).select(F.col("id").alias("post"), F.lit(True).alias("convertible")).distinct()
    blocks = holds_converted_blocks(posts, nodes).select(F.col("id").alias("post"), F.lit(True).alias("converted")).distinct()
    known = tagged.join(blocks, "post", "full")
    return known.select("post", F.coalesce("convertible", F.lit(False)).alias("convertible"), F.coalesce("converted", F.lit(False)).alias("converted"))


def _refused(texts: DataFrame, filtered: DataFrame | None) -> DataFrame:
    """_filtered_id of the texts (id, text) from which the host's filter (id, filtered: what it makes of them) would take."""
    if filtered is None:
        return texts.sparkSession.createDataFrame([], "_filtered_id long, _loses boolean")
    both = texts.join(filtered.select("id", "filtered"), "id")
    return both.where(F.size(filter_losses(F.col("text"), F.col("filtered"))) > 0).select(F.col("id").alias("_filtered_id"), F.lit(True).alias("_loses"))


def backup_plan(posts: DataFrame, meta: DataFrame, nodes: DataFrame) -> DataFrame:
    """post_id, action (keep, create or refresh), backup: the first snapshot stays unless it is stale, that is, differs from
    a body that still holds shortcodes and no converted blocks (by `nodes`, the posts' node table)."""
    existing = meta.where(F.col("meta_key") == BACKUP_KEY).groupBy("post_id").agg(F.min_by("meta_value", "meta_id").alias("existing"))
    joined = posts.select("id", "post_content").join(existing, F.col("id") == F.col("post_id"), "left").join(_facts(posts, nodes), F.col("id") == F.col("post"), "left")
    absent = F.coalesce("existing", F.lit("")) == ""
    stale = (F.col("existing") != F.col("post_content")) & F.coalesce("convertible", F.lit(False)) & ~F.coalesce("converted", F.lit(False))
    action = F.when(absent, "create").when(stale, "refresh").otherwise("keep")
    return joined.select(F.col("id").alias("post_id"), action.alias("action"), F.when(action == "keep", F.col("existing")).otherwise(F.col("post_content")).alias("backup"))


def builder_snapshot(posts: DataFrame, meta: DataFrame) -> DataFrame:
    """post_id, meta_key, exists, values for each managed key of every post, absent ones included."""
    managed = meta.where(F.col("meta_key").isin(*BUILDER_KEYS)).groupBy("post_id", "meta_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("meta_id", "meta_value"))), lambda x: x["meta_value"]).alias("values"))
    wanted = posts.select(F.col("id").alias("post_id"), F.explode(F.array(*[F.lit(k) for k in BUILDER_KEYS])).alias("meta_key"))
    joined = wanted.join(managed, ["post_id", "meta_key"], "left")
    return joined.select("post_id", "meta_key", F.col("values").isNotNull().alias("exists"), F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def stored_snapshots(meta: DataFrame) -> DataFrame:
    """post_id, meta_key, exists, values of the builder snapshots that stand in the metadata as JSON, for `restore_builder_meta`. A
    key's record is an object with values (a list or one), a list, or one value, as different versions wrote them; null or
    absent: the key didn't exist. A snapshot that is no object or holds nothing counts as none: its post has no row."""
    kept = meta.where(F.col("meta_key") == BUILDER_SNAPSHOT_KEY).groupBy("post_id").agg(F.min_by("meta_value", "meta_id").alias("text"))
    whole = kept.select("post_id", F.try_parse_json("text").alias("v"))
    whole = whole.where(F.schema_of_variant("v").startswith("OBJECT<") & (F.schema_of_variant("v") != "OBJECT<>"))
    records = whole.select("post_id", F.inline(F.array(*[F.struct(F.lit(k).alias("meta_key"), F.try_variant_get("v", f"$.{k}", "variant").alias("record")) for k in BUILDER_KEYS])))
    of = lambda path, kind: F.try_variant_get("record", path, kind)
    one = F.array_compact(F.array(of("$", "string")))
    shape = F.schema_of_variant("record")
    listed = F.coalesce(of("$.values", "array<string>"), F.array_compact(F.array(of("$.values", "string"))))
    values = F.when(shape.startswith("OBJECT"), listed).when(shape.startswith("ARRAY"), of("$", "array<string>")).otherwise(one)
    values = F.coalesce(values, F.array().cast("array<string>"))
    return records.select("post_id", "meta_key", (F.size(values) > 0).alias("exists"), values.alias("values"))


def restore_builder_meta(meta: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The metadata after a restore: managed keys of restored posts are cleared, then each recorded value is added. A post
    that has a backup and no snapshot gets the builder switched on. meta_id is null for added rows."""
    covered = snapshot.select("post_id").distinct()
    bare = meta.where(F.col("meta_key") == BACKUP_KEY).select("post_id").distinct().join(covered, "post_id", "left_anti")
    kept = meta.join(covered.withColumn("_covered", F.lit(True)), "post_id", "left").where(F.col("_covered").isNull() | ~F.col("meta_key").isin(*BUILDER_KEYS)).drop("_covered")
    kept = kept.join(bare.withColumn("_bare", F.lit(True)), "post_id", "left").where(F.col("_bare").isNull() | (F.col("meta_key") != BUILDER_KEYS[0])).drop("_bare")
    none = F.lit(None).cast("long").alias("meta_id")
    added = snapshot.where("exists").select(none, "post_id", "meta_key", F.explode("values").alias("meta_value"))
    guessed = bare.select(none, "post_id", F.lit(BUILDER_KEYS[0]).alias("meta_key"), F.lit("on").alias("meta_value"))
    return kept.select("meta_id", "post_id", "meta_key", "meta_value").unionByName(added).unionByName(guessed)


def restore_plan(requests: DataFrame, posts: DataFrame, meta: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """post_id, verdict, restored_hash: no_backup, filter_loss (where `filtered`, id and what the host's filter makes of a
    backup, has less), or the token check's verdict; the hash of what a restore puts back."""
    texts = meta.where(F.col("meta_key") == BACKUP_KEY).groupBy("post_id").agg(F.min_by("meta_value", "meta_id").alias("text"))
    backups = texts.select(F.col("post_id").alias("_post"), F.md5("text").alias("restored_hash"))
    joined = check_tokens(requests, posts).join(backups, F.col("post_id") == F.col("_post"), "left").join(_refused(texts.withColumnRenamed("post_id", "id"), filtered), F.col("post_id") == F.col("_filtered_id"), "left")
    ok = F.col("verdict") == "ok"
    verdict = F.when(ok & F.col("restored_hash").isNull(), "no_backup").when(ok & F.col("_loses"), "filter_loss").otherwise(F.col("verdict"))
    return joined.select("post_id", verdict.alias("verdict"), F.when(verdict == "ok", F.col("restored_hash")).alias("restored_hash"))


def change_plan(requests: DataFrame, posts: DataFrame, converted: DataFrame, nodes: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """post_id, status, reason, markup, source_hash, new_hash for each request. `converted` is (id, markup), `nodes` the posts'
    node table, `filtered` (id, filtered) what the host's filter makes of the markup. Reasons, in order: those of
    `actionable`, of the token check, not_convertible, already_converted, empty_output, filter_loss."""
    checked = check_tokens(requests, posts).join(actionable(requests.select("post_id").distinct(), posts), "post_id")
    joined = checked.join(_facts(posts, nodes), F.col("post_id") == F.col("post"), "left").join(converted.select(F.col("id").alias("_id"), "markup"), F.col("post_id") == F.col("_id"), "left")
    joined = joined.join(_refused(converted.select("id", F.col("markup").alias("text")), filtered), F.col("post_id") == F.col("_filtered_id"), "left")
    reason = F.coalesce("reason", F.when(F.col("verdict") != "ok", F.col("verdict")), F.when(~F.coalesce("convertible", F.lit(False)), "not_convertible"), F.when(F.coalesce("converted", F.lit(False)), "already_converted"), F.when(blank(F.col("markup")), "empty_output"), F.when(F.col("_loses"), "filter_loss"))
    return joined.select("post_id", F.when(reason.isNull(), "write").otherwise("refuse").alias("status"), reason.alias("reason"), F.when(reason.isNull(), F.col("markup")).alias("markup"), "source_hash", F.when(reason.isNull(), F.md5("markup")).alias("new_hash"))


def still_current(plan: DataFrame, latest: DataFrame) -> DataFrame:
    """`plan` (post_id, source_hash and any other columns) with current: does the latest snapshot still hold the body that the
    plan was made for? A publisher writes those rows only."""
    now = latest.select(F.col("id").alias("_id"), F.md5("post_content").alias("_now"))
    return plan.join(now, F.col("post_id") == F.col("_id"), "left").withColumn("current", F.coalesce(F.col("_now") == F.col("source_hash"), F.lit(False))).drop("_id", "_now")


def retained_meta(meta: DataFrame, delete_data: bool = True) -> DataFrame:
    """The metadata that an uninstall leaves: all of it, or all but the tool's own keys."""
    own = (BACKUP_KEY, BACKUP_DATE_KEY, BUILDER_SNAPSHOT_KEY)
    return meta.where(~F.col("meta_key").isin(*own)) if delete_data else meta


def retained_options(options: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """option_name rows that start with none of the prefixes; a site_id column, if any, takes the place of a loop."""
    gone = F.lit(False)
    for p in prefixes:
        gone = gone | F.col("option_name").startswith(p)
    return options.where(~gone)


def newer_format(content: Column) -> Column:
    return F.contains(content, F.lit(NEWER)) & ~F.contains(content, F.lit(SHORTCODE))
