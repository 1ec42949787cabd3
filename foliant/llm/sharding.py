"""K-d tree sharding with DataFrame functions only: split at distributed weighted medians along the widest dimension.

A row is a point of metadata dimensions. A number is scaled to 20 bits, any other value is its rank among the distinct
ones, scaled alike, and null lies below all; 12 bits of a hash order equal values. A node splits along the dimension in
which its rows spread widest, at the value that parts its bytes in the ratio of the leaves on either side; that value is
found by two rounds of sums over 2**16 buckets, so no rows are sorted or gathered. A level of the tree is a table of its
splits, a row a node, that the rows are joined with; no part of it is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize, running_offsets, utf8_size, whole_text

VALUE_BITS, TIE_BITS, ROUND_BITS = 20, 12, 16
SLOT_ROWS = 2_048
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "decimal")


def metadata_points(docs: DataFrame, dimensions: list[str]) -> DataFrame:
    """doc_id, size, text_crc32 and a row id with the dimensions v0, v1, ... as numbers (null for NaN and infinities) or
    strings; written once, so that each round reads a few dozen bytes a row and no text."""
    kinds = dict(docs.dtypes)

    def value(d: str) -> Column:
        c = F.col(f"`{d}`")
        if not kinds[d].startswith(NUMBERS):
            return c.cast("string")
        return F.when(F.abs(c.cast("double")) <= 1.7976931348623157e308, c.cast("double"))

    size = (utf8_size() + 1).alias("size")
    return docs.select(F.col("doc_id").cast("long"), size, F.crc32(whole_text()).alias("text_crc32"), *[value(d).alias(f"v{i}") for i, d in enumerate(dimensions)]).withColumn("row", F.monotonically_increasing_id())


def _ranks(points: DataFrame, named: list[int]) -> DataFrame:
    """dimension, value, part (0 to 1): each distinct string's rank, by ranges that are sorted one by one."""
    pairs = F.array(*[F.struct(F.lit(i).alias("dimension"), F.col(f"v{i}").alias("value")) for i in named])
    distinct = points.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct()
    ranged = materialize(distinct.repartitionByRange("dimension", "value").withColumn("range", F.spark_partition_id()), "distinct-values")
    before = running_offsets(ranged.groupBy("dimension", "range").agg(F.count(F.lit(1)).alias("n")), ["dimension"], ["range"], "n", "before")
    before = before.withColumn("all", F.sum("n").over(Window.partitionBy("dimension"))).drop("n")  # one row a range
    inside = F.row_number().over(Window.partitionBy("dimension", "range").orderBy("value")) - 1
    ranked = ranged.withColumn("inside", inside).join(before, ["dimension", "range"])
    return materialize(ranked.select("dimension", "value", ((F.col("before") + F.col("inside")) / F.greatest(F.col("all") - 1, F.lit(1))).alias("part")), "value-ranks")


def _keyed(points: DataFrame, n: int) -> DataFrame:
    """points with the keys k0, k1, ... (VALUE_BITS, then TIE_BITS) in place of their dimensions."""
    kinds = dict(points.dtypes)
    named = [i for i in range(n) if kinds[f"v{i}"] == "string"]
    counted = [i for i in range(n) if i not in named]
    low_high = [f(f"v{i}").alias(f"{f.__name__}{i}") for i in counted for f in (F.min, F.max)]
    ends = points.agg(*low_high).first() if counted else {}
    rows = points
    if named:
        ranks = _ranks(points, named)
        distinct = ranks.count()
        for i in named:
            mine = ranks.where(F.col("dimension") == i).select(F.col("value").alias("_value"), F.col("part").alias(f"part{i}"))
            rows = join_small(rows, mine, F.col(f"v{i}") == F.col("_value"), "left", distinct).drop("_value")

    def key(i: int) -> Column:
        if i in named:
            part = F.col(f"part{i}")
        else:
            low, high = ends[f"min{i}"] or 0.0, ends[f"max{i}"] or 0.0
            part = (F.col(f"v{i}") - low) / ((high - low) or 1.0)
        value = F.coalesce(1 + F.floor(part * (2**VALUE_BITS - 2)).cast("long"), F.lit(0))
        tie = F.pmod(F.xxhash64("doc_id", "text_crc32", "row", F.lit(i)), F.lit(1 << TIE_BITS))
        return value * (1 << TIE_BITS) + tie

    return rows.select("doc_id", "size", "text_crc32", "row", *[key(i).alias(f"k{i}") for i in range(n)])


def kd_shards(docs: DataFrame, dimensions: list[str], target_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of `docs` (doc_id, text and the dimensions' columns).

    Leaves are shards of near-equal bytes: `shards` of them, or as many as make them `target_bytes` each. Size is the
    text's UTF-8 bytes (null: none) plus 1. Null in a dimension is a value of its own, below all others; equal and repeated
    rows are parted by a hash, so one common value can be cut through; slots number a shard's rows from 0 without a gap.
    Other columns are ignored. An empty table gives an empty result.
    """
    points = materialize(metadata_points(docs, dimensions), "points")
    n = len(dimensions)
    whole = points.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    if shards is None:
        shards = max(1, -(-whole["bytes"] // target_bytes))
    # a node is the range of its leaves: the first one and how many
    rows = materialize(_keyed(points, n), "keyed-points").withColumns({"first": F.lit(0).cast("long"), "leaves": F.lit(shards).cast("long")})
    keys = F.array(*[F.col(f"k{i}") for i in range(n)])
    for level in range((shards - 1).bit_length()):
        nodes = min(shards, 1 << level)
        splits = materialize(_splits(rows.where("leaves > 1"), keys, n, nodes), "splits")
        rows = join_small(rows, splits, "first", "left", nodes)
        left = F.floor(F.col("leaves") / 2).cast("long")
        over = F.element_at(keys, F.col("dimension") + 1) > F.col("value")  # null in a node that isn't split
        moved = {"first": F.when(over, F.col("first") + left).otherwise(F.col("first")), "leaves": F.when(over, F.col("leaves") - left).when(~over, left).otherwise(F.col("leaves"))}
        rows = rows.withColumns(moved).drop("dimension", "value")
    return with_slots(rows.select("doc_id", "size", "text_crc32", "row", F.col("first").cast("int").alias("shard")), whole["rows"])


def _splits(rows: DataFrame, keys: Column, n: int, nodes: int) -> DataFrame:
    """first, dimension, value of each node that has rows: keys up to value go to its left half of leaves."""
    spreads = F.array(*[F.max(f"k{i}") - F.min(f"k{i}") for i in range(n)])
    spread = rows.groupBy("first", "leaves").agg(F.sum("size").alias("bytes"), spreads.alias("spreads"))
    wanted = F.floor(F.col("bytes") * F.floor(F.col("leaves") / 2) / F.col("leaves")).cast("long")
    plan = materialize(spread.select("first", (F.array_position("spreads", F.array_max("spreads")) - 1).cast("int").alias("dimension"), wanted.alias("wanted")), "split-plan")
    values = join_small(rows, plan, "first", "inner", nodes).select("first", "dimension", "wanted", "size", F.element_at(keys, F.col("dimension") + 1).alias("at"))
    high = _cut(values.withColumn("bucket", F.shiftright("at", ROUND_BITS))).select("first", F.col("bucket").alias("high"), F.col("before").alias("spent"))
    high = materialize(high, "split-high")
    there = join_small(values, high, "first", "inner", nodes).where(F.shiftright("at", ROUND_BITS) == F.col("high"))
    there = there.withColumns({"bucket": F.col("at").bitwiseAND((1 << ROUND_BITS) - 1), "wanted": F.col("wanted") - F.col("spent")})
    return _cut(there, "high").select("first", "dimension", (F.col("high") * (1 << ROUND_BITS) + F.col("bucket")).alias("value"))


def _cut(values: DataFrame, *keep: str) -> DataFrame:
    """For each node the last bucket before which the running sum of bytes is at most what is wanted, and that sum. One row a
    bucket and node is summed over, at most 2**16 of them a node."""
    node = ["first", "dimension", "wanted", *keep]
    sums = values.groupBy(*node, "bucket").agg(F.sum("size").alias("bytes"))
    before = running_offsets(sums, ["first"], ["bucket"], "bytes", "before")
    last = before.where("before <= wanted").groupBy(*node).agg(F.max(F.struct("bucket", "before")).alias("at"))
    return last.select(*node, "at.bucket", "at.before")


def with_slots(placed: DataFrame, rows: int) -> DataFrame:
    """Numbers each shard's rows from 0 by counting buckets of rows first, so that no task has a whole shard."""
    buckets = max(1, -(-rows // SLOT_ROWS))
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    starts = running_offsets(dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")), ["shard"], ["bucket"], "n", "before").drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")) - 1
    return dealt.withColumn("inside", inside).join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).alias("slot"))
