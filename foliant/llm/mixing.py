"""Mixing sources to target weights: hash-random keys, range buckets within a source, prefix sums of them, a cut at each
source's budget, and whole epochs where a budget exceeds its source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_small, materialize, running_offsets, whole_text

BUCKET_ROWS = 1_024
MOST_BUCKETS = 1 << 16


def word_count() -> Column:
    return F.regexp_count(whole_text(), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], most_epochs: int = 3) -> DataFrame:
    """source, source_size, target for a table of one row a source (source, source_size).

    Sources in the order of their code points (null last) have the weights in turn and share all sizes; no target
    exceeds most_epochs times its source's size, and what is cut off goes to the others by weight. With the sources
    in the order of cap / weight, the level is the largest, over k, of (all - the first k caps) / (the other weights).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(most_epochs).cast("long") * F.col("source_size"))
    first = Window.orderBy((F.col("cap").cast("double") / F.col("weight")), F.col("source").asc_nulls_last())
    rows = rows.withColumns({
        "others": F.coalesce(F.sum("cap").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weights": F.sum("weight").over(first.rowsBetween(0, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(Window.partitionBy()),
    })
    level = F.max((F.col("all") - F.col("others")).cast("double") / F.col("weights")).over(Window.partitionBy())
    return rows.withColumn("level", level).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def keyed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with _size (words) and _key, a hash of seed, id and text."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(whole_text())))
    return docs.withColumns({"_size": word_count(), "_key": key})


def _cuts(rows: DataFrame, weights: list[int], most_epochs: int) -> tuple[DataFrame, int]:
    """(one row a source, how many): _source, _source_size, _target, _epochs (whole ones), and where the last epoch ends:
    after _equal_rows of the rows with _cut_key; _cut_key is null where it takes nothing.

    The range of keys is cut into buckets of about BUCKET_ROWS rows; sums of buckets say in which one the budget ends, and
    only the rows of those buckets, one a source, are sorted.
    """
    sizes = rows.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = source_targets(sizes, weights, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_epochs))).otherwise(F.lit(1))
    targets = targets.withColumn("_epochs", epochs.cast("int")).withColumn("_budget", F.when(F.col("_epochs") < most_epochs, F.col("target") - F.col("_epochs") * F.col("source_size")).otherwise(F.lit(-1.0)))
    targets = materialize(targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_epochs", "_budget"), "mix-targets")
    n, sources = rows.count(), targets.count()
    buckets = min(MOST_BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    bucket = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets, 32)
    light = rows.select("source", "_size", "_key", bucket.alias("_bucket"))
    same = F.col("source").eqNullSafe(F.col("_source"))
    # the last row of an epoch lies in the bucket before whose end the budget is spent, or in the last bucket
    starts = running_offsets(light.groupBy("source", "_bucket").agg(F.sum("_size").alias("sum")), ["source"], ["_bucket"], "sum", "_before")
    last = join_small(starts, targets, same, "inner", sources).where(F.col("_before") <= F.col("_budget")).groupBy("_source", "_budget").agg(F.max(F.struct("_bucket", "_before")).alias("at"))
    last = materialize(last.select("_source", "_budget", F.col("at._bucket").alias("_b"), F.col("at._before").alias("_before")), "mix-ends")
    there = join_small(light, last, same & (F.col("_bucket") == F.col("_b")), "inner", sources)
    order = Window.partitionBy("source").orderBy("_key")
    there = there.withColumn("_spent", F.col("_before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    fits = 2 * F.col("_spent") + F.col("_size") <= 2 * F.col("_budget")
    keys = there.groupBy("source", "_key").agg(F.count_if(fits).alias("n"))
    end = keys.groupBy("source").agg(F.max(F.when(F.col("n") > 0, F.struct("_key", "n"))).alias("end"), F.min("_key").alias("_least"))
    # where no row of that bucket fits, all before it do: the cut lies at the bucket's least key, with none of its rows
    cut = end.select(F.col("source").alias("_c"), F.coalesce(F.col("end._key"), F.col("_least")).alias("_cut_key"), F.coalesce(F.col("end.n"), F.lit(0)).alias("_equal_rows"))
    return materialize(join_small(targets, cut, F.col("_source").eqNullSafe(F.col("_c")), "left", sources).drop("_c", "_budget"), "mix-cuts"), sources


def take(rows: DataFrame, weights: list[int], most_epochs: int = 3) -> DataFrame:
    """`rows` (of `keyed`) without _key, with _source_size, _target and _copies; see `mix`."""
    rows = materialize(rows, "mix-rows")
    cuts, sources = _cuts(rows, weights, most_epochs)
    rows = join_small(rows, cuts, F.col("source").eqNullSafe(F.col("_source")), "left", sources)
    # of rows with one id and text, that is one key, the cut can take some and leave some: only those are numbered
    split = cuts.where("_equal_rows > 0").select("_source", "_cut_key", "_equal_rows")
    total = join_small(rows.select("source", "_key"), split.select(F.col("_source").alias("_s"), F.col("_cut_key").alias("_k"), F.col("_equal_rows").alias("_e")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k")), "inner", sources)
    parted = total.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.first("_e").alias("e")).where("n > e").select("_k").collect()  # at most one a source
    at_cut = F.col("_key") == F.col("_cut_key")
    extra = F.when(F.col("_key") < F.col("_cut_key"), 1).when(at_cut & (F.col("_equal_rows") > 0), 1).otherwise(0)
    keep = [F.col(f"`{c}`") for c in rows.columns if c not in ("_key", "_source", "_epochs", "_cut_key", "_equal_rows")]
    if not parted:
        return rows.select(*keep, (F.col("_epochs") + extra).alias("_copies"))
    among = at_cut & F.col("_key").isin([r["_k"] for r in parted])
    among = F.coalesce(among, F.lit(False))
    numbered = rows.where(among).withColumn("_place", F.row_number().over(Window.partitionBy("source", "_key").orderBy("_size")))
    first = numbered.select(*keep, (F.col("_epochs") + (F.col("_place") <= F.col("_equal_rows")).cast("int")).alias("_copies"))
    return rows.where(~among).select(*keep, (F.col("_epochs") + extra).alias("_copies")).unionByName(first)


def mix(docs: DataFrame, weights: list[int], seed: int = 42, most_epochs: int = 3) -> DataFrame:
    """Every row of `docs` (doc_id, text, source and any other columns) with _size (words), _source_size, _target and
    _copies: how often the mix takes it, 0 to most_epochs.

    A source's rows come in the order of a hash of seed, id and text; it is taken whole as many times as its target
    holds, then from the start of that order up to the budget, the row at the cut if half of it or more fits. That end is
    a key a source, so the rows stay where they are and are held against it. Null texts have size 0; null sources are a
    source; null ids and repeated rows are rows like any other; reruns agree. An empty table gives an empty result.
    """
    return take(keyed(docs, seed), weights, most_epochs)
