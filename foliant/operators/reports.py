"""Roll-ups of warnings and outcomes over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from foliant.functions.shortcodes import TEXT


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """One row for each (id, module, message)."""
    return warnings.select("id", "module", "message").distinct()


def session_warnings(warnings: DataFrame) -> DataFrame:
    """One row for each (module, message), whatever document it came from."""
    return warnings.select("module", "message").distinct()


def warning_frequency(warnings: DataFrame, top: int = 14) -> DataFrame:
    """module, message, documents of the `top` most frequent warnings, and a last row for the remainder (nulls). The rows
    counted are one a kind of warning, so the top-k has little to sort."""
    counted = distinct_warnings(warnings).groupBy("module", "message").agg(F.count(F.lit(1)).alias("documents"))
    first = counted.orderBy(F.desc("documents"), "module", "message").limit(top)
    rest = counted.join(first, ["module", "message"], "left_anti").agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))
    none = F.lit(None).cast("string")
    return first.unionByName(rest.select(none.alias("module"), none.alias("message"), "documents"))


def run_totals(outcomes: DataFrame) -> DataFrame:
    """converted, failed, retried, mean_ms in one row, from (status, retried, ms)."""
    ok = F.col("status") == "converted"
    return outcomes.agg(F.count_if(ok).alias("converted"), F.count_if(~ok).alias("failed"), F.count_if("retried").alias("retried"), F.avg(F.when(ok, F.col("ms"))).alias("mean_ms"))


def run_outcomes(nodes: DataFrame, converted: DataFrame) -> DataFrame:
    """id, status, retried, ms of every document with a tag, from a timed node table and what became of it (id, markup): failed where
    nothing came out or a tag is left. ms is the time in the tokenizer's pass, which is where a document is read."""
    asked = nodes.groupBy("id").agg(F.max("ms").alias("ms"), F.max(F.col("tag") != TEXT).alias("_opened")).where("_opened")
    ok = (F.btrim(F.coalesce("markup", F.lit(""))) != "") & ~F.contains("markup", F.lit("[et_pb_"))
    joined = asked.join(converted.select(F.col("id").alias("_id"), "markup"), F.col("id") == F.col("_id"), "left")
    return joined.select("id", F.when(ok, "converted").otherwise("failed").alias("status"), F.lit(False).alias("retried"), "ms")


def observed(outcomes: DataFrame) -> tuple[DataFrame, Observation]:
    """The outcomes, and their totals (converted, failed, ms), which are there once the outcomes have been written: a run reports
    on itself without a second pass."""
    totals, ok = Observation(), F.col("status") == "converted"
    return outcomes.observe(totals, F.count_if(ok).alias("converted"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, F.col("ms"))).alias("ms")), totals


def substitution_log(substitutions: DataFrame, shown: int = 10) -> DataFrame:
    """kind, uses, samples: for each kind of substitution its count and the first `shown` originals in order."""
    one = substitutions.groupBy("kind", "before", "after").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat_ws(" -> ", "before", "after")
    # only the first ones of a kind are ever gathered
    first = one.select("kind", text.alias("text")).distinct().withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("text"))).where(F.col("place") <= shown)
    samples = first.groupBy(F.col("kind").alias("_kind")).agg(F.array_sort(F.collect_list("text")).alias("samples"))
    uses = one.groupBy("kind").agg(F.sum("n").alias("uses"))
    return uses.join(samples, F.col("kind").eqNullSafe(F.col("_kind"))).select("kind", "uses", "samples")
