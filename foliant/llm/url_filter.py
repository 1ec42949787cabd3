"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

Each distinct url is expanded into the expressions that a rule could be written as (every suffix of its
host at a dot, with every prefix of its path that ends in a slash), the expressions meet the rules on the
first eight hex digits of their SHA-256, the full digests confirm the match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, join_small

PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; '' without `://` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (verdict, host, path); a path starts and ends with a slash."""
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host or not (path.startswith("/") and path.endswith("/")):
            raise ValueError(f"not a rule: {(verdict, host, path)}")
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def expressions(host: Column, path: Column, max_labels: int, max_depth: int) -> Column:
    """Host suffixes of at most max_labels labels, each with the path's prefixes of at most max_depth slashes.
    The bounds are those of the longest rule, so no expression that a rule could equal is missed."""
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    n, m = F.size(labels), F.size(parts) - 1
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max_labels))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    paths = F.when(m > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(m, F.lit(max_depth)))), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """page columns kept by the caller plus host, path, rule (null if none fits) and verdict.

    `pages` needs the column `url`; its other columns are carried along (names host, path, rule and verdict are
    replaced). Null urls and urls without `://` have empty host and path, fit no rule and get `default`; repeated
    urls are judged once; an empty table gives an empty result. Of equal rules with both verdicts, block wins.
    """
    keyed = rules.select(F.concat("host", "path").alias("rule"), "verdict").distinct()
    bounds = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.size(F.split("path", "/")) - 1).alias("depth"), F.count(F.lit(1)).alias("n")).first()
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")])
    judged = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not bounds["n"]:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = keyed.withColumn("digest", F.sha2("rule", 256))
    keyed = keyed.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    seen = pages.select(F.col(url).alias("_url")).where(F.col("_url").contains("://")).distinct()
    wanted = seen.select("_url", F.explode(expressions(host_of(F.col("_url")), path_of(F.col("_url")), bounds["labels"], bounds["depth"])).alias("expression"))
    wanted = wanted.select("_url", F.sha2("expression", 256).alias("full")).withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    hits = join_small(wanted, keyed, "short", "inner", bounds["n"]).where(F.col("full") == F.col("digest"))
    best = hits.groupBy("_url").agg(F.max(F.struct(F.length("rule").alias("size"), (F.col("verdict") == "block").alias("block"), "rule", "verdict")).alias("_best"))
    out = judged.join(best, F.col(url) == F.col("_url"), "left")
    return out.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))}).drop("_url", "_best")
