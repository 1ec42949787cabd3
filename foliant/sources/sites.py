"""Tables of many sites: one folder a site, and jobs over some sites as a join with a table of sites.

The join's other side is small and filtered, so Spark prunes the folders of the sites that the job isn't for when it runs
(dynamic partition pruning); nothing loops over sites, whether in batches or one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from foliant.operators.writeplan import retained_meta, retained_options

#: Sites whose names a join may be handed to all executors with; beyond, Spark chooses how to join.
FEW_SITES = 100_000


def write_sites(rows: DataFrame, path: str) -> None:
    """`rows` (site_id and any columns) by site. Rows of a site are put together first, so that a site has few files; a large
    site is split again by adaptive execution."""
    rows.hint("rebalance", "site_id").write.partitionBy("site_id").parquet(path)


def of_sites(spark: SparkSession, path: str, sites: DataFrame) -> DataFrame:
    """The rows at `path` of the sites in `sites` (site_id), each once. Folders are pruned where `sites` is filtered by a comparison,
    as Spark takes that for selective."""
    wanted = sites.select("site_id").distinct()
    found = spark.read.parquet(path).schema
    # folder names don't tell the key's type; with a cast between, folders wouldn't be pruned
    rows = spark.read.schema(StructType([StructField("site_id", sites.schema["site_id"].dataType) if f.name == "site_id" else f for f in found])).parquet(path)
    return rows.join(F.broadcast(wanted) if wanted.count() <= FEW_SITES else wanted, "site_id")


def uninstalled_options(spark: SparkSession, path: str, sites: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """What an uninstall leaves of the options of these sites; other sites' files aren't read."""
    return retained_options(of_sites(spark, path, sites), prefixes)


def uninstalled_meta(spark: SparkSession, path: str, sites: DataFrame) -> DataFrame:
    """What an uninstall leaves of the metadata of these sites: a site that asked for its data to be deleted (delete_data) loses the
    tool's own keys, another keeps all."""
    asked = sites.groupBy("site_id").agg(F.max("delete_data").alias("delete_data"))
    rows = of_sites(spark, path, asked.where("delete_data"))
    kept = of_sites(spark, path, asked.where("not coalesce(delete_data, false)"))
    return retained_meta(rows).unionByName(kept)


def replace_sites(rows: DataFrame, path: str) -> None:
    """Puts `rows` in place of the folders of the sites that they belong to, and leaves all others as they are. `rows` must not
    be read from those folders."""
    rows.hint("rebalance", "site_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site_id").parquet(path)
