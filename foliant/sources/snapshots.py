"""Posts as a table in versions: data files that never change, a manifest of files for each version, and a pointer that only one
publisher can create.

    root/data/<commit>/       files that a commit added
    root/manifests/<commit>/  one row a file of the version: file
    root/commits/<commit>/    what became of each row of the plan
    root/versions/<number>    names the commit; created without overwriting, which is the compare-and-swap

A publisher joins its plan to the version that it reads (so what was edited meanwhile is refused row by row), rewrites only the
files that hold a row to be written, and creates the next version's pointer. If another was faster, its own files go (none are
rewritten where that shows before) and `Lost` is raised; it may read again and retry. Readers hold a version's files, whatever is published meanwhile. The folder's
file system must refuse to create a file that is there (HDFS does; of object stores, those with conditional puts).
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Lost(Exception):
    """Another publisher has made the version that this one was about to make."""


def _path(spark: SparkSession, name: str):
    """(file system, path)"""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _point(spark: SparkSession, root: str, version: int, commit: str) -> None:
    fs, path = _path(spark, f"{root}/versions/{version:09d}")
    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        if fs.exists(path):
            raise Lost(f"version {version} is there already") from e
        raise
    out.writeBytes(f"{commit}\n")
    out.close()


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last version, 0 if there is none."""
    fs, path = _path(spark, f"{root}/versions")
    return max((int(s.getPath().getName()) for s in fs.listStatus(path)), default=0) if fs.exists(path) else 0


def files(spark: SparkSession, root: str, version: int) -> list[str]:
    """The version's data files, by commit: as many names as any reader of the table has to list."""
    fs, path = _path(spark, f"{root}/versions/{version:09d}")
    stream = fs.open(path)
    commit = stream.readLine()
    stream.close()
    return [r["file"] for r in spark.read.schema("file string").parquet(f"{root}/manifests/{commit}").collect()]


def _name(path: str) -> str:
    """commit/file of a data file, so that a table may be moved."""
    return "/".join(path.rsplit("/", 2)[1:])


def _data(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{root}/data/{n}" for n in names])


def _commit(spark: SparkSession, root: str, version: int, commit: str, kept: list[str]) -> None:
    """Makes the version of the files kept and those that the commit has added."""
    names = [*kept, *map(_name, spark.read.parquet(f"{root}/data/{commit}").inputFiles())]
    spark.createDataFrame([(n,) for n in sorted(names)], "file string").coalesce(1).write.parquet(f"{root}/manifests/{commit}")
    _point(spark, root, version, commit)


def create(rows: DataFrame, root: str) -> int:
    """Writes version 1 of a new table: any columns, among them id and post_content."""
    spark, commit = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{root}/data/{commit}")
    _commit(spark, root, 1, commit, [])
    return 1


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest if none is named."""
    return _data(spark, root, files(spark, root, version or latest(spark, root)))


def publish(plan: DataFrame, root: str, version: int | None = None) -> DataFrame:
    """Writes what `plan` (post_id, status, source_hash, markup) says of the table at `root`, as the version after `version`
    (the latest, if none is named), and returns post_id, outcome of every row of the plan: written, refused (status isn't
    write), gone, stale (the body isn't the one that the plan was made for), unchanged or ambiguous (the plan has several rows
    to write for the post). Without a row to write no version is made."""
    spark, commit = plan.sparkSession, uuid.uuid4().hex
    version = version or latest(spark, root)
    names = files(spark, root, version)
    now = _data(spark, root, names).select(F.col("id").alias("_id"), F.md5("post_content").alias("_now"), F.regexp_extract("_metadata.file_path", "[^/]+/[^/]+$", 0).alias("_file"))
    wanted = F.col("status") == "write"
    repeated = plan.where(wanted).groupBy(F.col("post_id").alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    outcome = F.when(~F.coalesce(wanted, F.lit(False)), "refused").when(F.col("_again").isNotNull(), "ambiguous").when(F.col("_id").isNull(), "gone").when(~F.col("_now").eqNullSafe(F.col("source_hash")), "stale").when(F.md5("markup") == F.col("_now"), "unchanged").otherwise("written")
    joined = plan.select("post_id", "status", "source_hash", "markup").join(now, F.col("post_id") == F.col("_id"), "left").join(repeated, F.col("post_id") == F.col("_again"), "left")
    # written once: the files, the rewriting and the result all come from these rows
    joined.select("post_id", outcome.alias("outcome"), F.when(outcome == "written", F.col("_file")).alias("file"), F.when(outcome == "written", F.col("markup")).alias("markup")).write.parquet(f"{root}/commits/{commit}")
    checked = spark.read.parquet(f"{root}/commits/{commit}")
    touched = [r["file"] for r in checked.where("file is not null").select("file").distinct().collect()]
    if touched:
        old = _data(spark, root, touched)
        made = checked.where("outcome = 'written'").select(F.col("post_id").alias("_post"), F.col("markup").alias("_markup"))
        body = F.when(F.col("_post").isNotNull(), F.col("_markup")).otherwise(F.col("post_content"))
        new = old.join(made, F.col("id") == F.col("_post"), "left").withColumn("post_content", body).select(*[F.col(f"`{c}`") for c in old.columns])
        try:
            if latest(spark, root) > version:  # lost already: no file is rewritten for nothing
                raise Lost(f"version {version + 1} is there already")
            new.write.parquet(f"{root}/data/{commit}")
            _commit(spark, root, version + 1, commit, sorted(set(names) - set(touched)))
        except Lost:
            for part in ("data", "manifests", "commits"):
                fs, path = _path(spark, f"{root}/{part}/{commit}")
                fs.delete(path, True)
            raise
    return checked.select("post_id", "outcome")


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes pointers but for the last `keep` and data folders that none of those has a file of; returns how many folders
    went. For one that knows that no publisher is at work and no reader holds an older version."""
    last = latest(spark, root)
    fs, path = _path(spark, f"{root}/versions")
    held = {n for v in range(max(1, last - keep + 1), last + 1) for n in files(spark, root, v)}
    for s in fs.listStatus(path):
        if int(s.getPath().getName()) <= last - keep:
            fs.delete(s.getPath(), False)
    fs, path = _path(spark, f"{root}/data")
    gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in {n.split("/")[0] for n in held}]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
