"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the character class of the word definition `[^\x20\x09-\x0D]+`.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bits of the filters of `maybe_in` and `without`: 8 MB in all, whatever the corpus.
FILTER_BITS, SEGMENT_BITS = 1 << 26, 1 << 15
#: Bytes of rows that go to Python at once. Whole texts differ in size, so batches are bounded by it and not only by rows.
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one, but only where
    driver and executors are one process (tests); elsewhere executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="foliant-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other table has."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_intermediates(spark: SparkSession) -> None:
    """Deletes the tables that this application's operators wrote to cut lineage: for a job to call once the results that
    depend on them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Paths of the tables that `materialize` wrote, by application and the driver's thread.
_MADE: dict[tuple[str, int], list[str]] = {}


def _mine(spark: SparkSession) -> list[str]:
    return _MADE.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


def tables_made(spark: SparkSession) -> list[str]:
    """Paths of the tables that operators have written to cut lineage, in order; jobs of other threads not among them."""
    return list(_mine(spark))


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of `tables_made` that no result to come depends on."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches, rows: int = 500):
    """The batches in slices of so many rows: what Python holds of a batch at once stays small. After the last one the memory that
    the task has freed goes back, as the worker lives on for tasks of other stages."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and what was
    not deterministic (row ids, ties) is the same for every later reader, whatever executors are lost. From then on the
    session hands rows to Python in batches of BATCH_BYTES."""
    path = new_path(df.sparkSession, label)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.write.parquet(path)
    _mine(df.sparkSession).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, '' for null."""
    return F.coalesce(F.col(name), F.lit(""))


def utf8_size(name: str = "text") -> Column:
    return F.octet_length(whole_text(name)).cast("long")


def join_small(left: DataFrame, right: DataFrame, on, how: str, rows: int, bound: int = 50_000) -> DataFrame:
    """Join with `right` broadcast only if its counted rows are within `bound`; else Spark shuffles
    both sides and adaptive execution splits hot keys."""
    return left.join(F.broadcast(right) if rows <= bound else right, on, how)


def running_offsets(counts: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive prefix sums of `value` within `group` along `order`; `counts` has one row a bucket, not a document."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def _flagged(rows: DataFrame, digests: DataFrame, column: str) -> DataFrame:
    """`rows` with _maybe: may `column` (hex digits, eight or more) be among `digests` (the same column)? Never false for one
    that is; true for others about as often as bits are set. The set bits are broadcast, in FILTER_BITS / SEGMENT_BITS rows
    of 4 KB at most."""
    bit = F.conv(F.substring(column, 1, 8), 16, 10).cast("long") % FILTER_BITS
    segment, within = F.floor(bit / SEGMENT_BITS), bit % SEGMENT_BITS
    filled = digests.groupBy(segment.alias("_segment")).agg(F.bitmap_construct_agg(within).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(filled), segment == F.col("_segment"), "left")
    return found.withColumn("_maybe", F.coalesce(F.getbit(byte, (within % 8).cast("int")) == 1, F.lit(False))).drop("_segment", "_bits")


def maybe_in(rows: DataFrame, digests: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` may be among `digests`: a sieve before a join, so that most of the others never move."""
    return _flagged(rows, digests, column).where("_maybe").drop("_maybe")


def without(rows: DataFrame, digests: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` is not among `digests`: an anti-join in which only rows that may be among them move. `rows` is
    read twice."""
    flagged = _flagged(rows, digests, column)
    doubtful = flagged.where("_maybe").join(digests.select(column), column, "left_anti")
    return flagged.where("not _maybe").unionByName(doubtful).drop("_maybe")
