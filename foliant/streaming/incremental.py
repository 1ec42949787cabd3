"""An extension, without a counterpart elsewhere: documents converted as their files arrive.

Conversion keeps no state between documents, so a stream is the batch job over each batch of new files; the sink's
checkpoint makes a batch that was cut short run again under its own number, into its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliant.operators import render
from foliant.sources.corpus import POSTS


def convert_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Converts posts from Parquet files that appear in `source`; each batch goes to target/batch=<number>, replacing what an
    attempt that failed left there. Stops when all present files are done."""

    def put(batch: DataFrame, number: int) -> None:
        render.convert(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    arriving = spark.readStream.schema(POSTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return arriving.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
