"""What of a table stands in a Python worker at once: bounded by characters, so that it doesn't grow with a task's rows."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of rows that go to Python at once, of text that is parsed at once (a longer text alone), and rows of such a part.
BATCH_BYTES, PART_BYTES, PART_ROWS = 4 << 20, 256 << 10, 500


def bound(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def parts(batches, column: int):
    """The batches in parts of PART_BYTES of text in the column. After the last one the memory that the task has freed goes back, as
    the worker lives on for tasks of other stages."""
    for b in batches:
        first = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
            if i > first and (held + n > PART_BYTES or i - first == PART_ROWS):
                yield b.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < b.num_rows:
            yield b.slice(first)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)
