"""Token counts with a digest cache: only contents that the cache has not counted are encoded, and then appended."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_in, slices, utf8_size, whole_text

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
def read_cache(spark, path: str) -> DataFrame:
    """The cache's table; empty where nothing was ever appended. Asks Spark's own file system, as a path may be remote."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of `docs` (doc_id, text).

    Normalised content is the text, '' for null. Equal texts share one cache row; repeated rows and null ids are
    kept as they come; an empty text has 0 tokens; an empty table appends nothing. Other columns are ignored.
    Misses are appended as they are first met; two jobs that append the same content at once leave two equal rows,
    which are read as one.
    """
    from .tokens import tokenizer_digest, word_tokenizer

    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    keyed = docs.select("doc_id", whole_text().alias("text"), utf8_size().alias("n_bytes")).withColumn("content", F.sha2("text", 256))
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    missing = materialize(keyed.select("content").distinct().join(known, "content", "left_anti"), "token-misses")
    n = missing.count()

    def encode(batches):
        tokenizer = word_tokenizer(tokenizer_path)
        for b in slices(batches):
            sizes = [len(x) // 4 for x in tokenizer.ids(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(sizes), pa.string()), pa.array(sizes, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    if n:
        # texts that the cache knows don't move; those that it may not know meet the misses and their equals in one shuffle
        texts = keyed.select("content", "text")
        if not known.isEmpty():
            texts = maybe_in(texts, missing, "content")
        texts = texts.join(missing, "content", "left_semi").groupBy("content").agg(F.first("text").alias("text"))
        texts.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # written, so that the last join reads plain rows on both sides and adaptive execution can split a content that very
    # many documents share
    counts = materialize(read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keyed.select("doc_id", "n_bytes", "content").join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens")
