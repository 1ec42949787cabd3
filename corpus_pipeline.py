"""A training corpus from `documents`: quality rules, near-duplicates, personal data, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`. When a stage begins, the result of the one before has been
written, so the tables that its operators wrote on the way are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import mixing, packing, pii, quality, simhash
from foliant.llm.common import drop_tables, materialize, table, tables_made, whole_text, without
from foliant.llm.queries import CAPACITY, WEIGHTS, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _verdict_key(docs: DataFrame):
    """What a quality verdict depends on: text, language and source (null unlike '')."""
    return F.sha2(F.concat_ws(",", F.to_json(F.struct("lang", "source")), F.sha2(whole_text(), 256)), 256)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's outlier test reject go."""
    judged = quality.judge_quality(docs, _verdict_key(docs))
    rejected = judged.where(~F.col("kept")).select(F.col("_k0").alias("_key")).distinct()
    return without(docs.withColumn("_key", _verdict_key(docs)), materialize(rejected, "quality-rejected"), "_key").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.drop_near_duplicates(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds; n_chars follows the new text."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands in the result as often as the mix takes it: from not at all to three times."""
    mixed = mixing.mix(docs.select(*COLUMNS), WEIGHTS).where("_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, with its place in a sequence of at most 4,096 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), CAPACITY)


#: Tables that a stage's operators have written, by application, folder and stage.
_WRITTEN: dict[tuple[str, str, int], list[str]] = {}


def _stage(place: int, make):
    """The stage, which first lets go of what the one before it wrote on its way."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        drop_tables(spark, _WRITTEN.pop((application, sf_dir, place - 1), []))
        before = len(tables_made(spark))
        made = make(spark, docs, sf_dir)
        _WRITTEN[application, sf_dir, place] = tables_made(spark)[before:]
        return made

    return run_stage


STAGES = [
    (name, _stage(place, make))
    for place, (name, make) in enumerate((("quality rules", keep_quality), ("simhash near-dedup", drop_near_duplicates), ("pii", redact_personal_data), ("source mixing", mix_sources), ("best-fit packing", pack_sequences)))
]

#: Covariance estimates, fingerprints and tokens aren't expressible in SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
