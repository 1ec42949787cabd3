"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(rows: DataFrame) -> DataFrame:
    """One column, json: each row as an object, for a page that lists them."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("json"))


def write_plan(plan: DataFrame, path: str, by: str = "status") -> None:
    """A plan as Parquet, one folder a status, so that a publisher reads only what is to be written."""
    plan.write.mode("errorifexists").partitionBy(by).parquet(path)
