"""Reports of finished runs: a header with metrics beside rows by case, written once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(cases: DataFrame, metrics: DataFrame, folder: str, *, run_id: str, dataset_id: str, finished_at: datetime) -> None:
    """Writes a run's cases (rows by case) and its metrics (one row) below folder; a finished report is never written over.

    The run and its data set must be named, and the time must say its zone. The header goes last, so a report with a header is
    whole.
    """
    if not run_id.strip() or not dataset_id.strip():
        raise ValueError("a report names its run and data set")
    if finished_at.tzinfo is None:
        raise ValueError("the time of a report says its zone")
    cases.write.mode("errorifexists").parquet(f"{folder}/cases")
    named = metrics.select(F.lit(run_id).alias("run_id"), F.lit(dataset_id).alias("dataset_id"), F.lit(finished_at.isoformat()).alias("finished_at"), F.to_json(F.struct(*metrics.columns)).alias("metrics"))
    named.coalesce(1).write.mode("errorifexists").json(f"{folder}/header")  # one row


def read_report(spark: SparkSession, folder: str, metrics: str) -> tuple[DataFrame, DataFrame]:
    """The header (run_id, dataset_id, finished_at, metrics as a struct of the given fields) and the cases of a report."""
    header = spark.read.schema("run_id string, dataset_id string, finished_at string, metrics string").json(f"{folder}/header")
    return header.withColumn("metrics", F.from_json("metrics", metrics)), spark.read.parquet(f"{folder}/cases")
