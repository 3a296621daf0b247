"""Queries p2_: files that were not written by hand in their project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.origin import file_labels
from plumbline.sources.tables import table


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").select("file_id", "path", "content")
    return file_labels(files, table(spark, sf_dir, "metrics").select("file_id", "lines", "repetition", "run_ts"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).where("label <> 'handwritten'").select("file_id")


QUERIES = {"p2_found": found, "p2_labels": labels}
SQL: dict[str, str] = {}
