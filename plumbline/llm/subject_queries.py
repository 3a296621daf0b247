"""Queries p8_: subject areas of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.subjects import Model, chamber, classify, fit, fold, training_rows
from plumbline.session import materialize
from plumbline.sources.tables import records, table

#: Documents to train on at most: labelled ones, and others whose header names a chamber.
TRAIN_LIMIT, HINT_LIMIT = 3000, 500
#: The subject of decisions that deal with nothing else.
FALLBACK = "procedure"


def _model(spark: SparkSession, sf_dir: str) -> Model:
    subjects = [(r.subject, r.title) for r in table(spark, sf_dir, "subjects").orderBy("subject").collect() if r.subject]
    rows = training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), TRAIN_LIMIT, HINT_LIMIT).collect()
    rows.sort(key=lambda r: (not r.labels, r.doc_id))
    by_title = {fold(t): s for s, t in subjects if t}
    hints = [by_title.get(chamber(r.text)) for r in rows]
    return fit([r.text for r in rows], [set(r.labels) for r in rows], hints, [s for s, _ in subjects], FALLBACK)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), _model(spark, sf_dir))


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents, and characters split evenly over a document's
    subjects. Documents without a case are under null."""
    texts = records(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars")), "doc_id")
    cases = materialize(found(spark, sf_dir), "subjects")
    each = cases.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    rows = texts.join(cases, "doc_id", "left").join(each, "doc_id", "left")
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.coalesce(F.col("chars"), F.lit(0)) / F.coalesce("k", F.lit(1))).alias("chars"))


QUERIES = {"p8_found": found, "p8_composition": composition}
SQL: dict[str, str] = {}
