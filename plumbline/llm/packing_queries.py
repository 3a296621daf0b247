"""Queries p6_: documents in containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.packing import pack
from plumbline.llm.tokens import VOCABULARY, token_counts
from plumbline.session import materialize
from plumbline.sources.tables import table


def sized_documents(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document once."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "source", "text")
    # resent rows are dropped after counting, when the texts need not be moved
    return materialize(token_counts(docs, "doc_id", "text", vocabulary, ["source"]).dropDuplicates(["doc_id"]), "tokens")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [(r.spec_id, r.capacity) for r in table(spark, sf_dir, "pack_specs").select("spec_id", "capacity").distinct().collect()]
    return pack(sized_documents(spark, sf_dir).select("doc_id", "tokens"), sorted(specs))


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per spec the containers, the tokens in them and how full they are."""
    each = containers(spark, sf_dir).groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    specs = table(spark, sf_dir, "pack_specs").select("spec_id", "capacity").distinct()
    total = each.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.join(specs, "spec_id").withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per spec the documents packed, and what must not be: containers beyond the capacity,
    documents in pieces that would fit whole, and documents whose tokens do not add up."""
    placed = materialize(containers(spark, sf_dir), "placed")
    specs = table(spark, sf_dir, "pack_specs").where("capacity > 0").select("spec_id", "capacity").distinct()
    full = placed.groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("n")).join(specs, "spec_id")
    full = full.groupBy("spec_id").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    docs = placed.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    docs = docs.join(specs, "spec_id").join(sized_documents(spark, sf_dir).select("doc_id", F.col("tokens").alias("size")), "doc_id", "left")
    docs = docs.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity"))).alias("split"), F.count_if(~F.col("n").eqNullSafe(F.col("size"))).alias("changed")
    )
    return docs.join(full, "spec_id").select("spec_id", "documents", "overfull", "split", "changed")


QUERIES = {"p6_containers": containers, "p6_fill": fill, "p6_violations": violations}
SQL = {
    "p6_violations": """SELECT spec_id, documents, 0::BIGINT AS overfull, 0::BIGINT AS split, 0::BIGINT AS changed FROM (SELECT DISTINCT spec_id FROM pack_specs WHERE capacity > 0),
(SELECT count(DISTINCT doc_id) AS documents FROM documents WHERE length(text) > 0)"""
}
