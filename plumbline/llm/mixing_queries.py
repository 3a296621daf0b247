"""Queries p7_: mixes of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.mixing import clean_source, mix, mix_shares
from plumbline.llm.packing_queries import sized_documents
from plumbline.session import materialize
from plumbline.sources.tables import table


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(materialize(selection(spark, sf_dir), "mix"), table(spark, sf_dir, "mix_targets"))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and source with a positive weight, what must not be: documents used too often,
    used in two rows, or of another source; and whether the source misses its share of the
    mix by more than a thousandth and more than one document, though its cap allows it."""
    sized = sized_documents(spark, sf_dir)
    chosen = materialize(mix(sized, table(spark, sf_dir, "mix_targets")), "mix")
    docs = sized.select("doc_id", clean_source(F.col("source")).alias("own"), F.col("tokens").alias("size"))
    targets = table(spark, sf_dir, "mix_targets").where("weight > 0").groupBy("mix_id", clean_source(F.col("source")).alias("source")).agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("cap"))
    each = chosen.groupBy("mix_id", "source", "doc_id").agg(F.sum("repeats").alias("uses"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("repeats") * F.col("tokens")).alias("used")).join(docs, "doc_id", "left")
    each = each.groupBy("mix_id", "source").agg(F.max("uses").alias("most"), F.sum((F.col("rows") - 1).cast("long")).alias("twice"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("strange"), F.sum("used").alias("used"))
    corpus = docs.where("size > 0 AND doc_id IS NOT NULL").groupBy(F.col("own").alias("source")).agg(F.sum("size").alias("there"), F.max("size").alias("largest"))
    rows = targets.join(corpus, "source", "left").join(each, ["mix_id", "source"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    # sources that are used up as often as allowed leave the rest of the mix to the others
    full = zero("used") >= zero("cap") * zero("there")
    open_ = rows.where(~full).groupBy("mix_id").agg(F.sum("used").alias("mix"), F.sum("weight").alias("weights"))
    rows = rows.join(open_, "mix_id", "left")
    miss = F.abs(F.col("used") - F.col("mix") * F.col("weight") / F.col("weights"))
    missed = ~full & (miss > F.greatest(0.001 * F.col("mix"), F.col("largest")))
    return rows.select("mix_id", "source", F.coalesce(F.col("most") > F.col("cap"), F.lit(False)).alias("too_often"), zero("twice").cast("long").alias("twice"), zero("strange").cast("long").alias("strange"), F.coalesce(missed, F.lit(False)).alias("missed"))


QUERIES = {"p7_selection": selection, "p7_shares": shares, "p7_violations": violations}
SQL = {
    "p7_violations": """SELECT DISTINCT mix_id, lower(trim(source)) AS source, false AS too_often, 0::BIGINT AS twice, 0::BIGINT AS strange, false AS missed FROM mix_targets WHERE weight > 0 AND NOT isnan(weight)"""
}
