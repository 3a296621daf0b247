"""Queries p1_: stretches that stand verbatim in more than one record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.spans import sequence_pieces, shared_spans, text_pieces
from plumbline.session import materialize
from plumbline.sources.tables import table

CONTENT_SPAN, HASH_SPAN = 128, 20


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = text_pieces(table(spark, sf_dir, "duplicates").select("dup_id", "content"), "dup_id", "content")
    hashes = sequence_pieces(table(spark, sf_dir, "hash_sequence").select("file_id", "pos", "h"), "file_id", "pos", "h", HASH_SPAN)
    content = shared_spans(texts, CONTENT_SPAN, gram=48)
    lines = shared_spans(materialize(hashes, "hashes"), HASH_SPAN, gram=6)
    kind = lambda df, name: df.select(F.lit(name).alias("rec_kind"), "rec_id", "from_pos", "to_pos")
    return kind(content, "content").unionByName(kind(lines, "hashes"))


def record_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every record its length, the number of its shared stretches, their total and the
    longest; a record that shares nothing has zeros."""
    length = F.col("to_pos") - F.col("from_pos") + 1
    sums = found(spark, sf_dir).groupBy("rec_kind", "rec_id").agg(F.count(F.lit(1)).alias("stretches"), F.sum(length).alias("shared_total"), F.max(length).alias("longest"))
    texts = table(spark, sf_dir, "duplicates").where("dup_id IS NOT NULL AND content IS NOT NULL").groupBy(F.col("dup_id").alias("rec_id")).agg(F.max(F.length("content")).cast("long").alias("length"))
    lines = table(spark, sf_dir, "hash_sequence").where("file_id IS NOT NULL AND pos IS NOT NULL").groupBy(F.col("file_id").alias("rec_id")).agg((F.max("pos") + 1).cast("long").alias("length"))
    every = texts.select(F.lit("content").alias("rec_kind"), "*").unionByName(lines.select(F.lit("hashes").alias("rec_kind"), "*"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return every.join(sums, ["rec_kind", "rec_id"], "left").select("rec_kind", "rec_id", "length", zero("stretches"), zero("shared_total"), zero("longest"))


QUERIES = {"p1_found": found, "p1_record_shares": record_shares}

_SQL = """
WITH d AS (SELECT dup_id, any_value(content) AS content FROM duplicates WHERE dup_id IS NOT NULL AND content IS NOT NULL GROUP BY dup_id),
cw AS (SELECT 'content' AS rec_kind, dup_id AS rec_id, i AS pos, 128 AS n, substring(content, CAST(i + 1 AS INTEGER), 128) AS w
  FROM (SELECT dup_id, content, unnest(range(length(content) - 127)) AS i FROM d WHERE length(content) >= 128)),
s AS (SELECT DISTINCT file_id, pos, h FROM hash_sequence WHERE file_id IS NOT NULL AND pos IS NOT NULL),
hw AS (SELECT 'hashes' AS rec_kind, file_id AS rec_id, pos, 20 AS n, w FROM (
  SELECT file_id, pos, count(h) OVER f AS c, string_agg(CAST(h AS VARCHAR), ',') OVER f AS w
  FROM s WINDOW f AS (PARTITION BY file_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) WHERE c = 20),
windows AS (SELECT * FROM cw UNION ALL SELECT * FROM hw),
known AS (SELECT rec_kind, w FROM windows GROUP BY rec_kind, w HAVING min(rec_id) <> max(rec_id)),
hits AS (SELECT rec_kind, rec_id, pos, n, lag(pos) OVER (PARTITION BY rec_kind, rec_id ORDER BY pos) AS before FROM windows SEMI JOIN known USING (rec_kind, w)),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR pos > before + n THEN 1 ELSE 0 END) OVER (PARTITION BY rec_kind, rec_id ORDER BY pos) AS run FROM hits),
spans AS (SELECT rec_kind, rec_id, CAST(min(pos) AS BIGINT) AS from_pos, CAST(max(pos) + max(n) - 1 AS BIGINT) AS to_pos FROM runs GROUP BY rec_kind, rec_id, run)
"""

SQL = {
    "p1_found": _SQL + "SELECT rec_kind, rec_id, from_pos, to_pos FROM spans",
    "p1_record_shares": _SQL + """, r AS (SELECT 'content' AS rec_kind, dup_id AS rec_id, length(content) AS length FROM d UNION ALL SELECT 'hashes', file_id, max(pos) + 1 FROM s GROUP BY file_id)
SELECT r.rec_kind, r.rec_id, any_value(length) AS length, count(from_pos) AS stretches, CAST(coalesce(sum(to_pos - from_pos + 1), 0) AS BIGINT) AS shared_total,
coalesce(max(to_pos - from_pos + 1), 0) AS longest FROM r LEFT JOIN spans USING (rec_kind, rec_id) GROUP BY r.rec_kind, r.rec_id""",
}
