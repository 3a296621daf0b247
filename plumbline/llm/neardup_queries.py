"""Queries p3_: records that differ only by small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.neardup import record_links, similar_classes, similar_pairs
from plumbline.llm.spans import sequence_pieces
from plumbline.session import materialize
from plumbline.sources.tables import table

WIDTH, THRESHOLD = 3, 0.5


def _each_kind(spark: SparkSession, sf_dir: str, result) -> DataFrame:
    texts = table(spark, sf_dir, "duplicates").select(F.col("dup_id").alias("rec_id"), F.col("content").alias("seq"))
    hashes = sequence_pieces(table(spark, sf_dir, "hash_sequence").select("file_id", "pos", "h"), "file_id", "pos", "h", 1, 1 << 40)
    kinds = {"content": texts, "hashes": materialize(hashes.select("rec_id", "seq"), "hashes")}
    out = [result(*similar_classes(df, WIDTH, THRESHOLD)).select(F.lit(kind).alias("rec_kind"), "*") for kind, df in kinds.items()]
    return out[0].unionByName(out[1])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_kind(spark, sf_dir, similar_pairs)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_kind(spark, sf_dir, record_links)


QUERIES = {"p3_found": found, "p3_groups": groups}

_SQL = r"""
WITH d AS (SELECT dup_id, any_value(content) AS content FROM duplicates WHERE dup_id IS NOT NULL AND content IS NOT NULL GROUP BY dup_id),
w AS (SELECT dup_id AS id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT dup_id, regexp_extract_all(content, '[A-Za-z0-9_]+') AS x FROM d)),
e AS (SELECT 'content' AS rec_kind, id, i, lower(t) AS t FROM w
  UNION ALL SELECT 'hashes', file_id, pos, CAST(h AS VARCHAR) FROM (SELECT DISTINCT file_id, pos, h FROM hash_sequence WHERE file_id IS NOT NULL AND pos IS NOT NULL)),
g AS (SELECT rec_kind, id, t, lead(t, 1) OVER o AS t2, lead(t, 2) OVER o AS t3 FROM e WINDOW o AS (PARTITION BY rec_kind, id ORDER BY i)),
s AS (SELECT DISTINCT rec_kind, id, t || ' ' || t2 || ' ' || t3 AS t FROM g WHERE t IS NOT NULL AND t2 IS NOT NULL AND t3 IS NOT NULL),
n AS (SELECT rec_kind, id, count(*) AS n FROM s GROUP BY rec_kind, id),
c AS (SELECT a.rec_kind, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.rec_kind = b.rec_kind AND a.t = b.t AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT c.rec_kind, id_a, id_b, x.n = c AND y.n = c AS equal FROM c JOIN n x ON x.rec_kind = c.rec_kind AND x.id = id_a JOIN n y ON y.rec_kind = c.rec_kind AND y.id = id_b
  WHERE c >= 0.5 * (x.n + y.n - c))
"""

SQL = {
    "p3_found": _SQL + "SELECT rec_kind, id_a, id_b FROM pairs",
    "p3_groups": _SQL + """, ends AS (SELECT rec_kind, id_a AS id, id_b AS o, equal FROM pairs UNION ALL SELECT rec_kind, id_b, id_a, equal FROM pairs)
SELECT n.rec_kind, n.id AS rec_id, least(n.id, min(o) FILTER (WHERE equal)) AS class_id, count(*) FILTER (WHERE equal) AS copies, count(*) FILTER (WHERE NOT equal) AS links
FROM n LEFT JOIN ends e ON e.rec_kind = n.rec_kind AND e.id = n.id GROUP BY n.rec_kind, n.id""",
}
