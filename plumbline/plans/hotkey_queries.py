"""Queries p5_: results per hash and per path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.hotkeys import compress_values, heavy_keys, key_results, weighted_percentiles
from plumbline.sources.tables import records, table


def _hash_entries(spark: SparkSession, sf_dir: str, resent: bool) -> DataFrame:
    rows = table(spark, sf_dir, "hash_sequence").select("file_id", "pos", "h")
    return (rows if resent else records(rows, "file_id", "pos")).withColumn("place", F.struct("file_id", "pos"))


def _path_entries(spark: SparkSession, sf_dir: str, resent: bool) -> DataFrame:
    rows = table(spark, sf_dir, "duplicates").select("dup_id", "file_id", "occurrences")
    rows = rows if resent else records(rows, "dup_id")
    return rows.select("dup_id", "file_id", F.posexplode("occurrences").alias("idx", "o")).select(
        "file_id", F.col("o.path").alias("path"), F.struct("file_id", "dup_id", F.col("idx").alias("idx")).alias("place")
    )


def found(spark: SparkSession, sf_dir: str, least: int = 25, share: float = 0.01) -> DataFrame:
    """Keys with at least `least` entries and `share` of all entries of their kind."""
    total_h = table(spark, sf_dir, "hash_sequence").count()
    total_path = table(spark, sf_dir, "duplicates").agg(F.sum(F.size("occurrences").cast("long") * F.col("occurrences").isNotNull().cast("long"))).first()[0] or 0
    hashes = compress_values(_hash_entries(spark, sf_dir, True), "h", "file_id")
    paths = compress_values(_path_entries(spark, sf_dir, True), "path", "file_id")
    pick = lambda kind, df, total: heavy_keys(df, total, least, share).select(
        F.lit(kind).alias("key_kind"), F.col("key").cast("string").alias("key_value")
    )
    return pick("h", hashes, total_h).unionByName(pick("path", paths, total_path))


def hash_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = compress_values(_hash_entries(spark, sf_dir, False), "h", "file_id", "place")
    return key_results(weighted).select(
        F.col("key").alias("h"), "entries", F.col("distinct_values").alias("files"), F.col("mode_value").alias("mode_file_id"),
        F.col("mode_weight").alias("mode_entries"), F.col("first_place.file_id").alias("first_file_id"), F.col("first_place.pos").alias("first_pos"),
    )


def path_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = compress_values(_path_entries(spark, sf_dir, False), "path", "file_id", "place")
    return key_results(weighted).select(
        F.col("key").alias("path"), "entries", F.col("distinct_values").alias("files"),
        F.col("first_place.file_id").alias("first_file_id"), F.col("first_place.dup_id").alias("first_dup_id"), F.col("first_place.idx").alias("first_idx"),
    )


def path_line_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(table(spark, sf_dir, "duplicates").select("dup_id", "occurrences"), "dup_id")
    lines = rows.select(F.explode("occurrences").alias("o")).select(F.col("o.path").alias("path"), F.col("o.line").alias("line"))
    return weighted_percentiles(compress_values(lines, "path", "line"), [0.5, 0.9, 0.99]).select(
        F.col("key").alias("path"), "p", F.col("value").alias("line")
    )


QUERIES = {"p5_found": found, "p5_hash_results": hash_results, "p5_path_results": path_results, "p5_path_line_percentiles": path_line_percentiles}

_H = "(SELECT DISTINCT file_id, pos, h FROM hash_sequence WHERE file_id IS NOT NULL AND pos IS NOT NULL)"
_O = "(SELECT dup_id, file_id, generate_subscripts(occurrences, 1) - 1 AS idx, unnest(occurrences) AS o FROM (SELECT dup_id, any_value(file_id) AS file_id, any_value(occurrences) AS occurrences FROM duplicates WHERE dup_id IS NOT NULL GROUP BY dup_id))"

SQL = {
    "p5_found": """
WITH e AS (SELECT h FROM hash_sequence), o AS (SELECT unnest(occurrences).path AS path FROM duplicates)
SELECT 'h' AS key_kind, CAST(h AS VARCHAR) AS key_value FROM e WHERE h IS NOT NULL GROUP BY h
HAVING count(*) >= 25 AND count(*) >= 0.01 * (SELECT count(*) FROM e)
UNION ALL
SELECT 'path', path FROM o WHERE path IS NOT NULL GROUP BY path
HAVING count(*) >= 25 AND count(*) >= 0.01 * (SELECT count(*) FROM o)""",
    "p5_hash_results": f"""
WITH e AS {_H}, w AS (SELECT h, file_id, count(*) AS n FROM e WHERE h IS NOT NULL GROUP BY h, file_id),
m AS (SELECT h, file_id, n, row_number() OVER (PARTITION BY h ORDER BY n DESC, file_id) AS r FROM w),
f AS (SELECT h, file_id, pos, row_number() OVER (PARTITION BY h ORDER BY file_id, pos) AS r FROM e WHERE h IS NOT NULL),
t AS (SELECT h, CAST(sum(n) AS BIGINT) AS entries, count(*) AS files FROM w GROUP BY h)
SELECT t.h, entries, files, m.file_id AS mode_file_id, m.n AS mode_entries, f.file_id AS first_file_id, f.pos AS first_pos
FROM t JOIN m ON m.h = t.h AND m.r = 1 JOIN f ON f.h = t.h AND f.r = 1""",
    "p5_path_results": f"""
WITH e AS (SELECT o.path AS path, file_id, dup_id, CAST(idx AS INTEGER) AS idx FROM {_O}),
f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY file_id, dup_id, idx) AS r FROM e WHERE path IS NOT NULL),
t AS (SELECT path, count(*) AS entries, count(DISTINCT file_id) AS files FROM e WHERE path IS NOT NULL GROUP BY path)
SELECT t.path, entries, files, f.file_id AS first_file_id, f.dup_id AS first_dup_id, f.idx AS first_idx
FROM t JOIN f ON f.path = t.path AND f.r = 1""",
    "p5_path_line_percentiles": f"""
WITH e AS (SELECT o.path AS path, o.line AS line FROM {_O})
SELECT path, unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS p, unnest(quantile_disc(line, [0.5, 0.9, 0.99])) AS line
FROM e WHERE path IS NOT NULL AND line IS NOT NULL GROUP BY path""",
}
