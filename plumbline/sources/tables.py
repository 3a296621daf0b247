"""Tables of a dataset directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import materialize, small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a dataset directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(df: DataFrame, *key: str) -> DataFrame:
    """df with resent rows (exact copies under the same key) counted once. Rows whose key
    is null are no records and are left out. All columns of df are shuffled by the key, so
    this is for narrow tables; see first_rows."""
    return df.dropna(subset=list(key)).dropDuplicates(list(key))


def first_rows(rows: DataFrame, key: Column, kept: Column | None = None) -> DataFrame:
    """rows of a file-based table, one per key: the one that stands first by file and
    position. Rows with a null key, and those that do not satisfy kept, are left out.

    Only keys and positions are shuffled. The positions of the rows to leave out, few where
    rows are resent now and then, are broadcast if they are small and joined otherwise."""
    places = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    kept = key.isNotNull() if kept is None else key.isNotNull() & kept
    keys = rows.where(kept).select(key.alias("_key"), *places)
    place = F.struct("_file", "_row")
    again = keys.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    later = keys.join(again, "_key").where(place != F.col("first")).select("_file", "_row")
    later = materialize(later, "later")
    return rows.select("*", *places).where(kept).join(small(later), ["_file", "_row"], "left_anti").drop("_file", "_row")


def clean_path(path: Column) -> Column:
    """One spelling for a path: forward slashes, single, without ./ components."""
    slashes = F.regexp_replace(path, r"[\\/]+", "/")
    return F.regexp_replace(F.regexp_replace(slashes, r"/(\./)+", "/"), r"^(\./)+", "")


def project_of(path: Column) -> Column:
    """First component of a path."""
    return F.substring_index(path, "/", 1)


def extension_of(path: Column) -> Column:
    """Extension of the last component without its dot; null where there is none."""
    return F.nullif(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1), F.lit(""))
