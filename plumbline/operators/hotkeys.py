"""Per-key results where a few keys hold most rows.

Value-frequency compression: rows are grouped by key *and* value first, so that a hot key
is spread over as many groups as it has values and each of them shrinks on the map side;
only the (key, value, weight) rows are then grouped by key, and every per-key result is
derived from the weighted values. No group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import materialize


def compress_values(df: DataFrame, key: str, value: str, place: str | None = None) -> DataFrame:
    """(key, value, weight, first_place): one row per key and value with the number of
    rows and the smallest place. Rows with a null key have no key and are left out; a null
    value is a value of its own with a weight. Null places are ignored. Other columns of
    df, whatever their names, are not looked at. An empty table gives no rows."""
    rows = df.select(F.col(key).alias("key"), F.col(value).alias("value"), (F.col(place) if place else F.lit(None)).alias("place"))
    return (
        rows.where("key IS NOT NULL")
        .groupBy("key", "value")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("place").alias("first_place"))
    )


def key_results(weighted: DataFrame) -> DataFrame:
    """(key, entries, distinct_values, mode_value, mode_weight, first_place) of the rows
    that compress_values gives. A null value counts in entries but is neither a distinct
    value nor a mode; ties of the mode go to the smallest value."""
    modes = weighted.groupBy("key", "weight").agg(
        F.min("value").alias("value"),
        F.sum("weight").alias("entries"),
        F.count("value").alias("n"),
        F.min("first_place").alias("first_place"),
    )
    rank = F.when(F.col("value").isNotNull(), F.col("weight"))
    return modes.groupBy("key").agg(
        F.sum("entries").alias("entries"),
        F.sum("n").alias("distinct_values"),
        F.max_by("value", rank).alias("mode_value"),
        F.max(rank).alias("mode_weight"),
        F.min("first_place").alias("first_place"),
    )


def weighted_percentiles(weighted: DataFrame, probs: list[float]) -> DataFrame:
    """(key, p, value): exact percentiles per key (the smallest value whose cumulative
    weight reaches p of the key's weight), from the rows of compress_values. Null values
    are left out.

    Rows are cut into ranges of (key, value) of about equal size, so that a key with many
    values is spread over many ranges; weights are summed per range and key, and only the
    ranges that hold a target are looked into."""
    rows = weighted.where("value IS NOT NULL").select("key", "value", "weight")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows.repartitionByRange(parts, "key", "value").withColumn("part", F.spark_partition_id()), "ranges")
    sums = rows.groupBy("key", "part").agg(F.sum("weight").alias("s"))
    by_key = W.partitionBy("key")
    sums = sums.withColumn("upto", F.sum("s").over(by_key.orderBy("part").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("s").over(by_key))
    targets = sums.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("want", F.greatest(F.col("p") * F.col("total"), F.lit(1.0)))
    targets = targets.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("s") < F.col("want")))
    targets = targets.select("key", "part", "p", (F.col("want") - (F.col("upto") - F.col("s"))).alias("left"))
    within = W.partitionBy("key", "part").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    steps = rows.join(targets.select("key", "part").distinct(), ["key", "part"], "left_semi").withColumn("reached", F.sum("weight").over(within))
    return steps.join(targets, ["key", "part"]).where("reached >= left").groupBy("key", "p").agg(F.min("value").alias("value"))


def heavy_keys(weighted: DataFrame, total: int, least: int, share: float) -> DataFrame:
    """Results of the keys with at least `least` entries and `share` of `total`."""
    return key_results(weighted).where((F.col("entries") >= least) & (F.col("entries") >= share * total))
