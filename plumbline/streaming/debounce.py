"""Edits of documents: only the last of a burst is worth analysing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The pause after an edit, as an interval.
PAUSE = "300 milliseconds"


#: Pauses in a stretch of time that is looked at on its own.
STRETCH = 1000


def debounce(edits: DataFrame, pause: str = PAUSE) -> DataFrame:
    """The edits(uri, ts, ...) that no other edit of the same document follows within pause.
    Of edits at the same instant one stays; rows with a null uri or ts are left out.

    A document is cut into stretches of time, which only need to know when the next one
    begins, so that one with a large part of all edits is no single task."""
    at = F.col("ts")
    if dict(edits.dtypes)["ts"] == "timestamp_ntz":  # in any zone, but always in the same
        at = F.concat(at.cast("string"), F.lit("Z")).cast("timestamp")
    start = F.lit("1970-01-01 00:00:00 UTC").cast("timestamp")
    width = (F.unix_micros(start + F.expr(f"INTERVAL {pause}")) - F.unix_micros(start)) * STRETCH
    rows = edits.where("uri IS NOT NULL AND ts IS NOT NULL").withColumn("_stretch", F.floor(F.unix_micros(at) / width))
    begins = rows.groupBy("uri", (F.col("_stretch") - 1).alias("_stretch")).agg(F.min("ts").alias("_begin"))
    after = F.lead("ts").over(W.partitionBy("uri", "_stretch").orderBy("ts"))
    rows = rows.withColumn("_next", after).join(begins, ["uri", "_stretch"], "left").withColumn("_next", F.coalesce("_next", "_begin"))
    quiet = F.col("_next").isNull() | (F.col("_next") >= F.col("ts") + F.expr(f"INTERVAL {pause}"))
    return rows.where(quiet).select(*edits.columns)


def debounce_stream(edits: DataFrame, pause: str = PAUSE, late: str = "10 seconds") -> DataFrame:
    """(uri, text, ts) of a stream edits(uri, text, ts): the last text of every burst, once
    the watermark has passed its end. A burst is a session of gap `pause`."""
    bursts = edits.withWatermark("ts", late).groupBy("uri", F.session_window("ts", pause))
    return bursts.agg(F.max_by("text", "ts").alias("text"), F.max("ts").alias("ts")).select("uri", "text", "ts")


def opened(edits: DataFrame) -> DataFrame:
    """Edits of kind 'open', which are analysed at once, whatever follows."""
    return edits.where(F.col("kind") == "open")


def to_analyse(edits: DataFrame, pause: str = PAUSE) -> DataFrame:
    """What of edits(uri, ts, kind, ...) is analysed: all of kind 'open', and of the others
    those that no other of their kind follows within pause."""
    changes = edits.where(F.coalesce(F.col("kind") != "open", F.lit(True)))
    return opened(edits).unionByName(debounce(changes, pause))


def read_edits(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of edits(uri, kind, text, ts) from a folder into which an editor's bridge
    writes JSON lines; every change holds the whole text."""
    return spark.readStream.schema("uri string, kind string, text string, ts timestamp").json(folder)
