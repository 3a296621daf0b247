"""Session helpers: where intermediate tables go, and size checks for broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, that this library broadcasts by its own hint.
BROADCAST_LIMIT = 8 << 20

_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "plumbline", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. The session's spark.checkpoint.dir is used; only
    where that is unset, as in tests on one machine, a temporary folder is made."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage and keeps a result that several branches use from being
    computed more than once; a lost executor costs nothing, as the files are shared."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/plumbline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release(since: int = 0) -> None:
    """Remove the tables that materialize wrote, those from number `since` on; results that
    read them end here."""
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone; its shared folder is the cluster's to clean
            pass


@contextmanager
def intermediate() -> Iterator[None]:
    """A scope whose intermediate tables are removed at its end. Operators write such tables
    while they are called; what they return has to be written or collected inside."""
    since = len(_written)
    try:
        yield
    finally:
        release(since)


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast of df if the optimizer's own estimate of its size is under limit;
    beyond it the planner chooses, which then means a shuffled join."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def fenced(df: DataFrame, *columns: str) -> DataFrame:
    """df as it is, with a fence around columns that are costly to compute: a filter on one of
    them is not pushed below, where the optimizer would repeat all of its expression."""
    others = [c for c in df.columns if c not in columns]
    rows = df.select(*others, F.explode_outer(F.array(F.struct(*columns))).alias("_fenced"))
    return rows.select(*others, *[F.col(f"_fenced.{c}").alias(c) for c in columns])
