"""Session set-up, durable scratch space and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "shelfmark", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and staged tables.

    The cluster names it in ``spark.checkpoint.dir``; the session has its own folder in
    there, with its file system in the name. A temporary folder is made
    only for a local master that names none, since other machines cannot see it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="shelfmark-")
        sc.setCheckpointDir(named)
    folder = sc.getCheckpointDir()
    if folder not in _OWN:
        _OWN.add(folder)
        atexit.register(_forget, spark, folder)
    return folder


_OWN: set[str] = set()


def _forget(spark: SparkSession, folder: str) -> None:
    """Delete the session's own folder, which lies inside the named one, at its end."""
    with contextlib.suppress(Py4JError, OSError):  # the session may be gone already
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage in reliable storage, so that retries see the same rows."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches of a plan read, and read it back: the branches
    then share one computation, columnar files and their statistics."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Give CPU-heavy row work all cores when a scan has fewer partitions than there are task
    slots (a small or badly split table). Wider inputs stay as they are, with no shuffle. Rows
    go by ``key``, an id, or in turn."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots) if key is None else df.repartition(slots, key)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
