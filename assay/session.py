"""A local SparkSession for the command line, the benchmark and the tests; what any session keeps on disk."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Frames made and run in here leave no shuffle files once their result is there. Of a frame that is persisted they stay."""
    before = spark.conf.get(_DROPS, None)
    spark.conf.set(_DROPS, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROPS) if before is None else spark.conf.set(_DROPS, before)


def kept(df: DataFrame) -> DataFrame:
    """df written and read again: scratch under spark.checkpoint.dir (a local master may do without that setting), removed when the driver ends.

    What made it is let go, where persist() would hold on to its shuffles. Without a shared folder it is persisted."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            return df.persist()
        base = "/tmp/checkpoints/assay"
    path = f"{base.rstrip('/')}/assay-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already; the folder is scratch
            pass

    atexit.register(remove)
    with shuffles_dropped(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cpus: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """The active session, or a new local one. On a cluster, spark-submit has made one already."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("assay")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
