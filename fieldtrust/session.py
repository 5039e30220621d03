"""Session helpers: a local session for tests and bench, and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DIR_CONF = "spark.checkpoint.dir"
_SCOPE_CONF = "fieldtrust.scratch"
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "fieldtrust", cpus: int | str = 8, **conf: str) -> SparkSession:
    """Session for tests and the bench. A cluster job passes its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config(_DIR_CONF, f"file:///tmp/fieldtrust/{uuid.uuid4().hex}")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # Call-site capture doubles the time it takes to build a large plan from Python.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    On a cluster the missing setting is an error. A local session without it, where driver and
    executors are one process, gets a folder of its application.
    """
    path = spark.conf.get(_DIR_CONF, None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_DIR_CONF} to a folder shared by all executors")
    return f"file:///tmp/fieldtrust/{spark.sparkContext.applicationId}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Everything written to the shared folder inside the block is deleted when it ends.

    Results that are needed afterwards must be written elsewhere, or collected, inside the block.
    """
    before = spark.conf.get(_SCOPE_CONF, "")
    own = f"{before}/{uuid.uuid4().hex}"
    spark.conf.set(_SCOPE_CONF, own)
    try:
        yield f"{shared_dir(spark)}{own}"
    finally:
        spark.conf.set(_SCOPE_CONF, before)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}{own}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """New, unused path below the shared folder."""
    return f"{shared_dir(spark)}{spark.conf.get(_SCOPE_CONF, '')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """The rows, computed once and read back from a table in the shared folder.

    For an intermediate result that several branches prune to different columns, so that Spark
    cannot reuse one shuffle for them. A written table also outlives lost executors.

    ``lean`` is for tables about as large as the input: they are packed tighter, and what was shuffled
    to make them is deleted once they are written, not whenever the driver collects its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if lean:
        before = spark.conf.get(_CLEANUP_CONF, "false")
        spark.conf.set(_CLEANUP_CONF, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_CLEANUP_CONF, before)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
