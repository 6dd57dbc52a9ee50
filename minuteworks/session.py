"""Session helpers: local sessions for tests, shared checkpoints, bounded collects."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "minuteworks") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MINUTEWORKS_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's own where it names one, else a folder for tests.

    Only a session on a ``local`` master may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="minuteworks-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    For results that several branches read: the work is done once and survives
    the loss of executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as compressed columns: readers load only those they use."""
    shared_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/minuteworks_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` frame that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if folder.rpartition("/")[2].startswith("minuteworks_"):
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a job go when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session, once.

    The driver serves it to the executors, whatever their PYTHONPATH or folder.
    """
    context = spark.sparkContext
    if getattr(context, "_minuteworks_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="minuteworks-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "minuteworks.zip")
    with zipfile.ZipFile(target, "w") as out:
        for at, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(target)
    context._minuteworks_shipped = True


def bucketed(df: DataFrame, key: str, buckets: int, distinct: bool = False) -> DataFrame:
    """Write ``df`` bucketed by ``key`` to the shared folder and read it from there.

    With ``distinct`` one row a key is kept, after the one shuffle that this takes.

    Like ``cut``, but later joins and aggregations on ``key`` don't shuffle this
    side again, and readers load only the columns they use. The catalogue keeps no
    entry; the files go with the checkpoint folder.
    """
    spark = df.sparkSession
    shared_dir(spark)
    name = f"minuteworks_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    placed = df.repartition(buckets, key)
    placed = placed.dropDuplicates([key]) if distinct else placed
    placed.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    # The frame holds its own relation to the files, so that the entry can go.
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found
