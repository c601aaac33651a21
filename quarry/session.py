"""Session set-up and shared scratch storage.

Every intermediate that is read more than once is written as a Parquet table below
the folder that the cluster names in ``spark.checkpoint.dir``; executors can then be
lost without losing the data, and no machine-local folder is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the numeric policy of this library: UTC, ANSI, AQE."""
    builder = (
        SparkSession.builder.master(master)
        .appName("quarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this package when it isn't installed: by its path where
    they share the driver's disk, else as an archive that Spark ships to every executor."""
    context = spark.sparkContext
    if context.master.startswith("local[") or context.master == "local":
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if REPO not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([REPO, *paths])
        return
    if getattr(context, "_quarry_shipped", False):
        return
    folder = tempfile.mkdtemp()  # the driver serves the archive from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "quarry_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for top, _, names in os.walk(os.path.join(REPO, "quarry")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    out.write(path, os.path.relpath(path, REPO))
    context.addPyFile(archive)
    context._quarry_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediates, which a cluster must name; only a session in
    one process, as in tests, has a default."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/quarry-checkpoints"
    return f"{root.rstrip('/')}/quarry-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The intermediates of one operator call, which deletes each when its last reader is done."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """``materialize``, remembered for ``drop``."""
        out = materialize(df, name, small)
        self._paths[id(out)] = out, out._quarry_path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self._paths.pop(id(df), (None, None))
            if path:
                _delete(self.spark, path)

    def close(self, *keep: DataFrame) -> None:
        """Deletes everything but what ``keep`` reads."""
        kept = {id(df) for df in keep}
        self.drop(*[df for key, (df, _) in list(self._paths.items()) if key not in kept])


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a reader of that table.

    This cuts lineage: a later stage rereads files instead of recomputing the plan. A
    ``small`` result, cheap to make and narrow, goes to an eighth of the usual files.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(6, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished plans now.

    It does so when the driver's JVM has collected the plans, which may take half an hour
    where the driver's heap seldom fills.
    """
    spark.sparkContext._jvm.System.gc()


def release_heaps(spark: SparkSession) -> None:
    """Lets the executors' JVMs give back what finished steps left in heaps and direct buffers.

    They keep both until their heap is full, and then stand beside Python workers at their largest.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def drop_scratch(spark: SparkSession) -> None:
    """Deletes this application's intermediates, once its results are written."""
    _delete(spark, scratch_root(spark))


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 6) -> None:
    """Bounds what one Arrow batch of whole texts holds in a Python worker.

    Plans are made when a result is read, after the operator has returned, so the bounds
    stay set for the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def tidy(mapper: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same mapper of Arrow batches, after which the worker gives freed memory back."""

    def run(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from mapper(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
