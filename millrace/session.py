"""Session set-up and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "millrace", cores: int | str | None = None, **conf) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    A cluster job may pass it with ``--py-files`` instead.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        parent = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="millrace-code-"), "millrace")
        spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", parent, "millrace"))
        # Stateful streams also start a Python worker beside the driver, which
        # knows only the path of the environment.
        env = spark.sparkContext.environment
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), parent]))
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    A local session without one gets a fresh temporary folder. A cluster
    without one is an error, as a machine-local folder would lose data with
    its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(base)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder (nothing is created yet)."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches of one plan need the same costly rows: the
    lineage ends at the files, so a lost executor only re-reads them.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of an action go when it ends, and not at some later collection of the driver.

    For jobs of many written steps, which read only what was written.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """``DataFrame.checkpoint`` with the checkpoint folder made sure of."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
