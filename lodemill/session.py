"""Session helpers: table access and the shared scratch folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver does, if that place is theirs as well.

    On a cluster without a shared home, hand the package over with ``--py-files``.
    """
    home = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (home, paths) if p)


def local_session(app: str = "lodemill", cores: str | None = None) -> SparkSession:
    """A session for tests and benches on one machine. On a cluster pass your own session instead."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LODEMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only where a local session leaves it unset is one made."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="lodemill-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written below the shared folder, so that no later stage depends on an executor's blocks.

    ``write`` cuts the lineage of a DataFrame, ``drop`` frees a table that no later step reads. What is left goes
    with the driver's JVM.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/lodemill-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)
        self._at: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = path
        return out

    def measured(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """:meth:`write`, and aggregates over the rows as they are written, which spares a job that reads them again."""
        seen = Observation()
        out = self.write(df.observe(seen, *[column.alias(name) for name, column in metrics.items()]))
        return out, seen.get

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if path := self._at.pop(id(df), None):
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
