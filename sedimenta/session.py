"""Session helpers: a local session for tests, and the shared folder that checkpoints go to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sedimenta")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once a session; they may have no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_sedimenta_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="sedimenta-")) / "sedimenta.zip"  # on the driver, which serves it
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(archive))
    context._sedimenta_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Read from ``spark.checkpoint.dir``. Only a local session may go without
    that setting; it then gets a temporary folder of its own.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "sedimenta-checkpoints")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """Tables of a loop. Each is written as Parquet to the shared folder; the one it replaces is then deleted.

    Unlike a checkpoint, a table that is read again carries nothing of the plan
    that made it, so planning a late round takes no longer than the first.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"
        self.at: dict[str, int] = {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        n = self.at[name] = self.at.get(name, 0) + 1
        path = f"{self.folder}/{name}-{n}"
        df.write.parquet(path)
        if n > 1:
            self._delete(name, n - 1)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            if name in self.at:
                self._delete(name, self.at[name])

    def _delete(self, name: str, n: int) -> None:
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}-{n}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def write_measured(self, name: str, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """:meth:`write`, and aggregates of the rows, taken as they are written; no job of their own. NULL counts as 0."""
        seen = Observation()
        table = self.write(name, df.observe(seen, *[c.alias(k) for k, c in measures.items()]))
        return table, {k: v or 0 for k, v in seen.get.items()}
