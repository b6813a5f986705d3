"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(name: str = "lodestone", cores: int | str = "*") -> SparkSession:
    """A local session with the settings the operators expect of a cluster."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application,
    so that functions defined here can be loaded wherever a task runs."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.
    A local session that has none gets a folder of its own; on a cluster that
    would be one disk among many, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, so that every later use sees the same
    rows even if a task is run again."""
    path = f"{work_dir(df.sparkSession)}/lodestone/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``settle`` wrote for tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._settled_to)
