"""The folder that the driver and all executors see."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a folder of this machine, if all of Spark runs on it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """The rows as computed once: lineage ends in a checkpoint that survives lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Rows and bytes of an Arrow batch at most, so that a Python worker holds little text at a time.
ARROW_ROWS, ARROW_BYTES = 2000, 32 * 1024 * 1024


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: their Python workers need not have it on their path."""
    sc = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not _limited(spark, size):
        spark.conf.set(size, str(ARROW_BYTES))
    if getattr(sc, "_tidelog_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tidelog-ship-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(target)
    sc._tidelog_shipped = True


def _limited(spark: SparkSession, name: str) -> bool:
    """Whether the session sets that size itself, to less."""
    given = str(spark.conf.get(name)).lower().removesuffix("b")
    return given.isdigit() and 0 < int(given) <= ARROW_BYTES
