"""What the training-data operators share: table access and shared-folder scratch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.shared import shared_dir, ship

__all__ = ["SPACE", "Scratch", "let", "shared_dir", "ship", "stream_groups", "table", "text_words"]

#: ASCII white space; a word is a longest run of other characters.
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Named Parquet tables in the shared folder, which cut lineage and outlive lost executors; they go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: as a lambda variable it can't be inlined again."""
    return F.transform(F.array(value), body)[0]


def text_words(text: Column) -> Column:
    """The words of a text, an empty array for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def released(run):
    """The same batch function, after which the worker gives memory back to the system: it lives on for other stages."""

    def wrapped(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow

        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim is not None:
            trim(0)

    return wrapped


def stream_groups(batches, keys: list[str]):
    """(key, rows as a DataFrame) for each run of equal keys of batches sorted by them, runs across batches whole."""
    import pandas as pd

    key, held = None, []
    for pdf in batches:
        if not len(pdf):
            continue
        parts = list(zip(*[pdf[k].tolist() for k in keys]))
        starts = [0, *[i for i in range(1, len(parts)) if parts[i] != parts[i - 1]], len(parts)]
        for i, j in zip(starts, starts[1:]):
            if parts[i] != key:
                if held:
                    yield key, pd.concat(held, ignore_index=True)
                key, held = parts[i], []
            held.append(pdf.iloc[i:j])
    if held:
        yield key, pd.concat(held, ignore_index=True)
