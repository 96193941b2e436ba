"""Helpers that the training-data operators share: scratch tables, keys, session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local master gets a temporary folder;
    a cluster has none that its executors could see, and is told so."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="prose_spark_")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Folders of this process's scratch tables, with their sessions.
_ROOTS: dict[str, SparkSession] = {}


def remove_scratch() -> None:
    """Remove the scratch tables of this process. To be called when the DataFrames that operators returned have been written; else done at exit."""
    while _ROOTS:
        path, spark = _ROOTS.popitem()
        if spark._jsc is not None and not spark._jsc.sc().isStopped():
            _remove(spark, path)


@atexit.register
def _at_exit() -> None:
    with suppress(Py4JError, OSError, AttributeError):  # the JVM may be gone already
        remove_scratch()


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and can be dropped early.

    What a returned DataFrame still reads stays until `remove_scratch`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _ROOTS[self.root] = spark

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _remove(self.spark, table._scratch_path)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null. The pattern needs no look-around, so Java and RE2 agree."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same on pure ASCII and is far faster than translate()."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, low))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
