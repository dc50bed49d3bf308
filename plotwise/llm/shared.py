"""Small things that all operators of this folder use: shared storage, null-safe inputs, sizes."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Removes tables that stored() wrote and that nothing reads any more; the others stay until the application's folder goes."""
    for df in tables:
        jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(file)
            if f"/plotwise-{spark.sparkContext.applicationId}/" in file:
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Shuffle files of earlier jobs, which nothing reads any more, go now and not when the driver next collects its garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # the cleaner works beside


def trimmed() -> None:
    """Gives back what this process has freed. An executor takes its Python workers in turn, so each would keep the most that it ever had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(each: Callable) -> Callable:
    """The function of a group, or of two that belong together, with trimmed() after it."""

    def run(table):  # no type hints: Spark reads them
        out = each(table)
        trimmed()
        return out

    def run_both(table, other):
        out = each(table, other)
        trimmed()
        return out

    return run if each.__code__.co_argcount == 1 else run_both


def lean_batches(each: Callable) -> Callable:
    """The function of a partition's batches, with trimmed() after it."""

    def run(batches):
        yield from each(batches)
        trimmed()

    return run


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all columns of `df`, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new = f"_{new}"
        out.append(new)
    return out


def text_of(column: str = "text") -> Column:
    """The text as a string; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def digest_of(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(column).cast("string"))), F.lit(0)).alias("n")).first()["n"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
