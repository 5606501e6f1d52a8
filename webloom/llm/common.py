"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Rows and bytes of an Arrow batch. Texts are long: larger batches only cost memory, in the JVM and in Python.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for this session where it has Spark's defaults."""
    for key, usual, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, BATCH_BYTES)):
        if int(spark.conf.get(key, str(usual)).removesuffix("b")) >= usual:
            spark.conf.set(key, str(value))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer tasks than there are cores; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by the path Spark was given (never opened by Python)."""
    bounded_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` is taken from the session; only where it is unset and
    driver and executors are one process (a local session, as in tests) a temporary
    folder of this machine takes its place. On a cluster an unset folder is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="webloom-checkpoints-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
    return jsc.getCheckpointDir().get()


class folder:
    """A folder of the file system that Spark's paths name."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def mkdirs(self) -> None:
        self._fs.mkdirs(self._at)

    def delete(self) -> None:
        self._fs.delete(self._at, True)

    def exists(self) -> bool:
        return self._fs.exists(self._at)

    def write(self, name: str, text: str) -> None:
        """A small file in the folder, which is there as a whole or not at all."""
        new, at = (self._jvm.org.apache.hadoop.fs.Path(self._at, n) for n in (f"_{name}", name))
        out = self._fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.rename(new, at)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._jvm.org.apache.hadoop.fs.Path(self._at, name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._at)] if self.exists() else []


def discard_intermediate(spark: SparkSession) -> None:
    """Deletes the ``webloom-*`` folders of the shared folder. For after all results have been written, while no other job of this library runs."""
    shared = checkpoint_dir(spark)
    for name in folder(spark, shared).names():
        if name.startswith("webloom-"):
            folder(spark, f"{shared}/{name}").delete()


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: its lineage ends there."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{checkpoint_dir(spark)}/webloom-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work``, giving freed memory back to the system when a task ends: idle Python workers stay alive beside the JVM."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while a column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def plus(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    """A schema with further columns (``StructType.add`` would change the one it is called on)."""
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in columns.items())])
