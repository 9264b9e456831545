"""Helpers shared by the training-data operators: scratch tables, let-binding, byte columns."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder

#: ASCII white space that separates words in the contracts: space, \t \n \v \f \r.
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    A plain column reference inside a lambda may be inlined by the optimiser and
    evaluated once per element; a lambda variable never is.
    """
    return F.transform(F.array(value), body)[0]


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it has ended, since its result is a table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables of one run in the shared folder; one that nothing reads any more may go before the run ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, *folders: str) -> DataFrame:
        """Write ``df`` once, in folders by some columns if they are given, and read it back: cuts lineage and survives lost executors."""
        schema = df.schema
        with _shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").partitionBy(*folders).parquet(f"{self.root}/{name}")
        return self.read(name, schema)

    @contextlib.contextmanager
    def dealt(self, df: DataFrame, name: str, *keys: str) -> Iterator[DataFrame]:
        """``df``, which is dealt by its keys already, written in buckets of them, so that joins by them don't move it again; gone at the end of the block."""
        n, listed = shuffle_partitions(self.spark), f"{name}_{uuid.uuid4().hex}"
        try:
            with _shuffles_dropped(self.spark):
                rows = df.write.option("compression", "zstd").option("path", f"{self.root}/{name}")
                rows.bucketBy(n, *keys).sortBy(*keys).saveAsTable(listed)
            yield self.spark.table(listed)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {listed}")
            self.drop(name)

    def read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back."""
    return Scratch(df.sparkSession, name).table(df, "table")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    view = memoryview(data) if data is not None else memoryview(b"")
    at = memoryview(offsets).cast("q" if wide else "i")
    base = column.offset
    valid = column.is_valid().to_pylist() if column.null_count else None
    for i in range(len(column)):
        if valid is not None and not valid[i]:
            yield b""
        else:
            yield bytes(view[at[base + i] : at[base + i + 1]])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
