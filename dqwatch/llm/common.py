"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

#: White space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see (``spark.checkpoint.dir``); a temporary one only where none is set and all is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str, compression: str | None = None) -> DataFrame:
    """The table as it was written to the shared folder: computed once, and it survives lost executors. ``by``: a folder for each value."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=list(by) or None, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on through later stages, and its allocators keep what a task freed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def map_columns(df: DataFrame, schema: str | StructType, fn: Callable[..., Sequence], at_once: int | None = None) -> DataFrame:
    """``fn`` gets the columns of a batch as Python lists and returns the columns of the result, row by row in place.

    ``at_once`` bounds the rows that it gets, where their objects take far more room than the batch.
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in (b.slice(at, at_once) for b in batches for at in range(0, b.num_rows, at_once or max(b.num_rows, 1))):
            columns = fn(*[c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )
            del columns
        give_back()

    return df.mapInArrow(run, kind)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
