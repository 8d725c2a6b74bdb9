"""Where jobs keep intermediate tables, and how operators read their columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.storage import Scratch, fresh_path, shared_dir, written

__all__ = ["Scratch", "fresh_path", "let", "local_table", "map_batches", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: as a lambda's variable it can't be copied into inner lambdas."""
    return F.transform(F.array(value), use)[0]


def local_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A few rows of the driver as a DataFrame, by way of Arrow: made of tuples it would start Python on the executors."""
    from pyspark.sql.pandas.types import to_arrow_schema  # of the driver alone

    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kinds = to_arrow_schema(schema)
    columns = zip(*rows) if rows else [[] for _ in kinds]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds), schema)


def _give_back() -> None:
    """Memory that this process has freed goes back to the machine, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Bytes of an Arrow batch where the session names none: long texts make batches of few rows.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes, whose tasks give back what they freed: Python processes are used again by
    the tasks that follow."""
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from made(batches)
        finally:
            _give_back()

    return df.mapInArrow(lean, schema)
