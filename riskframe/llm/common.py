"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (ArrayType, BinaryType, DataType, IntegerType, LongType, StringType, StructField,
                               StructType)

#: Rows handled at a time inside a task, whatever Spark's Arrow batch size is.
SLICE_ROWS = 512

#: Bytes of an Arrow batch between Spark and a Python worker, unless the session says otherwise.
ARROW_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_KINDS = {"int": IntegerType(), "long": LongType(), "string": StringType(), "binary": BinaryType()}


def fields(**kinds: str | DataType) -> StructType:
    """A schema from names and types; ``long[]`` is an array of longs."""
    def kind(k):
        if isinstance(k, DataType):
            return k
        return ArrayType(_KINDS[k[:-2]]) if k.endswith("[]") else _KINDS[k]
    return StructType([StructField(name, kind(k)) for name, k in kinds.items()])


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def releasing(run: Callable) -> Callable:
    """A task function that gives freed memory back to the system at its end: a
    Python worker lives on for later stages, its largest heap should not."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass
    return wrapped


def map_batches(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` of a function that gives freed memory back, in batches of
    about ``ARROW_BYTES``. Spark's own 64 MB are held four times for each task (a
    growing vector and its message in the JVM, the batch and its reader in Python);
    a session that sets the size itself keeps it."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, "1b") == "1b":  # the default given here: not set
        conf.set(_BATCH_BYTES, str(ARROW_BYTES))
    return df.mapInArrow(releasing(run), schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column) -> Column:
    """crc32 of the key's decimal text, divisible by 5; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS,
           chars_of: str | None = None, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows and (with ``chars_of``) about
    ``max_bytes`` bytes of that column; one longer value stays whole."""
    for batch in batches:
        if chars_of is None:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(chars_of)), 0).to_numpy(False)
        at, total = 0, 0
        for i, size in enumerate(sizes):
            if i > at and (total + size > max_bytes or i - at >= rows):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(size)
        if at < batch.num_rows:
            yield batch.slice(at)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: StructType,
               rows: int = SLICE_ROWS, chars_of: str | None = None,
               max_bytes: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one bounded slice into columns by name."""
    def run(batches):
        arrow = to_arrow_schema(schema)
        for piece in slices(batches, rows, chars_of, max_bytes):
            out = fn(piece)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) and c.type == f.type
                 else (c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type))
                 for f in arrow for c in (out[f.name],)], schema=arrow)
    return map_batches(df, run, schema)


def binary_text(df: DataFrame, text: str = "text", to: str = "_utf8") -> DataFrame:
    """Add the text's UTF-8 bytes (null stays null) under ``to``."""
    return df.withColumn(to, F.col(text).cast("string").cast("binary"))
