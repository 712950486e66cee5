"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters and rows of a piece of a partition that a function gets at a time.
PIECE_CHARS, PIECE_ROWS = 4_000_000, 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below sf_dir, by whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(batch: pa.RecordBatch, most_chars: int = PIECE_CHARS, most_rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """batch in slices of about most_chars bytes of text (or one row) and most_rows rows at most; nothing is copied."""
    size = np.full(batch.num_rows, 8, dtype=np.int64)
    for column in batch.columns:
        if any(f(column.type) for f in (pa.types.is_binary, pa.types.is_string, pa.types.is_large_binary, pa.types.is_large_string)):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group, start = np.cumsum(size) // most_chars, 0
    while start < batch.num_rows:
        end = min(int(np.searchsorted(group, group[start], side="right")), start + most_rows)
        yield batch.slice(start, end - start)
        start = end


def mapped_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, most_chars: int = PIECE_CHARS) -> DataFrame:
    """df with `run` applied to each partition, as mapInArrow(), but in pieces of bounded size, whatever the session's Arrow batches hold.

    What a partition has freed goes back to the machine at its end: Spark keeps workers for later stages.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(piece for b in batches for piece in cut(b, most_chars))
        finally:
            give_back()

    return df.mapInArrow(over, schema)


def mapped(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, most_chars: int = PIECE_CHARS) -> DataFrame:
    """mapped_arrow() for a function over pandas pieces."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def over(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(piece.to_pandas() for piece in pieces):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return mapped_arrow(df, over, schema, most_chars)


#: Caches of this process, emptied at the end of each partition.
CACHES: list[dict] = []


def give_back() -> None:
    """Caches are emptied, and memory that Python and Arrow hold but do not use goes back to the machine (where its C library can do that)."""
    for cache in CACHES:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of docs: other columns are left out, a null text is empty, rows without an id name no document and go."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one if the master is local, else ValueError: other machines would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def durable(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: lineage ends here, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
