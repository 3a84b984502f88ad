"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a maximal run of anything but blank, tab, line feed,
#: vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is absent, a temporary folder serves on one machine; a cluster must name one.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
    return there


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows from now on in this session, so that a batch of whole texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, for a written table."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with each row as a struct `row`, beside the named columns: helpers' names then clash with none of docs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def unboxed(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The rows of a boxed frame, with some columns changed."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns])


def words_of(text: Column) -> Column:
    """Array of a text's words; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8_column(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow batch as one byte array, and len+1 offsets; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    raw = col.buffers()
    ends = np.frombuffer(raw[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slabs(ends: np.ndarray, most: int):
    """Row ranges (first, last) of at most `most` bytes each, though of one row at least."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last
