"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revidence.session import ensure_checkpoint_dir

#: ASCII white space, the separators between words everywhere in this subpackage (fixed value).
SPACES = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Hand freed memory of a Python worker back to the system. Worker processes outlive their tasks, and the allocators keep what a
    task has freed (several 100 MB after a large Arrow batch), which counts against the executor's memory all the while."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(run: Callable) -> Callable:
    """``run`` for mapInArrow, with ``release`` when the task ends."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
    return task


def released_group(run: Callable) -> Callable:
    """``run`` for applyInArrow (of a group or of a pair of groups), with ``release`` after each call."""
    if run.__code__.co_argcount == 1:
        @functools.wraps(run)
        def one(t: pa.Table) -> pa.Table:
            try:
                return run(t)
            finally:
                release()
        return one

    @functools.wraps(run)
    def two(t: pa.Table, more: pa.Table) -> pa.Table:
        try:
            return run(t, more)
        finally:
            release()
    return two


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once (higher-order functions do not share subexpressions)."""
    return F.transform(F.array(value), use)[0]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32(doc_id as text) mod 3 is 1. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone: extra columns of the input can't clash with computed ones."""
    return df.select(*cols)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled rows that may be learned from, those with the smallest hash of their id.

    The sample is drawn from the labels, so only ``bound`` ids are broadcast and the texts are not shuffled. Rows with a null or
    other label than 0 and 1 and rows that are held out are never drawn; an id with several labels counts with each.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = rows.orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id", "label").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
