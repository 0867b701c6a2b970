"""Objects of large JSON files, found by byte range.

A file that holds one JSON array (or several, or single objects one after the other) may be far larger than a task or a value can be, and has no line
per record. The text reader is given ``}`` as its line separator, so a file is read by as many tasks as it has splits. A piece of text between two
braces changes two states: whether we are inside a string, and how deep objects and arrays are nested. Both effects are sums (quotes modulo 2; opening minus
closing signs, once for either state at the start), so the state at every split follows from sums over the splits before it, and within a split
from running sums. Pieces up to a brace that closes an outermost object make one record.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revidence.session import ensure_checkpoint_dir

#: What a split has to be called by: file and first byte.
SPLIT = ["file", "block"]


def _net(text: Column) -> Column:
    """Opening minus closing signs (a piece holds no closing brace)."""
    n = F.length(text)
    opening = n - F.length(F.replace(text, F.lit("{"), F.lit(""))) + n - F.length(F.replace(text, F.lit("["), F.lit("")))
    return opening - (n - F.length(F.replace(text, F.lit("]"), F.lit(""))))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq (order in the split), size, value, quotes, d0, d1: nesting change of the piece and its brace if it begins outside or inside a string."""
    raw = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"),
                     F.monotonically_increasing_id().alias("seq"), "value")
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    parts = F.split(plain, '"', -1)
    half = lambda k: F.array_join(F.filter(F.col("parts"), lambda x, i: i % 2 == k), "")
    out = raw.withColumn("parts", parts)
    quotes = (F.size("parts") - 1) % 2
    return out.select(*SPLIT, "seq", "size", "value", quotes.alias("quotes"), (_net(half(0)) - F.when(quotes == 0, 1).otherwise(0)).alias("d0"),
                      (_net(half(1)) - F.when(quotes == 1, 1).otherwise(0)).alias("d1"))


def _running(pieces: DataFrame) -> DataFrame:
    """Adds, within each split: odd (quotes before, modulo 2), a and b (change if the split begins outside or inside a string)."""
    before = Window.partitionBy(*SPLIT).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    return pieces.withColumn("odd", odd).withColumn("a", F.when(F.col("odd") == 0, F.col("d0")).otherwise(F.col("d1"))) \
        .withColumn("b", F.when(F.col("odd") == 0, F.col("d1")).otherwise(F.col("d0")))


def _splits(pieces: DataFrame) -> DataFrame:
    """A row a split: inside (0 or 1), depth and outer (depth of the records) at its start. Raises on a file that ends in the middle of a value."""
    head = F.min_by(F.substring(F.regexp_replace("value", r"^[\s﻿]+", ""), 1, 1), "seq")
    totals = _running(pieces).groupBy(*SPLIT).agg(F.max("size").alias("size"), F.sum(F.octet_length("value") + 1).alias("bytes"), (F.sum("quotes") % 2).alias("quotes"),
                                                  F.sum("a").alias("a"), F.sum("b").alias("b"), head.alias("head"))
    by = Window.partitionBy("file").orderBy("block")
    before, all_ = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    s = totals.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    s = s.withColumn("change", F.when(F.col("inside") == 0, F.col("a")).otherwise(F.col("b")))
    s = s.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0))).withColumn("outer", (F.first("head").over(by) == "[").cast("int"))
    # the last piece of a file has no brace unless the bytes say so (the reader may skip a mark of three bytes at the start)
    over = F.sum("bytes").over(all_) - F.col("size")
    ends = F.sum("change").over(all_) + F.when(over.isin(1, -2), 1).otherwise(0)
    whole = (ends == 0) & (F.sum("quotes").over(all_) % 2 == 0)
    depth = F.when(whole, F.col("depth")).otherwise(F.raise_error(F.concat(F.lit("not whole JSON: "), F.col("file"))).cast("bigint"))
    return s.select(*SPLIT, "inside", depth.alias("depth"), "outer")


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """file, record (dense position of the object in its file), json: the objects of top-level arrays, and top-level objects, below ``path``.

    Other members of an array (numbers, strings, null) are skipped; arrays inside the outermost one must hold no objects. An object is held as one value; a file isn't. A file that is cut off raises an error.
    """
    pieces = _pieces(spark, path)
    before = Window.partitionBy(*SPLIT).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    state = _running(pieces).join(_splits(pieces), SPLIT)
    change = F.when(F.col("inside") == 0, F.col("a")).otherwise(F.col("b"))
    outside = (F.col("inside") + F.col("odd") + F.col("quotes")) % 2 == 0
    after = F.col("depth") + F.sum(change).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ended = state.withColumn("ends", (outside & (after == F.col("outer"))).cast("int"))
    ended = ended.withColumn("nth", F.coalesce(F.sum("ends").over(before), F.lit(0))).select(*SPLIT, "seq", "value", "ends", "nth")
    scratch = f"{ensure_checkpoint_dir(spark).rstrip('/')}/json-pieces-{uuid.uuid4().hex}"
    ended.write.parquet(scratch)
    ended = spark.read.schema(ended.schema).parquet(scratch)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = ended.groupBy(*SPLIT).agg(F.sum("ends").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    records = ended.join(first, SPLIT).groupBy("file", (F.col("first") + F.col("nth")).alias("record")) \
        .agg(F.max("ends").alias("whole"), F.sort_array(F.collect_list(F.struct("block", "seq", "value"))).alias("pieces"))
    text = F.concat(F.array_join(F.col("pieces.value"), "}"), F.lit("}"))
    return records.where("whole = 1").select("file", "record", F.regexp_replace(text, r'^[^{"]*(?:"(?:[^"\\]|\\.)*"[^{"]*)*', "").alias("json"))
