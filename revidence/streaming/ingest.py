"""Structured Streaming (K1, K2): incremental review ingestion and running evidence state.

K1: landed review files -> clean -> length filter -> deduplicate on (product_id, text hash)
    -> append to a file sink, with every column of the landed rows. The dedup state is keyed, spread over executors and
    bounded by a watermark (over the arrival time, unless an event-time column is named).
K2: landed scored reviews -> gate -> decode (stateless) -> running additive sums per
    (product, sub): raw weights, signed weights, usefulness gain, counts. The per-product
    medians of the batch report are holistic and cannot be maintained incrementally, so K2
    keeps only the additive terms. Each micro-batch writes the groups it changed into a folder of its own; a pointer
    row appended last makes the folder count, so a reader never sees a table that is empty or half written.

Both run with checkpoints under the shared checkpoint dir, so a restarted query resumes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revidence import dims
from revidence.functions import text as TX
from revidence.functions.columns import computed
from revidence.operators import evidence as ev
from revidence.operators import predict

REVIEW_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType()), T.StructField("review_id", T.LongType()),
    T.StructField("raw_text", T.StringType())])
LANDED_SCHEMA = T.StructType([*REVIEW_SCHEMA.fields, T.StructField("origin", T.StringType()), T.StructField("likes", T.LongType())])
ARRIVED = "arrived_at"
EVIDENCE_KEYS = ["product_id", "sub_idx"]
EVIDENCE_SCHEMA = "product_id BIGINT, sub_idx INT, n_cells BIGINT, sw DOUBLE, ssw DOUBLE, vol_raw DOUBLE"
POINTER = "checkpoint STRING, since BIGINT, epoch BIGINT"


def ingest_stream(spark: SparkSession, landing: str, schema: T.StructType = LANDED_SCHEMA,
                  max_files_per_trigger: int | None = None, event_time: str | None = ARRIVED,
                  delay: str = "7 days") -> DataFrame:
    """K1 transformation: streaming DataFrame of cleaned, deduplicated review items: the landed columns with ``text`` and
    ``text_hash`` in the place of the raw text, and the event time.

    Duplicates are dropped within the watermark, so state stays bounded. The default event time is the time of the
    micro-batch a row arrives in (recorded with the batch, so a restart repeats it): no row is ever late, and copies that
    arrive within ``delay`` of each other are kept once. With an event-time column of the data, rows later than the
    watermark are dropped. With ``event_time=None`` every (product, text) is kept once forever and state grows with them.
    """
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.parquet(landing)
    if event_time == ARRIVED and ARRIVED not in s.columns:
        s = s.withColumn(ARRIVED, F.current_timestamp())
    # a landed file may be one row group, which one task reads: its rows are dealt out before they are cleaned
    s = s.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    c = computed(s, text=TX.clean_text(F.col("raw_text"))).drop("raw_text")
    c = c.where(TX.word_count(F.col("text")) > 15)
    c = c.withColumn("text_hash", F.sha2(F.col("text"), 256))
    if event_time:
        return c.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["product_id", "text_hash"])
    return c.dropDuplicates(["product_id", "text_hash"])


def run_ingest(spark: SparkSession, landing: str, out: str, checkpoint: str, **kw) -> None:
    q = (ingest_stream(spark, landing, **kw).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def evidence_stream(spark: SparkSession, landing: str, schema: T.StructType = dims.SCORED_SCHEMA,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """K2 transformation: running additive evidence per (product_id, sub_idx)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    s = r.parquet(landing)
    gated = s.where((F.col("relevance") > dims.RELEVANCE_THRESHOLD) & (F.col("usefulness") > dims.USEFULNESS_GATE))
    cells = predict.decode_cells(gated).where("pred_sub")
    w = ev.raw_weight(F.col("sconf"), F.col("usefulness"))
    sg = F.col("sign").cast("double")
    return cells.groupBy("product_id", "sub_idx").agg(
        F.count("*").alias("n_cells"), F.sum(w).alias("sw"), F.sum(sg * w).alias("ssw"),
        F.sum(ev.h_useful(F.col("usefulness"))).alias("vol_raw"))


def _pointer(spark: SparkSession, out: str) -> tuple[str, int, int] | None:
    """(checkpoint, since, epoch) of the table as it stands; None before the first micro-batch."""
    try:
        rows = spark.read.schema(POINTER).parquet(f"{out}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = rows.agg(F.max_by(F.struct("checkpoint", "since", "epoch"), "epoch").alias("p")).first().p
    return last and (last.checkpoint, last.since, last.epoch)


def read_evidence(spark: SparkSession, out: str) -> DataFrame:
    """The running evidence table: of each group the row of the last micro-batch that changed it, up to the one pointed at."""
    at = _pointer(spark, out)
    if at is None:
        return spark.createDataFrame([], EVIDENCE_SCHEMA)
    rows = spark.read.schema(f"{EVIDENCE_SCHEMA}, epoch BIGINT").parquet(f"{out}/data").where(F.col("epoch").between(at[1], at[2]))
    names = [f.split(" ")[0] for f in EVIDENCE_SCHEMA.split(", ")]
    values = [c for c in names if c not in EVIDENCE_KEYS]
    last = rows.groupBy(*EVIDENCE_KEYS).agg(F.max_by(F.struct(*values), "epoch").alias("last"))
    return last.select(*EVIDENCE_KEYS, *[F.col(f"last.{c}").alias(c) for c in values])


def run_evidence(spark: SparkSession, landing: str, out: str, checkpoint: str, snapshot_every: int = 100, **kw) -> None:
    """Running evidence in ``out``, to be read with ``read_evidence``.

    Update mode: ``out/data/epoch=n`` holds the groups that micro-batch n changed, and a row appended to ``out/pointer``
    makes them count. Every ``snapshot_every``-th micro-batch writes the whole table, from which readers start then; older folders
    may be removed once no reader uses them. A repeated micro-batch (after a failure) writes its folder anew if the pointer
    had not reached it, else it is skipped. ``out`` belongs to one checkpoint; another one raises.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        at = _pointer(spark, out)
        if at and at[0] != checkpoint:
            raise ValueError(f"{out} belongs to the checkpoint {at[0]}")
        if at and at[2] >= epoch:
            return
        whole = at is not None and epoch - at[1] >= snapshot_every
        if whole:
            batch = batch.unionByName(read_evidence(spark, out).join(batch.select(*EVIDENCE_KEYS), EVIDENCE_KEYS, "left_anti"))
        batch.write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")
        since = epoch if whole or at is None else at[1]
        spark.range(1).select(F.lit(checkpoint).alias("checkpoint"), F.lit(since).cast("long").alias("since"), F.lit(epoch).cast("long").alias("epoch")) \
            .coalesce(1).write.mode("append").parquet(f"{out}/pointer")
    q = (evidence_stream(spark, landing, **kw).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
