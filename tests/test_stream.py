"""Streaming: watermarked dedup keeps each review once within the watermark, and K2 equals batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revidence import dims
from revidence.operators import predict
from revidence.sources.ingest import scratch_path
from revidence.streaming import ingest as st

TEXT = "this phone has a very good battery and the screen is bright and the camera works well in low light"


def test_watermarked_dedup(spark):
    base = scratch_path(spark, "wm-test")
    t0 = dt.datetime(2026, 1, 1)
    rows = [("p1", 1, TEXT, t0), ("p1", 2, "  " + TEXT, t0 + dt.timedelta(hours=1)),   # same text after cleaning
            ("p2", 3, TEXT, t0), ("p1", 4, TEXT + " again", t0)]
    schema = T.StructType(st.REVIEW_SCHEMA.fields + [T.StructField("ts", T.TimestampType())])
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{base}/landing")
    q = (st.ingest_stream(spark, f"{base}/landing", schema=schema, event_time="ts", delay="1 day")
         .writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    assert sorted((r.product_id, r.text.endswith("again")) for r in out.collect()) == [("p1", False), ("p1", True), ("p2", False)]


def test_arrival_time_bounds_the_state_and_columns_stay(spark):
    base = scratch_path(spark, "arrival-test")
    rows = [("p1", 1, TEXT, "review", 3), ("p1", 2, " " + TEXT, "comment", None), ("p2", 3, TEXT, "review", 0)]
    for r in rows:
        spark.createDataFrame([r], st.LANDED_SCHEMA).write.mode("append").parquet(f"{base}/landing")
    for _ in range(2):  # the second run finds nothing new
        st.run_ingest(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1)
    got = sorted(spark.read.parquet(f"{base}/out").select("product_id", "review_id", "origin", "likes").collect())
    assert [r.product_id for r in got] == ["p1", "p2"] and got[1][1:] == (3, "review", 0) and got[0].review_id in (1, 2)


def scored(spark, ids):
    return spark.createDataFrame([(i % 3, i) for i in ids], "product_id BIGINT, review_id BIGINT").select(
        *[(F.col(f.name) if f.name in ("product_id", "review_id") else
           F.array_repeat(F.lit(2.0) - F.col("review_id") % 5, 9 if f.name == "top" else 29) if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType) else
           F.array_repeat(F.struct(F.lit(0.1).alias("neg"), F.lit(1.5).alias("pos")), 29) if isinstance(f.dataType, T.ArrayType) else
           F.lit(9.0) if f.name == "usefulness" else F.lit(0.9)).cast(f.dataType).alias(f.name) for f in dims.SCORED_SCHEMA.fields])


def batch_evidence(spark, path):
    s = spark.read.schema(dims.SCORED_SCHEMA).parquet(path)
    cells = predict.decode_cells(s).where("pred_sub")
    return {(r.product_id, r.sub_idx): r.n for r in cells.groupBy("product_id", "sub_idx").agg(F.count("*").alias("n")).collect()}


def test_evidence_between_batches_restarts_and_repeats(spark):
    base = scratch_path(spark, "evidence-test")
    now = lambda: {(r.product_id, r.sub_idx): r.n_cells for r in st.read_evidence(spark, f"{base}/out").collect()}
    assert now() == {}
    for k in range(4):  # each round is a restart of the stream
        scored(spark, range(k * 7, k * 7 + 7)).coalesce(2).write.mode("append").parquet(f"{base}/landing")
        st.run_evidence(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt", snapshot_every=2)
        want = batch_evidence(spark, f"{base}/landing")
        assert now() == want and want
    _, since, epoch = st._pointer(spark, f"{base}/out")
    assert 0 < since <= epoch
    # a micro-batch that failed before its pointer row is not seen
    spark.createDataFrame([(0, 0, 999, 0.0, 0.0, 0.0)], st.EVIDENCE_SCHEMA).write.parquet(f"{base}/out/data/epoch={epoch + 1}")
    assert now() == want
    scored(spark, range(100, 103)).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    st.run_evidence(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt", snapshot_every=2)
    assert now() == batch_evidence(spark, f"{base}/landing")
    with pytest.raises(Exception, match="belongs to the checkpoint"):
        st.run_evidence(spark, f"{base}/landing", f"{base}/out", f"{base}/other")
