"""Registry contract and a batch == stream check."""

import __spark_entry__ as E


def test_registry_shapes():
    q, s = E.queries(), E.oracle_sql()
    assert len(q) >= 100
    assert set(s) <= set(q)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "status" in df.columns


def test_stream_equals_batch(spark):
    from pyspark.sql import functions as F
    from revidence.functions import text as T
    from revidence.plans.q_text import cleaned
    d = "/root/testdata/sf0.001"
    streamed = E.queries()["stream_ingest"](spark, d)
    c = cleaned(spark, d).where(T.word_count(F.col("text")) > 15)
    batch = c.select("product_id", F.sha2("text", 256).alias("text_hash"), "text").distinct()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
