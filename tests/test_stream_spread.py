"""K1: the cleaning of a landed file is shared by many tasks."""

from pyspark.sql import functions as F

from revidence.streaming import ingest as st


def test_a_file_of_one_row_group_is_cleaned_by_many_tasks(spark, tmp_path, monkeypatch):
    words = " ".join(f"word{i}" for i in range(20))
    rows = spark.range(400).select(F.lit("p").alias("product_id"), F.col("id").alias("review_id"), F.concat(F.lit(words), F.col("id").cast("string")).alias("raw_text"),
                                   F.lit("review").alias("origin"), F.lit(1).cast("long").alias("likes"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/landing")
    clean = st.TX.clean_text
    monkeypatch.setattr(st.TX, "clean_text", lambda c: F.concat(clean(c), F.lit(" task"), F.spark_partition_id().cast("string")))
    st.run_ingest(spark, f"{tmp_path}/landing", f"{tmp_path}/out", f"{tmp_path}/ckpt", max_files_per_trigger=1)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 400
    assert out.select(F.element_at(F.split("text", " "), -1)).distinct().count() > 1
