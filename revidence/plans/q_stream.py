"""Registered streaming queries (K1, K2): the final table of an availableNow run over files
landed from the driver tables, compared with the batch answer in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from revidence.plans import oracle_sql as O
from revidence.sources.bridges import v_reviews, v_scored
from revidence.sources.ingest import scratch_path
from revidence.streaming import ingest as st

QUERIES: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


R6 = lambda c: F.round(c, 6)


@register("stream_ingest", O.with_(O.V_REVIEWS, f"cl AS (SELECT *, {O.clean_text('raw_text')} AS text FROM v_reviews)")
          + f"SELECT DISTINCT product_id, sha256(text) AS text_hash, text FROM cl WHERE {O.word_count('text')} > 15")
def q_stream_ingest(spark, d):
    base = scratch_path(spark, "stream-ingest")
    v_reviews(spark, d).select("product_id", "review_id", "origin", "raw_text", "likes").repartition(4).write.parquet(f"{base}/landing")
    st.run_ingest(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1)
    return spark.read.parquet(f"{base}/out").select("product_id", "text_hash", "text")


@register("stream_evidence", O.with_(O.V_SCORED, """gated AS (SELECT * FROM v_scored WHERE relevance > 0.7 AND usefulness > 7.0)""",
                                     O.cells_ctes("gated")) + """SELECT product_id, sub_idx, count(*) AS n_cells,
  round(sum((1 - exp(-sconf / 0.8)) * ln(1 + 0.6 * usefulness)), 6) AS sw,
  round(sum(sign * (1 - exp(-sconf / 0.8)) * ln(1 + 0.6 * usefulness)), 6) AS ssw,
  round(sum(ln(1 + 0.6 * usefulness)), 6) AS vol_raw FROM cells WHERE pred_sub GROUP BY product_id, sub_idx""")
def q_stream_evidence(spark, d):
    base = scratch_path(spark, "stream-evidence")
    v_scored(spark, d).repartition(4).write.parquet(f"{base}/landing")
    st.run_evidence(spark, f"{base}/landing", f"{base}/out", f"{base}/ckpt", max_files_per_trigger=1)
    r = st.read_evidence(spark, f"{base}/out")
    return r.select("product_id", "sub_idx", "n_cells", R6("sw").alias("sw"), R6("ssw").alias("ssw"), R6("vol_raw").alias("vol_raw"))
