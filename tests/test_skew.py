"""A hot product holding a third of all reviews: the whole analysis still equals the DuckDB oracle."""

import duckdb
from pyspark.sql import functions as F

from revidence.plans import oracle_sql as O
from revidence.plans.analysis import analyze
from revidence.sources.bridges import v_scored

SF = "/root/testdata/sf0.1"
HOT = "CASE WHEN vec_id % 3 = 0 THEN 0 WHEN vec_id % 50 = 0 THEN 99 ELSE vec_id % 7 END AS product_id"


def test_hot_product_evidence_matches_oracle(spark):
    s = v_scored(spark, SF).withColumn(
        "product_id", F.when(F.col("review_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("product_id")))
    a = analyze(spark, s)
    got = sorted((r.product_id, r.sub_idx, r.n_cells, round(r.confidence, 6), int(r.sign))
                 for r in a.evidence.collect())
    sql = O.core_prefix().replace(
        "CASE WHEN vec_id % 50 = 0 THEN 99 ELSE vec_id % 7 END AS product_id", HOT) + \
        "SELECT product_id, sub_idx, n_cells, round(confidence, 6), sgn FROM evidence"
    assert HOT in sql
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    exp = sorted((int(p), int(s_), int(n), float(c), int(g)) for p, s_, n, c, g in con.execute(sql).fetchall())
    assert got == exp
    hot = a.status.where("product_id = 0").first()
    total = s.where((F.col("relevance") > 0.7) & (F.col("usefulness") > 7.0)).count()
    assert hot.n_gated * 4 > total            # the hot product really holds about a third
