"""Product names to reports: lookup, corpus record, reviews and specifications, statuses."""

from pyspark.sql import functions as F

from revidence.operators import catalog as cat
from revidence.plans.analysis import reports_by_name
from revidence.sources.ingest import CORPUS_SCHEMA

LONG = "I have used the {} for number {} weeks now and the battery and the screen are both still very good and bright"
SPEC = '{"_id": {"$oid": "a"}, "specification": {"more_specification": [{"title": "Battery", "data": [{"title": "Type", "data": ["Li-Ion"]}]}]}}'


def test_four_statuses_and_reports(spark):
    reviews = lambda name, n: ([(LONG.format(name, i), 1, None) for i in range(n)], [LONG.format(name, "x"), None])
    rows = [(0, "alpha", "Alpha Phone", "", reviews("Alpha Phone", 90), SPEC), (1, "beta", "Beta Phone", "", reviews("Beta Phone", 2), None),
            (2, "gamma", "Gamma Phone", "", ([("too short", 1, None)], []), None), (3, "delta", "Delta Phone", "", None, None)]
    corpus = spark.createDataFrame(rows, CORPUS_SCHEMA)
    queries = spark.createDataFrame([(1, "Alpha Phone"), (2, "alpha phone!"), (3, "beta"), (4, "GAMMA phone"), (5, "delta phone"), (6, "omega"), (7, None)], "qid INT, query STRING")
    index = cat.alias_index(cat.alias_rows(corpus)).unionByName(spark.createDataFrame([("beta", 99)], "alias STRING, corpus_idx BIGINT"))
    status, reports = reports_by_name(spark, queries, index, corpus)
    got = {r.qid: (r.corpus_idx, r.status) for r in status.collect()}
    assert got == {1: (0, "ok"), 2: (0, "ok"), 3: (1, "insufficient_review_evidence"), 4: (2, "no_valid_reviews"), 5: (3, "no_reviews_found"),
                   6: (None, "no_reviews_found"), 7: (None, "no_reviews_found")}
    done = reports.where(F.col("product_id") == 0).collect()
    assert len(done) == 1 and "Li-Ion" in str(done[0]) and "Alpha Phone for number" in str(done[0])
