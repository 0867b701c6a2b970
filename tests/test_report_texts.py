"""Only the texts that a report shows are cleaned."""

from pyspark.sql import functions as F

from revidence.plans import q_report

SF = "/root/testdata/sf0.01"


def test_only_kept_texts_are_cleaned(spark):
    out = q_report.q_top_reviews(spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.rindex("regexp_replace")      # the semi join is below the cleaning
    assert out.where(F.col("text").isNotNull()).count() > 0
