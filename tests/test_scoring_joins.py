"""Texts are neither shuffled to the few products nor sent back by the Python workers."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from revidence.operators import scoring
from revidence.sources.bridges import PRODUCT_NAMES, v_products

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["score_usefulness", "score_aspects"])
def test_texts_are_not_shuffled_to_the_products(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "ExistingRDD" not in plan


def test_products_are_the_named_ones(spark):
    assert sorted(map(tuple, v_products(spark).collect())) == sorted((f"src{i}", n) for i, n in enumerate(PRODUCT_NAMES))


def test_scores_are_the_same_without_the_texts(spark):
    df = spark.range(50).select("id", F.concat(F.lit("a good phone "), F.col("id").cast("string")).alias("prompt"))
    whole, bare = scoring.score_usefulness(df), scoring.score_usefulness(df, keep_text=False)
    assert bare.columns == ["id", "usefulness"] and sorted(whole.drop("prompt").collect()) == sorted(bare.collect())
    whole, bare = scoring.score_aspects(df), scoring.score_aspects(df, keep_text=False)
    assert bare.columns == ["id", "top", "sub", "comp", "sent"] and sorted(whole.drop("prompt").collect()) == sorted(bare.collect())
