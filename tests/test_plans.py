"""Plan assertions: the physical plans we rely on for scale."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def formatted(df) -> str:
    import io
    import contextlib
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["product_report", "sub_aspect_rows", "attribute_products", "lookup_product",
                                  "end_to_end_report", "flatten_specs"])
def test_no_python_and_no_cartesian(spark, name):
    p = formatted(E.queries()[name](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_trials_are_counted_in_arrays(spark):
    """One row a review reaches the counters; no row per review and trial, no join with the trials."""
    p = formatted(E.queries()["trial_scores"](spark, SF))
    assert "MapInArrow" in p and "Generate" not in p and "NestedLoop" not in p


def test_scoring_uses_python_and_html_does_not(spark):
    assert "MapInPandas" not in formatted(E.queries()["spec_html_parse"](spark, SF))
    assert "MapInPandas" in formatted(E.queries()["score_usefulness"](spark, SF))


def test_topk_uses_window_group_limit(spark):
    from revidence.operators import report
    from revidence.plans import q_report
    p = formatted(report.top_reviews(q_report._analysis(spark, SF).gated_ok))   # the query joins the texts after a cut
    assert "WindowGroupLimit" in p


def test_dimension_joins_broadcast(spark):
    p = formatted(E.queries()["sub_aspect_rows"](spark, SF))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_parquet_pruning(spark):
    p = formatted(E.queries()["clean_text"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
