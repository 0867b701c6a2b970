"""Boundary goldens and properties of the decode -> gate -> evidence core."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revidence import dims
from revidence.operators import evidence as ev
from revidence.operators import predict, report
from revidence.operators.median import exact_median
from revidence.plans.analysis import analyze


def scored_rows(spark, rows):
    """rows: (review_id, product_id, relevance, usefulness, top[9], sub[29], comp[29], neg/pos pairs[29])."""
    return spark.createDataFrame(rows, dims.SCORED_SCHEMA)


def row(rid, pid, rel=1.0, use=9.0, top=None, sub=None, comp=None, sent=None):
    top = top or [-10.0] * 9
    sub = sub or [-10.0] * 29
    comp = comp or [-10.0] * 29
    sent = sent or [(0.0, 1.0)] * 29
    return (rid, pid, rel, use, top, sub, comp, [{"neg": a, "pos": b} for a, b in sent])


def test_gate_is_strict(spark):
    df = scored_rows(spark, [row(1, 1, rel=0.7), row(2, 1, use=7.0), row(3, 1, rel=0.7000001, use=7.0000001)])
    got = [r.review_id for r in report.evidence_gate(df).collect()]
    assert got == [3]


def test_sufficiency_needs_more_than_ten(spark):
    rows = [row(i, 1) for i in range(10)] + [row(100 + i, 2) for i in range(11)]
    df = scored_rows(spark, rows)
    st_ = {r.product_id: r.status for r in report.evidence_sufficiency(df, report.evidence_gate(df)).collect()}
    assert st_ == {1: report.STATUS_INSUFFICIENT, 2: report.STATUS_OK}


def test_no_top_allows_all_subs_and_mask(spark):
    sub = [5.0] * 29                       # every sub probability ~0.993
    top_none = [-10.0] * 9
    top_cam = [-10.0] * 9
    top_cam[2] = 10.0                      # camera fired: only subs 7, 8 allowed
    df = scored_rows(spark, [row(1, 1, top=top_none, sub=sub), row(2, 1, top=top_cam, sub=sub)])
    cells = predict.decode_cells(df).collect()
    pred = {(c.review_id, c.sub_idx) for c in cells if c.pred_sub}
    assert {s for r, s in pred if r == 1} == set(range(29))
    assert {s for r, s in pred if r == 2} == {7, 8}


def test_sentiment_tie_is_positive_and_conf_range(spark):
    df = scored_rows(spark, [row(1, 1, sent=[(0.0, 0.0)] * 29), row(2, 1, sent=[(2.0, 0.0)] * 29)])
    cells = {(c.review_id, c.sub_idx): c for c in predict.decode_cells(df).collect()}
    assert cells[(1, 0)].sign == 1 and cells[(1, 0)].sconf == pytest.approx(0.5 / 1.2)
    assert cells[(2, 0)].sign == -1 and cells[(2, 0)].sconf == pytest.approx(1 / (1 + math.exp(-2.0)) / 1.2)


def test_primary_parent_is_lowest(spark):
    pp = {r.sub_idx: r.top_idx for r in report.primary_parent(spark).collect()}
    assert pp[20] == 3 and pp[27] == 3 and pp[28] == 3 and len(pp) == 29


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(1, 2, 1, 42.5), (1, 3, 1, 43.5)], "product_id INT, sub_idx INT, sign INT, confidence DOUBLE")
    rows = {r.sub_idx: r.sub_aspect_confidence for r in report.sub_aspect_rows(spark, df).collect()}
    assert rows == {2: 42, 3: 44}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.floats(-1e3, 1e3, allow_nan=False, allow_infinity=False, width=16)),
                min_size=1, max_size=60))
def test_exact_median_matches_numpy(spark, data):
    df = spark.createDataFrame(data, "g INT, x DOUBLE")
    got = {r.g: r.median for r in exact_median(df, ["g"], "x", buckets=16).collect()}
    for g in {g for g, _ in data}:
        assert got[g] == pytest.approx(float(np.median([x for k, x in data if k == g])), rel=1e-12, abs=1e-12)


def test_exact_median_of_clustered_values(spark):
    """Outliers, clusters in one bucket, infinities, denormals: ranges shrink until they are small."""
    import numpy as np
    rng = np.random.default_rng(5)
    groups = {"near": np.concatenate([1 + rng.random(2001) * 1e-12, [1e300, -1e300]]), "same": np.array([0.5] * 3000 + [7.0]),
              "inf": np.concatenate([rng.random(900), [np.inf] * 300, [-np.inf] * 200]), "tiny": 5e-324 * np.arange(400),
              "signs": np.concatenate([-(10.0 ** np.arange(0, 9)), 10.0 ** np.arange(0, 10)]), "one": np.array([3.0]), "two": np.array([-1.5, 2.5])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE").repartition(4)
    for buckets in (64, 1 << 16):
        got = {r.g: r.median for r in exact_median(df, ["g"], "x", buckets=buckets).collect()}
        assert got == {g: float(np.median(xs)) for g, xs in groups.items()}, buckets


def test_exact_median_hot_group_and_duplicates(spark):
    df = spark.range(0, 20001).select((F.col("id") % 3 == 0).cast("int").alias("g"),
                                      (F.col("id") % 97).cast("double").alias("x"))
    pdf = df.toPandas()
    got = {r.g: r.median for r in exact_median(df, ["g"], "x").collect()}
    for g, grp in pdf.groupby("g"):
        assert got[g] == float(np.median(grp["x"]))


@pytest.fixture(scope="module")
def analysis(spark):
    from revidence.sources.bridges import v_scored
    return analyze(spark, v_scored(spark, "/root/testdata/sf0.01"))


def test_score_and_confidence_ranges(analysis):
    e = analysis.evidence.collect()
    assert e
    for r in e:
        assert -1.0 - 1e-9 <= r.score <= 1.0 + 1e-9
        assert 0.0 <= r.confidence <= 100.0
        if r.sign != 0:
            assert 0.999999 < r.agreement < 1.0     # aggregated mode: ~1, never exactly 1


def test_predicted_subset_of_allowed(analysis):
    assert analysis.cells.where(F.col("pred_sub") & ~F.col("allowed")).count() == 0


def test_per_review_agreement_varies(spark):
    from revidence.sources.bridges import v_scored
    a = analyze(spark, v_scored(spark, "/root/testdata/sf0.01"), agreement="per_review")
    vals = [r.agreement for r in a.evidence.collect()]
    assert min(vals) < 0.9


def test_volume_never_drops_when_adding_review(spark):
    u = F.col("usefulness")
    df = spark.createDataFrame([(float(x),) for x in (7.5, 8.0, 9.9)], "usefulness DOUBLE")
    vols = []
    for n in range(1, 4):
        s = df.limit(n).agg(F.sum(ev.h_useful(u)).alias("v")).first().v
        vols.append(1 - math.exp(-s / dims.CONFIDENCE_GAMMA))
    assert vols == sorted(vols)


def test_approx_medians_close_to_exact(spark):
    from revidence.sources.bridges import v_scored
    g = report.evidence_gate(v_scored(spark, "/root/testdata/sf0.01"))
    ex = {r.product_id: (r.med_c, r.med_u) for r in ev.product_medians(g).collect()}
    ap = {r.product_id: (r.med_c, r.med_u) for r in ev.product_medians(g, method="approx").collect()}
    assert ex.keys() == ap.keys()
    for k in ex:
        assert abs(ex[k][0] - ap[k][0]) < 0.05 and abs(ex[k][1] - ap[k][1]) < 0.5
