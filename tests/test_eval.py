"""Hand-computed goldens for the metric definitions (sklearn semantics, zero_division=0)."""

import pytest
from pyspark.sql import functions as F

from revidence.operators import evaluate as ev
from revidence.operators import thresholds as th


def test_class_metrics_and_zero_division(spark):
    rows = [(0, 1, 1), (0, 1, 0), (0, 0, 1), (0, 0, 0), (1, 0, 0), (1, 0, 0)]
    df = spark.createDataFrame(rows, "cls INT, y INT, pred INT")
    m = {r.cls: r for r in ev.class_metrics(df, ["cls"]).collect()}
    assert (m[0].precision, m[0].recall, m[0].f1, m[0].support) == (0.5, 0.5, 0.5, 2)
    assert (m[1].precision, m[1].recall, m[1].f1, m[1].support) == (0.0, 0.0, 0.0, 0)
    mac = ev.macro(ev.class_metrics(df, ["cls"]).withColumn("g", ev.F.lit(1)), ["g"]).first()
    assert mac.precision == pytest.approx(0.25) and mac.f1 == pytest.approx(0.25)


def test_three_way_macro_fixed_labels(spark):
    df = spark.createDataFrame([(1, -1, -1), (1, 0, 1), (1, 1, 1), (1, 1, 0)], "g INT, y INT, p INT")
    m = ev.macro(ev.three_way(df, ["g"], "y", "p"), ["g"]).first()
    assert (m.precision, m.recall, m.f1) == (pytest.approx(0.5), pytest.approx(0.5), pytest.approx(0.5))


def test_present_labels_macro(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 1, 1)], "g INT, y INT, p INT")
    m = ev.present_labels_macro(df, ["g"], "y", "p").first()
    assert m.precision == pytest.approx(1 / 3) and m.recall == pytest.approx(0.5) and m.f1 == pytest.approx(0.4)


def test_pos_weight(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (0, 0), (0, 0)], "cls INT, y INT")
    assert ev.pos_weights(df, ["cls"]).first().pos_weight == pytest.approx(3 / (1 + 1e-6))


def test_penalty_and_front(spark):
    counts = spark.createDataFrame([(0, 0, 9, 1, 1), (1, 0, 5, 5, 5), (2, 0, 8, 2, 1)],
                                   "trial INT, sub_idx INT, tp BIGINT, fp BIGINT, fn BIGINT")
    s = {r.trial: r for r in th.trial_scores(counts).collect()}
    assert s[1].aspect_recall == pytest.approx(0.5) and s[1].obj_precision == pytest.approx(-0.5)
    assert s[0].obj_precision == pytest.approx(0.9) and s[0].obj_recall == pytest.approx(0.9)
    front = {r.trial for r in th.pareto_front_2d(th.trial_scores(counts), "obj_precision", "obj_recall").collect()}
    assert front == {0}


def test_skyline_keeps_equal_points(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 1.0), (2, 0.5, 2.0), (3, 0.5, 1.0)], "trial INT, a DOUBLE, b DOUBLE")
    assert {r.trial for r in th.pareto_front_2d(df, "a", "b").collect()} == {0, 1, 2}


def test_weighted_sample_is_stable_and_weighted(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 20000).select(F.col("id"), F.when(F.col("id") % 10 == 0, 5.0).otherwise(1.0).alias("w"))
    a = ev.weighted_sample(df, "id", "w", 0.1)
    b = ev.weighted_sample(df, "id", "w", 0.1)
    assert a.exceptAll(b).count() == 0
    heavy = a.where("w = 5.0").count() / 2000
    light = a.where("w = 1.0").count() / 18000
    assert 3.5 < heavy / light < 7.0


def test_label_records_from_json(spark, tmp_path):
    lines = ['{"review_id": 1, "top_cluster_ids": 2, "sub_cluster_ids": [4, -1, 7], "top_to_sub_ids": {"2": [4, 7]}, "sentiments": {"4": "positive", "7": "mixed"}}',
             '{"review_id": 2, "top_cluster_ids": [0,0,1,0,0,0,0,0,1], "sub_cluster_ids": [' + ",".join("0.5" if i in (0, 28) else "0" for i in range(29)) + '], "top_to_sub_ids": {"2": [4], "8": [28]}, "sentiments": {"28": null}}',
             '{"review_id": 3, "top_cluster_ids": 11}', '{"review_id": 4, "sub_cluster_ids": null, "top_to_sub_ids": {}, "sentiments": {"3": "negative"}}']
    (tmp_path / "labels.json").write_text("\n".join(lines))
    r = ev.load_label_records(spark, str(tmp_path / "labels.json"))
    assert sorted(map(tuple, ev.taxonomy_from_records(r).collect())) == [(2, 4), (2, 7), (8, 28)]
    got = {x.review_id: (x.t, x.s) for x in r.select("review_id", ev.top_vector(F.col("top_cluster_ids")).alias("t"), ev.normalize_label_vector(F.col("sub_cluster_ids")).alias("s")).collect()}
    assert got == {1: ([0, 0, 1, 0, 0, 0, 0, 0, 0], [4, 7]), 2: ([0, 0, 1, 0, 0, 0, 0, 0, 1], [0, 28]), 3: (None, []), 4: (None, [])}
    assert sorted(map(tuple, ev.map_sentiments(r, {"negative": 0, "positive": 1}).collect())) == [(1, 4, 1), (4, 3, 0)]
    assert sorted(map(tuple, ev.map_sentiments(r, None).collect())) == [(1, 4, "positive"), (1, 7, "mixed"), (4, 3, "negative")]
