"""Threshold study: Pareto front golden and trial-scoring properties."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revidence.operators import thresholds as th

# Published Pareto-trials CSV (27 rows, 38 thresholds each); path given by the environment.
CSV = os.environ.get("REVIDENCE_GOLDEN_TRIALS_CSV", "")


@pytest.mark.skipif(not (CSV and os.path.exists(CSV)), reason="REVIDENCE_GOLDEN_TRIALS_CSV not set")
def test_published_front_is_non_dominated(spark):
    t = th.load_trials_csv(spark, CSV)
    assert t.count() == 27
    front = th.pareto_front_2d(t, "aspect_precision", "aspect_recall")
    assert front.count() == 27
    assert th.trials_long(t).count() == 27 * 38


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=25))
def test_skyline_matches_brute_force(spark, pts):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(pts)]
    df = spark.createDataFrame(rows, "trial INT, a DOUBLE, b DOUBLE")
    got = {r.trial for r in th.pareto_front_2d(df, "a", "b").collect()}
    got_nd = {r.trial for r in th.pareto_front(df, ["a", "b"]).collect()}
    brute = {i for i, a, b in rows if not any(a2 >= a and b2 >= b and (a2 > a or b2 > b) for _, a2, b2 in rows)}
    assert got == brute == got_nd


@pytest.mark.skipif(not (CSV and os.path.exists(CSV)), reason="REVIDENCE_GOLDEN_TRIALS_CSV not set")
def test_chosen_trial_equals_shipped_thresholds(spark):
    from revidence import dims
    t = th.load_trials_csv(spark, CSV)
    long = {r.class_idx: r.thr for r in th.trials_long(t).where("trial = 296").collect()}
    assert len(long) == 38
    for i, v in enumerate(dims.TOP_THRESHOLDS):
        assert long[i] == pytest.approx(v, abs=1e-12)
    for i, v in enumerate(dims.SUB_THRESHOLDS):
        assert long[9 + i] == pytest.approx(v, abs=1e-12)
    row = t.where("trial = 296").first()
    assert row.aspect_precision == pytest.approx(0.6735, abs=1e-4) and row.aspect_recall == pytest.approx(0.7747, abs=1e-4)
    assert 0.2 < row.duration_s < 0.5


def test_counts_equal_a_plain_loop(spark):
    """Counter arrays against one review, trial and sub at a time; trials as a number and as a table; a review without labels."""
    import random

    from revidence import dims
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 2) for _ in range(9)], [rng.gauss(0, 2) for _ in range(29)]) for i in range(1300)]
    labels = {i: {rng.randrange(29) for _ in range(rng.randrange(1, 5))} for i in range(0, 1300, 2)}
    scored = spark.createDataFrame(rows, "review_id LONG, top ARRAY<DOUBLE>, sub ARRAY<DOUBLE>").repartition(3)
    dense = th.labels_dense(spark.createDataFrame([(i, s) for i, ss in labels.items() for s in ss], "review_id LONG, sub_idx INT"))
    wide = th.trials_wide(th.threshold_candidates(spark, 70))
    thr = {r.trial: (r.top_thr, r.sub_thr) for r in wide.collect()}
    parents = dims.parents_of()
    import math
    sig = lambda x: 1 / (1 + math.exp(-x))
    got = {(r.trial, r.sub_idx): (r.tp, r.fp, r.fn) for r in th.trial_counts(scored, dense, 70).collect()}
    assert got == {(r.trial, r.sub_idx): (r.tp, r.fp, r.fn) for r in th.trial_counts(scored, dense, wide).collect()} and len(got) == 70 * 29
    for trial in (0, 63, 64, 69):
        want = {s: [0, 0, 0] for s in range(29)}
        for i, top, sub in rows:
            fired = {t for t in range(9) if sig(top[t]) > thr[trial][0][t]}
            for s in range(29):
                pred = (not fired or bool(fired & set(parents[s]))) and sig(sub[s]) > thr[trial][1][s]
                y = s in labels.get(i, ())
                want[s][0 if y and pred else 1 if pred else 2] += y or pred
        assert {s: got[trial, s] for s in range(29)} == {s: tuple(v) for s, v in want.items()}
    with pytest.raises(ValueError):
        th.trial_counts(scored, dense, th.MAX_TRIALS + 1)


def test_skyline_of_six_objectives_over_blocks(spark, monkeypatch):
    """Blocks of 100 rows: equal to brute force; ties and repeated vectors stay together; null and NaN rows are out."""
    import numpy as np
    monkeypatch.setattr(th, "FRONT_BLOCK", 100)
    rng = np.random.default_rng(2)
    p = np.round(rng.random((4000, 6)) ** 0.3, 2)
    p[::10] = p[5]
    rows = [(i, *map(float, x)) for i, x in enumerate(p)] + [(9001, None, *[2.0] * 5), (9002, float("nan"), *[2.0] * 5)]
    names = [f"o{i}" for i in range(6)]
    df = spark.createDataFrame(rows, "trial INT, " + ", ".join(f"{n} DOUBLE" for n in names)).withColumn("v", th.F.lit("extra"))
    want = {i for i, x in enumerate(p) if not ((p >= x).all(axis=1) & (p > x).any(axis=1)).any()}
    assert {r.trial for r in th.pareto_front(df, names).collect()} == want and len(want) > 200


def test_many_rows_of_skyline(spark):
    cols = [th.F.pmod(th.F.xxhash64("id", th.F.lit(i)), th.F.lit(1000)).cast("double").alias(f"o{i}") for i in range(6)]
    df = spark.range(100_000).select(th.F.col("id").alias("trial"), *cols).where("o0 + o1 + o2 + o3 + o4 + o5 < 4200 or trial % 97 = 0")
    import numpy as np
    front = th.pareto_front(df, [f"o{i}" for i in range(6)]).collect()
    f = np.array([r[1:] for r in front], float)
    some = np.array([r[1:] for r in df.where("trial % 499 = 0").collect()], float)
    inside = {tuple(x) for x in f}
    for x in some:                                                       # a sample: in the front, or dominated by a row of it
        assert tuple(x) in inside or ((f >= x).all(axis=1) & (f > x).any(axis=1)).any()
    for x in f[:200]:
        assert not ((some >= x).all(axis=1) & (some > x).any(axis=1)).any()
