import zlib

import numpy as np

from revidence.llm import quality_fm as Q


def test_long_texts_are_learned_from_whole(spark):
    """Two words in the highest buckets tell the classes apart, in texts of far more than 512 distinct words."""
    bucket = lambda w: zlib.crc32(w.encode()) % Q.BUCKETS
    good, bad = sorted((f"sign{i}" for i in range(4_000)), key=bucket)[-2:]
    filler = [f"word{i}" for i in range(1_500)]
    rows = [(" ".join([*filler, good if i % 2 else bad]), i % 2) for i in range(120)]
    model = Q.train(spark.createDataFrame(rows, "text string, label int"))
    assert model.w[bucket(good)] > 0 > model.w[bucket(bad)]
    assert model.score(rows[1][0]) > model.score(rows[0][0])


def test_training_reads_the_features_that_scoring_reads(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(3_000))
    monkeypatch.setattr(Q, "fit", lambda rows: rows)
    (x, values, label), = Q.train(spark.createDataFrame([(text, 1)], "text string, label int"))
    want_x, want_values = Q.features(text)
    assert len(x) > 2_500 and np.array_equal(x, want_x) and np.allclose(values, want_values) and label == 1
