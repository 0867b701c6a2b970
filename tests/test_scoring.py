"""The scorers: whole texts, bounded memory."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from revidence.operators import scoring


def test_scorer_holds_no_dense_features():
    sc = scoring.HashedLinearScorer()
    texts = [f"battery of phone {i} is good, good" for i in range(3000)] + ["", None]
    tracemalloc.start()
    got, heads = sc.usefulness(texts), sc.aspects(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6      # a matrix of all features is 393 MB
    x = np.zeros(sc.n_features)
    for tok in scoring.TOKEN_RE.findall(texts[7]):
        x[scoring.zlib.crc32(tok.encode()) % sc.n_features] += 1
    x /= np.sqrt(7)
    assert np.isclose(got[7], 10 / (1 + np.exp(-25 * (x @ sc.w_use))), rtol=1e-12) and got[-1] == 5.0
    assert np.allclose(np.concatenate([h[7] for h in heads]), x @ sc.w_asp * 8.0, rtol=1e-9)


def test_native_scores_digest_a_prompt_once_a_block(spark):
    top = str(scoring.native_scores(F.col("p"))[1])
    assert 0 < top.index("md5(") < top.index("sequence(")      # outside the lambda over the values
