import warnings

import numpy as np
import pytest

from revidence.llm import mixing


def members(spark, shares, n=600, leak=0.05):
    """Soft posteriors, each document of one domain with a mean leak into the others."""
    rng = np.random.default_rng(3)
    K = len(shares)
    rows = []
    for k, s in enumerate(shares):
        for _ in range(n // K):
            out = rng.exponential(leak, K)
            out[k] = 0.0
            p = out / max(1.0, out.sum() / 0.5)
            p[k] = 1 - p.sum()
            rows.append((float(s) * 1000, p.tolist()))
    return spark.createDataFrame([(int(t), p) for t, p in rows], "tokens long, p array<double>").repartition(4).cache()


@pytest.mark.parametrize("shares", [(0.97, 0.01, 0.01, 0.01), (0.332, 0.332, 0.333, 0.003), (0.01, 0.01, 0.97, 0.01)])
def test_skewed_domains_meet_their_targets(spark, shares):
    docs = members(spark, [s * 100 for s in shares])
    total = docs.toPandas().tokens.sum()
    goals = [total * x for x in (0.2, 0.4, 0.2, 0.2)]
    rate, errors = mixing.fit(docs, goals)
    got = docs.withColumn("r", rate).toPandas()
    totals = (got.r * got.tokens).to_numpy() @ np.array(got.p.tolist())
    assert got.r.min() >= 0 and np.abs(totals / goals - 1).max() < 1e-3, (totals / goals, len(errors))
    assert np.allclose(list(errors[-1].values()), totals / goals - 1, atol=1e-6)


def test_targets_out_of_reach_are_reported(spark):
    docs = spark.createDataFrame([(i, "the of and " * (1 + i % 3), "en") for i in range(30)] + [(50, "der und die", "de")], "doc_id long, text string, domain string")
    left = {}
    with pytest.warns(UserWarning, match="relative errors"):
        mixing.mix(docs, docs.select("text", "domain"), {"en": 1, "de": 99}, floor=1.0, residuals=left)
    assert left["en"] > 1
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        mixing.mix(docs, docs.select("text", "domain"), {"en": 1, "de": 1}, residuals=left)
    assert max(map(abs, left.values())) < 1e-3
