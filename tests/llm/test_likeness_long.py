import pytest
from pyspark.sql import functions as F

from revidence.llm import multiset_hash as M


def text(tag, ids):
    return "\n".join(f"{tag} paragraph {i}" for i in ids)


@pytest.mark.parametrize("n", [200, 1_000, 10_000, 100_000])
def test_likeness_does_not_fall_with_the_length(spark, n):
    """Mean over some pairs of texts that share a half or nine tenths of their paragraphs."""
    pairs = max(4, min(24, 100_000 // n))
    for share in (0.5, 0.9):
        rows = []
        for k in range(pairs):
            own = round(n * (1 - share))
            common = [text(f"s{k}", range(n - own))] if own < n else []
            rows.append(("\n".join([*common, text(f"a{k}", range(own))]), "\n".join([text(f"b{k}", range(own)), *common])))
        got = spark.createDataFrame(rows, "a string, b string").repartition(4).select(M.vector(F.col("a")).alias("a"), M.vector(F.col("b")).alias("b")).select(
            M.likeness(F.col("a"), F.col("b")).alias("l")).collect()
        found = [g.l for g in got]
        assert abs(sum(found) / len(found) - share) < 0.12, (share, found)


def test_deep_levels_are_incremental(spark):
    a, b = text("x", range(3_000)), text("y", range(5))
    row = spark.createDataFrame([(a, b, a + "\n" + b)], "a string, b string, ab string").select(
        *[M.vector(F.col(c)).alias(c) for c in ("a", "b", "ab")]).select("*", M.combine(F.col("a"), F.col("b")).alias("sum"), M.remove(F.col("ab"), F.col("a")).alias("rest"), M.likeness(F.col("a"), F.col("ab")).alias("l")).first()
    assert len(row.a) > M.SIZE and row["sum"] == row.ab and row.rest == row.b
    assert row.l > 0.8
    assert M.DEEPEST <= 28
