"""Exact per-group median that never holds a whole group in one task.

Spark's ``median``/``percentile`` keep every distinct value of a group in the final
aggregation buffer, so one hot product (a third of all rows) would land in one task.
Here the median is found by histogram refinement instead:

1. one aggregation per group: count, min, max (map-side combined);
2. while any group's range of possible values holds more than ``buckets`` rows and more than one value: the rows of those
   groups inside their ranges go to ``buckets`` buckets (a monotone map, so bucket order = value order) that are counted
   with map-side combine, and the range shrinks to the values of the bucket that holds the wanted rank. The ends of a range have
   buckets of their own, so every round shrinks it, whatever the values (outliers, infinities, NaN as the greatest);
3. a last round counts the distinct values left in the ranges of more than one value (at most ``buckets`` each) and picks the rank.
   Groups of up to ``buckets`` rows need this round only; a range of one value needs none.

Every shuffle carries at most (groups x buckets) rows per map partition, and every window
runs over at most ``buckets`` rows of one group. Both middle ranks are tracked so an even
count gives the mean of the two middles, like NumPy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revidence.session import cut_lineage


def _pick(state: DataFrame, hist: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    # cumulative counts on the histogram itself (partitioned like the join that follows)
    w = Window.partitionBy(*keys, "lo", "hi").orderBy(order_col)
    h = hist.withColumn("cum", F.sum("c").over(w))
    j = state.join(h, keys + ["lo", "hi"])
    return j.where((F.col("cum") - F.col("c") <= F.col("k")) & (F.col("k") < F.col("cum")))


def _bucket(buckets: int) -> Column:
    """0 for the least value of a range, buckets - 1 for the greatest, equal widths between; halves keep hi - lo finite."""
    part = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    inner = F.greatest(F.lit(0.0), F.least(F.nanvl(part, F.lit(0.0)), F.lit(1.0))) * (buckets - 2)
    return (F.when(F.col("v") == F.col("hi"), buckets - 1).when(F.col("v") == F.col("lo"), 0)
            .otherwise(F.least(F.floor(inner), F.lit(buckets - 3)) + 1).cast("bigint"))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median",
                 buckets: int = 1 << 16, checkpoint: bool = True) -> DataFrame:
    """Exact median of ``value`` per ``keys`` group; nulls are left out, and rows with a null key with them.

    The per-group search state (two rows per group) is checkpointed after every round, so each
    round's plan is one scan of ``df`` plus a small table instead of a tree that doubles per round.
    Without ``checkpoint`` the plan of a round holds those of all rounds before it.
    """
    if buckets < 3:
        raise ValueError("buckets must be at least 3")
    cut = cut_lineage if checkpoint else (lambda x: x)
    vals = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    stats = vals.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = cut(stats.select(
        *keys, "lo", "hi", "n",
        F.explode(F.array(
            F.struct(F.lit(0).alias("which"), F.floor((F.col("n") - 1) / 2).cast("bigint").alias("k")),
            F.struct(F.lit(1).alias("which"), F.floor(F.col("n") / 2).cast("bigint").alias("k")),
        )).alias("t"),
    ).select(*keys, "lo", "hi", "t.which", "t.k", "n"))

    wide = (F.col("hi") > F.col("lo")) & (F.col("n") > buckets)
    while state.where(wide).limit(1).count():
        ranges = state.where(wide).select(*keys, "lo", "hi").distinct()
        cand = vals.join(ranges, keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
        hist = (cand.groupBy(*keys, "lo", "hi", _bucket(buckets).alias("b"))
                .agg(F.count("*").alias("c"), F.min("v").alias("bmin"), F.max("v").alias("bmax")))
        picked = _pick(state.where(wide), hist, keys, "b")
        state = cut(state.where(~wide).unionByName(picked.select(
            *keys, F.col("bmin").alias("lo"), F.col("bmax").alias("hi"), "which",
            (F.col("k") - (F.col("cum") - F.col("c"))).alias("k"), F.col("c").alias("n"))))

    several = F.col("hi") > F.col("lo")
    ranges = state.where(several).select(*keys, "lo", "hi").distinct()
    cand = vals.join(ranges, keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
    distinct_vals = cand.groupBy(*keys, "lo", "hi", "v").agg(F.count("*").alias("c"))
    found = _pick(state.where(several), distinct_vals, keys, "v").select(*keys, "v").unionByName(
        state.where(~several).select(*keys, F.col("lo").alias("v")))
    return found.groupBy(*keys).agg(((F.min("v") + F.max("v")) / 2).alias(out))
