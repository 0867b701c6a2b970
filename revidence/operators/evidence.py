"""Evidence weighting and per-(product, sub-aspect) aggregation.

Everything except the two medians is an additive aggregate, so one
``groupBy(product_id, sub_idx).agg`` with map-side partial sums computes score, sign,
agreement, volume and confidence. The medians use :func:`exact_median`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revidence import dims
from revidence.operators.median import exact_median
from revidence.operators.predict import sentiment_conf

EPS = 1e-8
SIGN_EPS = 1e-6


def g_conf(c: Column, alpha: float = dims.CONFIDENCE_ALPHA) -> Column:
    return F.lit(1.0) - F.exp(-c / F.lit(float(alpha)))


def g_power(c: Column, alpha: float = 1.0) -> Column:
    return F.pow(c, F.lit(float(alpha)))


def h_useful(u: Column, beta: float = dims.CONFIDENCE_BETA) -> Column:
    return F.log1p(F.lit(float(beta)) * u)


def raw_weight(sconf: Column, usefulness: Column, alpha: float = dims.CONFIDENCE_ALPHA,
               beta: float = dims.CONFIDENCE_BETA) -> Column:
    return g_conf(sconf, alpha) * h_useful(usefulness, beta)


def norm_weight(sconf: Column, usefulness: Column, med_c: Column, med_u: Column,
                alpha: float = dims.CONFIDENCE_ALPHA, beta: float = dims.CONFIDENCE_BETA) -> Column:
    return (g_conf(sconf / (med_c + F.lit(EPS)), alpha)
            * h_useful(usefulness / (med_u + F.lit(EPS)), beta))


def robust_sign(x: Column, eps: float = SIGN_EPS) -> Column:
    return (F.when(x > F.lit(eps), F.lit(1)).when(x < F.lit(-eps), F.lit(-1)).otherwise(F.lit(0)))


def reliability_term(r: Column) -> Column:
    return (F.lit(dims.RELIABILITY_FLOOR)
            + F.lit(1.0 - dims.RELIABILITY_FLOOR) * F.pow(r, F.lit(dims.RELIABILITY_EXPONENT)))


def reliability_col(sub_idx: Column) -> Column:
    return F.get(dims.lit_doubles(dims.SUB_RELIABILITY), sub_idx)


def product_medians(gated: DataFrame, temperature: float = dims.SENTIMENT_TEMPERATURE,
                    checkpoint: bool = True, method: str = "exact", accuracy: int = 100000) -> DataFrame:
    """Per product: median sentiment confidence over all N x 29 cells, median usefulness over N.

    ``method="exact"`` (default): both medians run in the same histogram-refinement passes
    (grouped by product and metric). ``method="approx"``: ``percentile_approx`` sketches
    (bounded memory per group, rank error <= n / accuracy), one aggregation.
    """
    stacked = gated.select(
        "product_id",
        F.explode(F.concat(
            F.transform("sent", lambda s: F.struct(F.lit("c").alias("m"),
                                                   sentiment_conf(s["pos"] - s["neg"], temperature).alias("v"))),
            F.array(F.struct(F.lit("u").alias("m"), F.col("usefulness").alias("v"))),
        )).alias("x"),
    ).select("product_id", F.col("x.m").alias("metric"), F.col("x.v").alias("v"))
    if method == "approx":
        med = stacked.groupBy("product_id", "metric").agg(F.percentile_approx("v", 0.5, accuracy).alias("med"))
    elif method == "exact":
        med = exact_median(stacked, ["product_id", "metric"], "v", out="med", checkpoint=checkpoint)
    else:
        raise ValueError("method must be 'exact' or 'approx'")
    return med.groupBy("product_id").agg(
        F.max(F.when(F.col("metric") == "c", F.col("med"))).alias("med_c"),
        F.max(F.when(F.col("metric") == "u", F.col("med"))).alias("med_u"),
    )


def sub_evidence(cells: DataFrame, medians: DataFrame, agreement: str = "aggregated",
                 alpha: float = dims.CONFIDENCE_ALPHA, beta: float = dims.CONFIDENCE_BETA,
                 gamma: float = dims.CONFIDENCE_GAMMA, phi: float = dims.CONFIDENCE_PHI) -> DataFrame:
    """Per (product_id, sub_idx) over predicted cells: sentiment score, sign, agreement,
    volume and the 0-100 confidence.

    ``agreement="aggregated"`` reproduces the production call (the aggregated sign vector is
    passed as the per-review sentiments, so agreement is ~1 wherever there is support);
    ``"per_review"`` uses each review's own sign, as the docstring describes.
    """
    if agreement not in ("aggregated", "per_review"):
        raise ValueError("agreement must be 'aggregated' or 'per_review'")
    pc = cells.where("pred_sub").join(medians, "product_id")
    u = F.col("usefulness")
    wn = norm_weight(F.col("sconf"), u, F.col("med_c"), F.col("med_u"), alpha, beta)
    w = raw_weight(F.col("sconf"), u, alpha, beta)
    s = F.col("sign").cast("double")
    agg = pc.groupBy("product_id", "sub_idx").agg(
        F.count("*").alias("n_cells"),
        F.sum(s * wn).alias("s_num"),
        F.sum(wn).alias("s_den"),
        F.sum(w).alias("sw"),
        F.sum(s * w).alias("ssw"),
        F.sum(h_useful(u, beta)).alias("vol_raw"),
        F.sum(F.col("pred_comp").cast("int")).alias("n_comp"),
    )
    score = F.col("s_num") / (F.col("s_den") + F.lit(EPS))
    agg = agg.withColumn("score", score).withColumn("sign", robust_sign(F.col("score")))
    sgn = F.col("sign").cast("double")
    if agreement == "aggregated":
        agree = F.abs(sgn * F.col("sw")) / (F.abs(sgn) * F.col("sw") + F.lit(EPS))
    else:
        agree = F.abs(F.col("ssw")) / (F.col("sw") + F.lit(EPS))
    volume = F.lit(1.0) - F.exp(-F.col("vol_raw") / F.lit(float(gamma)))
    rel = reliability_term(reliability_col(F.col("sub_idx")))
    conf = F.lit(100.0) * F.pow(rel * F.col("agreement") * F.col("volume"), F.lit(float(phi)))
    return (agg.withColumn("agreement", agree).withColumn("volume", volume)
            .withColumn("confidence", conf))
