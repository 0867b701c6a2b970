"""Hierarchical decoding of logits (E1-E13) as native column expressions.

Per review, the fired top aspects are an ``array<int>`` computed in-row against a literal
threshold array, so the hierarchy mask is ``exists(parents[s], p -> fired contains p)``:
no join and no shuffle. ``decode_cells`` explodes a review into its 29 sub cells only
after the evidence gate, so the long form grows with gated reviews, not with all reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revidence import dims


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigmoid_array(arr: Column) -> Column:
    return F.transform(arr, sigmoid)


def fired_tops(top: Column, thresholds=None) -> Column:
    """Indices t with sigmoid(top[t]) > thr[t] (strict), ascending."""
    thr = dims.lit_doubles(dims.TOP_THRESHOLDS if thresholds is None else thresholds)
    n = len(dims.TOP_THRESHOLDS if thresholds is None else thresholds)
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)),
                    lambda t: sigmoid(F.get(top, t)) > F.get(thr, t))


def allowed_sub(fired: Column, parents: Column) -> Column:
    """Hierarchy mask: some parent fired, or no top fired at all (then every sub is allowed)."""
    return (F.size(fired) == 0) | F.exists(parents, lambda p: F.array_contains(fired, p))


def sentiment_sign(delta: Column) -> Column:
    """+1 for delta >= 0 (a tie counts positive), else -1."""
    return F.when(delta < 0, F.lit(-1)).otherwise(F.lit(1))


def sentiment_conf(delta: Column, temperature: float = dims.SENTIMENT_TEMPERATURE) -> Column:
    """sigmoid(|delta|) / T; the division is outside the sigmoid, range [0.4167, 0.8333)."""
    return sigmoid(F.abs(delta)) / F.lit(float(temperature))


def sentiment_with_margins(delta: Column, m_pos: float, m_neg: float) -> Column:
    """+1 above m_pos, 0 below -m_neg, else -1 (abstain)."""
    return (F.when(delta > F.lit(float(m_pos)), F.lit(1))
            .when(delta < F.lit(-float(m_neg)), F.lit(0))
            .otherwise(F.lit(-1)))


def predict_top(scored: DataFrame, thresholds=None) -> DataFrame:
    """Long form (review_id, top_idx, p_top, pred_top) for all 9 tops."""
    thr = dims.lit_doubles(dims.TOP_THRESHOLDS if thresholds is None else thresholds)
    cells = scored.select("review_id", F.posexplode(F.arrays_zip(
        F.col("top").alias("logit"), thr.alias("thr"))).alias("top_idx", "z"))
    p = sigmoid(F.col("z.logit"))
    return cells.select("review_id", F.col("top_idx"), p.alias("p_top"), (p > F.col("z.thr")).alias("pred_top"))


def decode_cells(scored: DataFrame, taxonomy=None, top_thresholds=None, sub_thresholds=None,
                 comparison_threshold: float = dims.COMPARISON_THRESHOLD,
                 temperature: float = dims.SENTIMENT_TEMPERATURE,
                 keep: tuple[str, ...] = ("product_id", "usefulness")) -> DataFrame:
    """Explode each review into its 29 sub cells with every decoded quantity.

    Output: keep..., review_id, sub_idx, p_sub, allowed, pred_sub, p_comp, pred_comp,
    delta, sign, sconf, n_fired.
    """
    sub_thr = dims.lit_doubles(dims.SUB_THRESHOLDS if sub_thresholds is None else sub_thresholds)
    parents = dims.parents_col(taxonomy)
    base = scored.select(*keep, "review_id", fired_tops(F.col("top"), top_thresholds).alias("fired"),
                         F.arrays_zip(F.col("sub").alias("sub"), F.col("comp").alias("comp"),
                                      F.col("sent").alias("sent"), sub_thr.alias("thr"),
                                      parents.alias("parents")).alias("zz"))
    cells = base.select(*keep, "review_id", "fired", F.posexplode("zz").alias("sub_idx", "z"))
    p_sub = sigmoid(F.col("z.sub"))
    p_comp = sigmoid(F.col("z.comp"))
    allowed = allowed_sub(F.col("fired"), F.col("z.parents"))
    pred_sub = allowed & (p_sub > F.col("z.thr"))
    delta = F.col("z.sent.pos") - F.col("z.sent.neg")
    return cells.select(
        *keep, "review_id", F.col("sub_idx").cast("int").alias("sub_idx"),
        p_sub.alias("p_sub"), allowed.alias("allowed"), pred_sub.alias("pred_sub"),
        p_comp.alias("p_comp"), (pred_sub & (p_comp > F.lit(float(comparison_threshold)))).alias("pred_comp"),
        delta.alias("delta"), sentiment_sign(delta).alias("sign"),
        sentiment_conf(delta, temperature).alias("sconf"), F.size("fired").alias("n_fired"),
    )


def gate_logits(sub_logit: Column, prior: Column, weight: float = 0.5, mode: str = "add",
                clamp: bool = True) -> Column:
    """Prior gating: sub + w * clamp(prior, 0, 1) ('add') or sub * (1 + w * prior) ('mul')."""
    pr = F.least(F.greatest(prior, F.lit(0.0)), F.lit(1.0)) if clamp else prior
    if mode == "add":
        return sub_logit + F.lit(float(weight)) * pr
    return sub_logit * (F.lit(1.0) + F.lit(float(weight)) * pr)
