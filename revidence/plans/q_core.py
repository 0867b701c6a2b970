"""Registered queries for the scoring core: gate, decode, evidence, report rows (C6, C7, E, F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revidence import dims
from revidence.operators import evidence as ev
from revidence.operators import predict, report
from revidence.plans import oracle_sql as O
from revidence.plans.analysis import analyze
from revidence.sources.bridges import v_scored

QUERIES: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


R6 = lambda c: F.round(c, 6)


# --- M1: the minimum slice --------------------------------------------------------------

@register("sub_aspect_rows", O.core_prefix() + """
SELECT e.product_id, pp.top_idx::INTEGER AS top_idx, dtop.top_name AS top_aspect_name,
       e.sub_idx::INTEGER AS sub_idx, dsub.sub_name AS sub_aspect_name,
       CASE WHEN e.sgn > 0 THEN 'positive' ELSE 'negative' END AS sub_aspect_sentiment,
       round_even(e.confidence, 0)::BIGINT AS sub_aspect_confidence,
       round(e.confidence, 6) AS confidence
FROM evidence e JOIN pp USING (sub_idx) JOIN dtop ON dtop.top_idx = pp.top_idx JOIN dsub ON dsub.sub_idx = e.sub_idx
WHERE e.confidence <> 0
""")
def q_sub_aspect_rows(spark, d):
    return analyze(spark, v_scored(spark, d)).sub_rows


@register("evidence_gate", O.with_(O.V_SCORED, O.gate_ctes()) + """
SELECT review_id, product_id, round(relevance, 6) AS relevance, round(usefulness, 6) AS usefulness FROM gated
""")
def q_evidence_gate(spark, d):
    g = report.evidence_gate(v_scored(spark, d))
    return g.select("review_id", "product_id", R6("relevance").alias("relevance"), R6("usefulness").alias("usefulness"))


@register("evidence_sufficiency", O.with_(O.V_SCORED, O.gate_ctes()) + f"""
SELECT p.product_id, coalesce(c.n_gated, 0)::BIGINT AS n_gated,
       CASE WHEN coalesce(c.n_gated, 0) > {dims.MIN_EVIDENCE} THEN 'ok' ELSE 'insufficient_review_evidence' END AS status
FROM (SELECT DISTINCT product_id FROM v_scored) p LEFT JOIN cnt c USING (product_id)
""")
def q_evidence_sufficiency(spark, d):
    s = v_scored(spark, d)
    return report.evidence_sufficiency(s, report.evidence_gate(s))


def _cells_sql(select: str, where: str = "") -> str:
    return O.with_(O.V_SCORED, O.gate_ctes(), O.cells_ctes("gok")) + select + (" " + where if where else "")


@register("sigmoid_probs", O.with_(O.V_SCORED) + f"""
SELECT review_id, t::INTEGER AS top_idx, round({O.sigmoid('top[t + 1]')}, 6) AS p_top
FROM v_scored CROSS JOIN (SELECT unnest(range(9)) AS t) x
""")
def q_sigmoid_probs(spark, d):
    s = v_scored(spark, d)
    return s.select("review_id", F.posexplode(predict.sigmoid_array(F.col("top"))).alias("top_idx", "p")).select(
        "review_id", F.col("top_idx").cast("int").alias("top_idx"), R6("p").alias("p_top"))


@register("predict_top", O.with_(O.V_SCORED) + f"""
SELECT review_id, t::INTEGER AS top_idx, {O.sigmoid('top[t + 1]')} > {O.dbl_list(dims.TOP_THRESHOLDS)}[t + 1] AS pred_top
FROM v_scored CROSS JOIN (SELECT unnest(range(9)) AS t) x
""")
def q_predict_top(spark, d):
    return predict.predict_top(v_scored(spark, d)).select("review_id", F.col("top_idx").cast("int").alias("top_idx"),
                                                          "pred_top")


@register("hier_mask", _cells_sql("SELECT review_id, sub_idx, allowed, n_fired::INTEGER AS n_fired FROM cells"))
def q_hier_mask(spark, d):
    a = analyze(spark, v_scored(spark, d))
    return a.cells.select("review_id", "sub_idx", "allowed", F.col("n_fired").cast("int").alias("n_fired"))


@register("predict_sub", _cells_sql("SELECT review_id, sub_idx, round(p_sub, 6) AS p_sub FROM cells", "WHERE pred_sub"))
def q_predict_sub(spark, d):
    a = analyze(spark, v_scored(spark, d))
    return a.cells.where("pred_sub").select("review_id", "sub_idx", R6("p_sub").alias("p_sub"))


@register("predict_comparison", _cells_sql("SELECT review_id, sub_idx, round(p_comp, 6) AS p_comp FROM cells",
                                           "WHERE pred_comp"))
def q_predict_comparison(spark, d):
    a = analyze(spark, v_scored(spark, d))
    return a.cells.where("pred_comp").select("review_id", "sub_idx", R6("p_comp").alias("p_comp"))


@register("predict_sentiment", _cells_sql(
    "SELECT review_id, sub_idx, sign::INTEGER AS sign, round(sconf, 6) AS sconf, round(delta, 6) AS delta FROM cells"))
def q_predict_sentiment(spark, d):
    a = analyze(spark, v_scored(spark, d))
    return a.cells.select("review_id", "sub_idx", F.col("sign").cast("int").alias("sign"), R6("sconf").alias("sconf"),
                          R6("delta").alias("delta"))


@register("sentiment_margins", _cells_sql(
    "SELECT review_id, sub_idx, (CASE WHEN delta > 0.5 THEN 1 WHEN delta < -0.3 THEN 0 ELSE -1 END)::INTEGER AS y_sent"
    " FROM cells"))
def q_sentiment_margins(spark, d):
    a = analyze(spark, v_scored(spark, d))
    return a.cells.select("review_id", "sub_idx",
                          predict.sentiment_with_margins(F.col("delta"), 0.5, 0.3).cast("int").alias("y_sent"))


def _evidence_sql(select: str, agreement: str = "aggregated") -> str:
    return O.with_(O.V_SCORED, O.gate_ctes(), O.cells_ctes("gok"), O.evidence_ctes(agreement)) + select


@register("weights_norm", _evidence_sql(
    "SELECT product_id, review_id, sub_idx, round(wn, 6) AS wn, round(w, 6) AS w FROM wcells"))
def q_weights_norm(spark, d):
    a = analyze(spark, v_scored(spark, d))
    pc = a.cells.where("pred_sub").join(a.medians, "product_id")
    return pc.select("product_id", "review_id", "sub_idx",
                     R6(ev.norm_weight(F.col("sconf"), F.col("usefulness"), F.col("med_c"), F.col("med_u"))).alias("wn"),
                     R6(ev.raw_weight(F.col("sconf"), F.col("usefulness"))).alias("w"))


@register("product_medians", _evidence_sql(
    "SELECT product_id, round(med_c, 6) AS med_c, round(med_u, 6) AS med_u FROM med_c JOIN med_u USING (product_id)"))
def q_product_medians(spark, d):
    a = analyze(spark, v_scored(spark, d))
    return a.medians.select("product_id", R6("med_c").alias("med_c"), R6("med_u").alias("med_u"))


_EV_COLS = ("SELECT product_id, sub_idx, n_cells, round(score, 6) AS score, sgn::INTEGER AS sign, "
            "round(agreement, 6) AS agreement, round(volume, 6) AS volume, round(confidence, 6) AS confidence FROM evidence")


def _ev_select(e):
    return e.select("product_id", "sub_idx", "n_cells", R6("score").alias("score"), F.col("sign").cast("int").alias("sign"),
                    R6("agreement").alias("agreement"), R6("volume").alias("volume"), R6("confidence").alias("confidence"))


@register("sub_confidence", _evidence_sql(_EV_COLS))
def q_sub_confidence(spark, d):
    return _ev_select(analyze(spark, v_scored(spark, d)).evidence)


@register("agreement_per_review", _evidence_sql(_EV_COLS, "per_review"))
def q_agreement_per_review(spark, d):
    return _ev_select(analyze(spark, v_scored(spark, d), agreement="per_review").evidence)


@register("weighted_sentiment", _evidence_sql("SELECT product_id, sub_idx, round(score, 6) AS score FROM evidence"))
def q_weighted_sentiment(spark, d):
    return analyze(spark, v_scored(spark, d)).evidence.select("product_id", "sub_idx", R6("score").alias("score"))


@register("robust_sign", _evidence_sql("SELECT product_id, sub_idx, sgn::INTEGER AS sign FROM evidence"))
def q_robust_sign(spark, d):
    return analyze(spark, v_scored(spark, d)).evidence.select("product_id", "sub_idx",
                                                             F.col("sign").cast("int").alias("sign"))


@register("evidence_volume", _evidence_sql(
    "SELECT product_id, sub_idx, round(vol_raw, 6) AS vol_raw, round(volume, 6) AS volume FROM evidence"))
def q_evidence_volume(spark, d):
    e = analyze(spark, v_scored(spark, d)).evidence
    return e.select("product_id", "sub_idx", R6("vol_raw").alias("vol_raw"), R6("volume").alias("volume"))


@register("comparison_mentions", _evidence_sql("SELECT product_id, sub_idx, n_comp::BIGINT AS n_comp FROM evidence"))
def q_comparison_mentions(spark, d):
    e = analyze(spark, v_scored(spark, d)).evidence
    return e.select("product_id", "sub_idx", F.col("n_comp").cast("bigint").alias("n_comp"))
