"""Registered queries for scoring, training, the end-to-end pipeline and weight terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from revidence import dims
from revidence.functions import text as T
from revidence.operators import evidence as ev
from revidence.operators import scoring
from revidence.plans import oracle_sql as O
from revidence.plans.analysis import analyze
from revidence.plans.q_text import cleaned
from revidence.sources.bridges import table, v_products, v_scored

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


def assembled_with_prompt(spark, d):
    r = cleaned(spark, d)
    r = r.where((T.word_count(F.col("text")) > 15) & (T.ws_trim(F.col("text")) != ""))
    j = r.join(v_products(spark), "product_id")
    return j.select("review_id", "product_id", "text", "name", T.prompt_text(F.col("name"), F.col("text")).alias("prompt"),
                    T.match_score(F.col("text"), F.col("name")).alias("relevance"))


@register("score_usefulness")
def q_score_usefulness(spark, d):
    a = assembled_with_prompt(spark, d).select("review_id", "prompt")
    return scoring.score_usefulness(a, keep_text=False).select("review_id", "usefulness")


@register("score_aspects")
def q_score_aspects(spark, d):
    a = assembled_with_prompt(spark, d).where(F.col("relevance") > dims.RELEVANCE_THRESHOLD)
    u = scoring.score_usefulness(a.select("review_id", "prompt"))
    g = u.where(F.col("usefulness") > dims.USEFULNESS_GATE)
    s = scoring.score_aspects(g, keep_text=False)
    return s.select("review_id", "usefulness", "top", "sub", "comp", "sent")


@register("train_multilabel")
def q_train_multilabel(spark, d):
    from revidence.operators.evaluate import holdout_flag
    docs = table(spark, d, "documents").select("doc_id", "text")
    lab = table(spark, d, "labels")
    df = docs.join(lab, "doc_id").withColumn("is_valid", holdout_flag(F.col("doc_id")))
    _, metrics = scoring.train_multilabel(df, "text", ["quality", "toxic"])
    return metrics


def native_scored(spark, d):
    a = assembled_with_prompt(spark, d)
    return a.select("review_id", "product_id", "relevance", *scoring.native_scores(F.col("prompt")))


def _md5_vals_sql(prompt: str, tag: str, n: int) -> str:
    blocks = (n + 15) // 16
    hexes = " || ".join(f"md5({prompt} || '|{tag}{b}')" for b in range(blocks))
    return f"list_transform(range({n}), lambda i: ('0x' || substr({hexes}, i * 2 + 1, 2))::INTEGER::DOUBLE / 255.0 * 8.0 - 4.0)"


def _scored_sql(relevance: str) -> str:
    """v_scored over ok_r (review_id, product_id, text) and vp (product_id, name)."""
    return f"""v_scored AS (
  SELECT review_id, product_id, relevance,
         ('0x' || substr(md5(prompt), 1, 6))::BIGINT::DOUBLE / {O.dbl(16 ** 6)} * 10.0 AS usefulness,
         {_md5_vals_sql('prompt', 't', dims.N_TOP)} AS top, {_md5_vals_sql('prompt', 's', dims.N_SUB)} AS sub,
         {_md5_vals_sql('prompt', 'c', dims.N_SUB)} AS comp,
         list_transform(range(29), lambda i: {{'neg': ({_md5_vals_sql('prompt', 'n', dims.N_SUB)})[i + 1],
                                              'pos': ({_md5_vals_sql('prompt', 'p', dims.N_SUB)})[i + 1]}}) AS sent
  FROM (SELECT r.review_id, r.product_id, 'Main product: ' || vp.name || '. Review: ' || r.text AS prompt, {relevance} AS relevance
        FROM ok_r r JOIN vp USING (product_id)) j
)"""


def _end_to_end_sql() -> str:
    clean = O.clean_text("raw_text")
    ms = O.match_score_norm(O.normalize_key("r.text"), O.normalize_key("vp.name"))
    scored = _scored_sql(ms)
    return O.with_(O.V_REVIEWS, f"cl AS (SELECT *, {clean} AS text FROM v_reviews)",
                   f"ok_r AS (SELECT * FROM cl WHERE {O.word_count('text')} > 15 AND {O.ws_trim('text')} <> '')",
                   f"vp AS {O.v_products_sql()}", scored, O.gate_ctes(), O.cells_ctes("gok"), O.evidence_ctes(),
                   f"pp AS (SELECT sub_idx, min(top_idx) AS top_idx FROM {O.taxonomy_sql()} GROUP BY sub_idx)",
                   "nrev AS (SELECT product_id, count(*) AS n FROM ok_r GROUP BY 1)") + f"""
SELECT p.product_id,
       CASE WHEN nrev.n IS NULL THEN CASE WHEN p.product_id IN (SELECT product_id FROM v_reviews) THEN 'no_valid_reviews' ELSE 'no_reviews_found' END
            WHEN coalesce(cnt.n_gated, 0) > {dims.MIN_EVIDENCE} THEN 'ok' ELSE 'insufficient_review_evidence' END AS status,
       coalesce(cnt.n_gated, 0)::BIGINT AS n_gated, e.sub_idx::INTEGER AS sub_idx,
       CASE WHEN e.sub_idx IS NULL THEN NULL WHEN e.sgn > 0 THEN 'positive' ELSE 'negative' END AS sub_aspect_sentiment,
       round_even(e.confidence, 0)::BIGINT AS sub_aspect_confidence
FROM vp p LEFT JOIN nrev USING (product_id) LEFT JOIN cnt USING (product_id)
LEFT JOIN (SELECT ev.* FROM evidence ev JOIN pp USING (sub_idx) WHERE ev.confidence <> 0) e ON e.product_id = p.product_id
"""


@register("end_to_end_report", _end_to_end_sql())
def q_end_to_end_report(spark, d):
    """Raw review items -> clean -> length filter -> relevance -> usefulness -> gate -> aspects
    -> decode -> evidence -> report rows, for all products at once, with statuses."""
    from revidence.plans.analysis import end_to_end
    from revidence.sources.bridges import v_reviews
    a, status, _ = end_to_end(spark, v_reviews(spark, d), v_products(spark))
    rows = a.sub_rows.select("product_id", "sub_idx", "sub_aspect_sentiment", "sub_aspect_confidence")
    return status.join(rows, "product_id", "left").select("product_id", "status", "n_gated", "sub_idx",
                                                          "sub_aspect_sentiment", "sub_aspect_confidence")


def _by_name_sql() -> str:
    from revidence.plans.q_sources import CORPUS_SQL
    ms = O.match_score_norm(O.normalize_key("r.text"), O.normalize_key("vp.name"))
    ctes = [O.V_QUERIES, f"""ids AS (SELECT *, coalesce(nullif(key, ''), nullif(product_oid, ''), 'prod_' || corpus_idx::VARCHAR) AS id FROM named)""",
            f"al AS (SELECT alias, min(corpus_idx) AS corpus_idx FROM (SELECT corpus_idx, unnest({O.aliases_sql('name', 'key')}) AS alias FROM ids) x GROUP BY 1)",
            f"qn AS (SELECT qid, {O.normalize_key('query')} AS norm FROM v_queries)",
            f"cn AS (SELECT corpus_idx, {O.normalize_key('name')} AS nn, {O.normalize_key('id')} AS ni FROM ids)",
            """fz AS (SELECT qn.qid, min(cn.corpus_idx) AS corpus_idx FROM qn JOIN cn ON qn.norm <> ''
  AND ((cn.nn <> '' AND (strpos(cn.nn, qn.norm) > 0 OR strpos(qn.norm, cn.nn) > 0)) OR (cn.ni <> '' AND strpos(cn.ni, qn.norm) > 0)) GROUP BY 1)""",
            "ex AS (SELECT qn.qid, al.corpus_idx FROM qn JOIN al ON al.alias = qn.norm)",
            """hits AS (SELECT q.qid, coalesce(ex.corpus_idx, fz.corpus_idx) AS corpus_idx,
  CASE WHEN ex.qid IS NOT NULL THEN 'exact' WHEN fz.qid IS NOT NULL THEN 'fuzzy' END AS how FROM v_queries q LEFT JOIN ex USING (qid) LEFT JOIN fz USING (qid))""",
            "vp AS (SELECT corpus_idx AS product_id, name, bundle_ord FROM ids)",
            """raw_r AS (SELECT vp.product_id, vp.product_id * 4294967296 + c.c_pos AS review_id, coalesce(c.body, '') AS raw_text FROM v_comments c JOIN vp ON vp.bundle_ord = c.post_id
  UNION ALL SELECT vp.product_id, vp.product_id * 4294967296 + 2147483648, h.t0 FROM heads h JOIN vp ON vp.bundle_ord = h.conv_id WHERE h.t0 IS NOT NULL)""",
            f"ok_r AS (SELECT * FROM (SELECT *, {O.clean_text('raw_text')} AS text FROM raw_r) x WHERE {O.word_count('text')} > 15 AND {O.ws_trim('text')} <> '')",
            _scored_sql(ms), O.gate_ctes()]
    return CORPUS_SQL + "," + ",\n".join(ctes) + f"""
SELECT h.qid, h.corpus_idx, h.how, CASE WHEN h.corpus_idx IS NULL OR NOT h.corpus_idx IN (SELECT product_id FROM raw_r) THEN 'no_reviews_found'
    WHEN NOT h.corpus_idx IN (SELECT product_id FROM ok_r) THEN 'no_valid_reviews'
    WHEN coalesce(cnt.n_gated, 0) > {dims.MIN_EVIDENCE} THEN 'ok' ELSE 'insufficient_review_evidence' END AS status, coalesce(cnt.n_gated, 0)::BIGINT AS n_gated
FROM hits h LEFT JOIN cnt ON cnt.product_id = h.corpus_idx"""


@register("reports_by_name", _by_name_sql())
def q_reports_by_name(spark, d):
    """Every lookup probe against the corpus built from the bundles."""
    from revidence.operators import catalog as cat
    from revidence.plans.analysis import reports_by_name
    from revidence.plans.q_sources import full_corpus
    from revidence.session import cut_lineage
    from revidence.sources.bridges import v_queries
    c = cut_lineage(full_corpus(spark, d))
    return reports_by_name(spark, v_queries(spark, d), cat.alias_index(cat.alias_rows(c)), c)[0]


def _cells_weights(select: str) -> str:
    return O.with_(O.V_SCORED, O.gate_ctes(), O.cells_ctes("gok"), O.evidence_ctes()) + select


@register("gain_conf", _cells_weights("SELECT review_id, sub_idx, round(1 - exp(-sconf / 0.8), 6) AS g FROM cells WHERE pred_sub"))
def q_gain_conf(spark, d):
    a = analyze(spark, v_scored(spark, d))
    return a.cells.where("pred_sub").select("review_id", "sub_idx", R6(ev.g_conf(F.col("sconf"))).alias("g"))


@register("gain_useful", _cells_weights("SELECT review_id, round(ln(1 + 0.6 * usefulness), 6) AS h FROM gok"))
def q_gain_useful(spark, d):
    a = analyze(spark, v_scored(spark, d))
    return a.gated_ok.select("review_id", R6(ev.h_useful(F.col("usefulness"))).alias("h"))


@register("weights_raw", _cells_weights("SELECT review_id, sub_idx, round(w, 6) AS w FROM wcells"))
def q_weights_raw(spark, d):
    a = analyze(spark, v_scored(spark, d))
    return a.cells.where("pred_sub").select("review_id", "sub_idx", R6(ev.raw_weight(F.col("sconf"), F.col("usefulness"))).alias("w"))


@register("reliability", _cells_weights(f"SELECT product_id, sub_idx, round(0.65 + 0.35 * pow({O.dbl_list(dims.SUB_RELIABILITY)}[sub_idx + 1], 0.8), 6) AS reliability_term FROM evidence"))
def q_reliability(spark, d):
    e = analyze(spark, v_scored(spark, d)).evidence
    return e.select("product_id", "sub_idx", R6(ev.reliability_term(ev.reliability_col(F.col("sub_idx")))).alias("reliability_term"))
