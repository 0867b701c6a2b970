"""Registered queries for specs and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from revidence import dims
from revidence.functions import text as T
from revidence.operators import report, specs
from revidence.plans import oracle_sql as O
from revidence.plans.analysis import analyze
from revidence.sources.bridges import table, v_scored, v_spec_docs

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


def flat(spark, d):
    return specs.flatten_specs(specs.parse_spec_docs(v_spec_docs(spark, d)))


SPEC = O.with_(O.FLAT_SPECS)


@register("flatten_specs", SPEC + "SELECT product_id, spec_key, spec_value FROM flat_specs")
def q_flatten_specs(spark, d):
    return flat(spark, d)


@register("drop_spec_keys", SPEC + f"SELECT product_id, spec_key, spec_value FROM flat_specs WHERE spec_key NOT IN {O.drop_keys_sql()}")
def q_drop_spec_keys(spark, d):
    return specs.drop_spec_keys(flat(spark, d))


@register("product_specs", O.with_(O.FLAT_SPECS, O.V_CATALOG) + f"""SELECT f.product_id, c.name, count(*) AS n_specs
FROM flat_specs f JOIN v_catalog c ON c.corpus_idx::VARCHAR = f.product_id
WHERE f.spec_key NOT IN {O.drop_keys_sql()} GROUP BY f.product_id, c.name""")
def q_product_specs(spark, d):
    docs = specs.parse_spec_docs(v_spec_docs(spark, d))
    ps = specs.product_specs(specs.flatten_specs(docs), dims.DROP_SPEC_KEYS)
    return (ps.groupBy("product_id").agg(F.count("*").alias("n_specs"))
            .join(docs.select("product_id", "name"), "product_id"))


#: All keys that the spec documents have.
WIDE_KEYS = ["Battery_Charging", "Battery_Type", "Body_SIM", "Body_Weight", "Launch", "Main_Camera_Single", "Our_Tests_Battery_Life", "Platform_OS"]


@register("specs_wide", SPEC + "SELECT product_id, " + ", ".join(
    f"max(CASE WHEN spec_key = '{k}' THEN spec_value END) AS \"{k}\"" for k in WIDE_KEYS)
    + " FROM flat_specs GROUP BY product_id")
def q_specs_wide(spark, d):
    return specs.specs_wide(flat(spark, d), keys=WIDE_KEYS)


@register("spec_fusion", O.with_(O.FLAT_SPECS, f"ds AS {O.dim_spec_sql()}") + """SELECT f.product_id, ds.top_idx::INTEGER AS top_idx,
  ds.ord::INTEGER AS ord, f.spec_key, f.spec_value FROM flat_specs f JOIN ds USING (spec_key)""")
def q_spec_fusion(spark, d):
    return specs.spec_fusion(flat(spark, d))


def _analysis(spark, d):
    return analyze(spark, v_scored(spark, d))


def _flat_bigint(spark, d, products=None):
    """Flat specs keyed like the scored products; with ``products`` given, only their documents
    are flattened (semi join before the explode levels)."""
    docs = specs.parse_spec_docs(v_spec_docs(spark, d)).withColumn("product_id", F.col("product_id").cast("bigint"))
    if products is not None:
        docs = docs.join(products.select("product_id").distinct(), "product_id", "left_semi")
    return specs.drop_spec_keys(specs.flatten_specs(docs))


def review_texts(spark, d):
    """(product_id, review_id, raw_text) of the scored reviews: texts of ``documents`` (as many ids as there are), which the report cleans."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), F.col("text").alias("raw_text"))
    return v_scored(spark, d).select("product_id", "review_id").join(docs, "review_id").select("product_id", "review_id", "raw_text")


TEXT_SQL = f"(SELECT doc_id AS review_id, {O.clean_text('text')} AS text FROM documents) txt"

TOPREV_SQL = O.core_prefix() + f"""SELECT product_id, rank::INTEGER AS rank, review_id, txt.text, round(usefulness, 6) AS usefulness FROM (
  SELECT product_id, review_id, usefulness,
         row_number() OVER (PARTITION BY product_id ORDER BY usefulness DESC, review_id DESC) AS rank FROM gok) x
LEFT JOIN {TEXT_SQL} USING (review_id) WHERE rank <= 5"""


@register("top_reviews", TOPREV_SQL)
def q_top_reviews(spark, d):
    t = report.with_texts(report.top_reviews(_analysis(spark, d).gated_ok), review_texts(spark, d))
    return t.select("product_id", F.col("rank").cast("int").alias("rank"), "review_id", "text", R6("usefulness").alias("usefulness"))


SUPPORT_CTE = """rows0 AS (SELECT e.product_id, e.sub_idx FROM evidence e JOIN pp USING (sub_idx) WHERE e.confidence <> 0),
support AS (
  SELECT * FROM (
    SELECT c.product_id, c.sub_idx, c.review_id, c.usefulness,
           row_number() OVER (PARTITION BY c.product_id, c.sub_idx ORDER BY c.usefulness DESC, c.review_id DESC) AS rank
    FROM cells c WHERE c.pred_sub AND c.usefulness > 8.0) x
  WHERE rank <= 3 AND (product_id, sub_idx) IN (SELECT product_id, sub_idx FROM rows0)
)"""


@register("supporting_reviews", O.core_prefix().rstrip() + ",\n" + SUPPORT_CTE + f"""
SELECT product_id, sub_idx, rank::INTEGER AS rank, review_id, txt.text, round(usefulness, 6) AS usefulness FROM support LEFT JOIN {TEXT_SQL} USING (review_id)""")
def q_supporting_reviews(spark, d):
    a = _analysis(spark, d)
    _, s, _ = report.report_parts(spark, a, None, review_texts(spark, d))
    return s.select("product_id", "sub_idx", F.col("rank").cast("int").alias("rank"), "review_id", "text",
                    R6("usefulness").alias("usefulness"))


@register("primary_parent", O.core_prefix() + """SELECT e.product_id, e.sub_idx, pp.top_idx::INTEGER AS top_idx
FROM evidence e JOIN pp USING (sub_idx)""")
def q_primary_parent(spark, d):
    a = _analysis(spark, d)
    pp = report.primary_parent(spark)
    return a.evidence.join(F.broadcast(pp), "sub_idx").select("product_id", "sub_idx",
                                                              F.col("top_idx").cast("int").alias("top_idx"))


@register("evidence_listing", O.core_prefix() + """SELECT product_id, sub_idx, review_id, round(usefulness, 6) AS usefulness
FROM cells WHERE pred_sub AND usefulness > 8.75""")
def q_evidence_listing(spark, d):
    e = report.evidence_listing(_analysis(spark, d).cells)
    return e.select("product_id", "sub_idx", "review_id", R6("usefulness").alias("usefulness"))


def _report_sql() -> str:
    pre = O.with_(O.V_SCORED, O.gate_ctes(), O.cells_ctes("gok"), O.evidence_ctes(),
                  f"pp AS (SELECT sub_idx, min(top_idx) AS top_idx FROM {O.taxonomy_sql()} GROUP BY sub_idx)",
                  f"dtop AS {O.dim_top_sql()}", f"dsub AS {O.dim_sub_sql()}", O.FLAT_SPECS,
                  f"ds AS {O.dim_spec_sql()}", SUPPORT_CTE)
    return pre + f"""
, status AS (
  SELECT p.product_id, CASE WHEN coalesce(c.n_gated, 0) > {dims.MIN_EVIDENCE} THEN 'ok' ELSE 'insufficient_review_evidence' END AS status
  FROM (SELECT DISTINCT product_id FROM v_scored) p LEFT JOIN cnt c USING (product_id)
),
said AS (SELECT review_id, concat_ws('=', review_id::VARCHAR, md5(txt.text)) AS seen FROM v_scored LEFT JOIN {TEXT_SQL} USING (review_id)),
sr AS (SELECT product_id, sub_idx, string_agg(seen, ',' ORDER BY rank) AS sr FROM support JOIN said USING (review_id) GROUP BY 1, 2),
tr AS (SELECT product_id, string_agg(seen, ',' ORDER BY rank) AS tr FROM (SELECT product_id, review_id,
  row_number() OVER (PARTITION BY product_id ORDER BY usefulness DESC, review_id DESC) AS rank FROM gok) g JOIN said USING (review_id) WHERE rank <= 5 GROUP BY 1),
subrows AS (
  SELECT e.product_id, pp.top_idx, e.sub_idx,
         dsub.sub_name || ':' || CASE WHEN e.sgn > 0 THEN 'positive' ELSE 'negative' END || ':' ||
         round_even(e.confidence, 0)::BIGINT::VARCHAR || ':' || coalesce(sr.sr, '') AS t
  FROM evidence e JOIN pp USING (sub_idx) JOIN dsub ON dsub.sub_idx = e.sub_idx
  LEFT JOIN sr ON sr.product_id = e.product_id AND sr.sub_idx = e.sub_idx
  WHERE e.confidence <> 0
),
subs AS (SELECT product_id, top_idx, string_agg(t, '|' ORDER BY sub_idx) AS sub_aspects FROM subrows GROUP BY 1, 2),
sp AS (
  SELECT f.product_id::BIGINT AS product_id, ds.top_idx, string_agg(f.spec_key || '=' || f.spec_value, ';' ORDER BY ds.ord) AS specifications
  FROM flat_specs f JOIN ds USING (spec_key) WHERE f.spec_key NOT IN {O.drop_keys_sql()} GROUP BY 1, 2
),
ntop AS (SELECT product_id, least(count(*), 5) AS n FROM gok GROUP BY 1)
SELECT s.product_id, 'ok' AS status, t.top_idx::INTEGER AS top_idx, t.top_name AS top_aspect_name,
       coalesce(subs.sub_aspects, '') AS sub_aspects, coalesce(sp.specifications, '') AS specifications,
       coalesce(ntop.n, 0)::BIGINT AS n_top_reviews, coalesce(tr.tr, '') AS top_reviews
FROM status s CROSS JOIN dtop t
LEFT JOIN subs ON subs.product_id = s.product_id AND subs.top_idx = t.top_idx
LEFT JOIN sp ON sp.product_id = s.product_id AND sp.top_idx = t.top_idx
LEFT JOIN ntop ON ntop.product_id = s.product_id LEFT JOIN tr ON tr.product_id = s.product_id
WHERE s.status = 'ok'
UNION ALL
SELECT product_id, status, NULL::INTEGER, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR FROM status WHERE status <> 'ok'
"""


@register("product_report", _report_sql())
def q_product_report(spark, d):
    a = _analysis(spark, d)
    return report.report_long(spark, a, _flat_bigint(spark, d, a.status.where("status = 'ok'")), texts=review_texts(spark, d))


@register("report_json")
def q_report_json(spark, d):
    """Nested report (one row per product) written by the JSON sink (A12) under the shared
    checkpoint dir and read back with its schema."""
    from revidence.sources.ingest import scratch_path, write_report
    a = _analysis(spark, d)
    rep = report.build_report(spark, a, _flat_bigint(spark, d, a.status.where("status = 'ok'")), texts=review_texts(spark, d))
    path = scratch_path(spark, "report-json")
    write_report(rep, path, "json")
    return spark.read.schema(rep.schema).json(path)


#: All products of the scored reviews (99 has too little evidence and stays empty).
CMP = [*range(7), 99]


@register("compare_products", O.core_prefix() + """SELECT e.sub_idx::INTEGER AS sub_idx, dsub.sub_name AS sub_aspect_name, """
          + ", ".join(f"max(CASE WHEN e.product_id = {p} THEN (CASE WHEN e.sgn > 0 THEN 1 ELSE -1 END) * round_even(e.confidence, 0) END)::BIGINT AS p{p}_signed_conf" for p in CMP)
          + f""" FROM evidence e JOIN pp USING (sub_idx) JOIN dsub ON dsub.sub_idx = e.sub_idx
WHERE e.confidence <> 0 AND e.product_id IN ({', '.join(map(str, CMP))}) GROUP BY 1, 2""")
def q_compare_products(spark, d):
    return report.compare_products(_analysis(spark, d).sub_rows, CMP)
