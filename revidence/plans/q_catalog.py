"""Registered queries for the catalog, aliases and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from revidence.operators import catalog as cat
from revidence.operators import specs as sp
from revidence.plans import oracle_sql as O
from revidence.plans.q_sources import PAYLOAD_SQL, payload_columns
from revidence.sources.bridges import v_catalog, v_queries
from revidence.sources.ingest import bundle_payload

QUERIES: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


CATQ = O.with_(O.V_CATALOG, O.V_QUERIES, O.CAT_ALIAS)


def corpus(spark, d):
    return v_catalog(spark, d).select("corpus_idx", F.col("key").alias("id"), "name", "key")


@register("alias_generate", CATQ + "SELECT corpus_idx, alias FROM al")
def q_alias_generate(spark, d):
    return cat.alias_rows(v_catalog(spark, d))


@register("alias_unreachable", O.with_(O.V_CATALOG) + f"""SELECT corpus_idx, alias FROM
  (SELECT corpus_idx, unnest({O.aliases_sql('name', 'key', True)}) AS alias FROM v_catalog) x WHERE strpos(alias, '  ') > 0""")
def q_alias_unreachable(spark, d):
    a = cat.alias_rows(v_catalog(spark, d), compat=True)
    return a.where(F.instr("alias", "  ") > 0)


@register("alias_index", CATQ + "SELECT alias, corpus_idx FROM aidx")
def q_alias_index(spark, d):
    return cat.alias_index(cat.alias_rows(v_catalog(spark, d)))


def new_products(spark, d):
    """Products arriving from the review bundles (every conversation), in name order, each with the reviews of its first bundle."""
    from revidence.plans.q_sources import bundles
    b = bundles(spark, d)
    first = b.groupBy(F.col("product_name").alias("name")).agg(F.min("bundle_ord").alias("bundle_ord"))
    return first.join(bundle_payload(b, appended=True), "bundle_ord").select("name", F.col("name").alias("new_ord"), "reviews")


def appended(spark, d):
    return cat.corpus_append(corpus(spark, d), new_products(spark, d))


NEWP = f"""named_bundles AS (SELECT conv_id, CASE WHEN conv_id % 5 = 1 THEN 'Apple iPhone ' || (((conv_id % 30) * 8) % 17)::VARCHAR || ' Pro Max'
         ELSE 'Product ' || (conv_id % 13)::VARCHAR END AS name FROM conversations),
newp AS (SELECT (SELECT max(corpus_idx) FROM v_catalog) + row_number() OVER (ORDER BY name) AS corpus_idx, name,
  replace({O.normalize_key('name')}, ' ', '_') AS id FROM (SELECT DISTINCT name FROM named_bundles) x)"""


@register("alias_upsert", CATQ + ", " + NEWP + f""",
nk AS (SELECT DISTINCT corpus_idx, k AS alias FROM (
  SELECT corpus_idx, {O.normalize_key('name')} AS k FROM newp UNION ALL SELECT corpus_idx, id FROM newp) z WHERE k <> ''),
both_k AS (SELECT alias, corpus_idx, 0 AS prio FROM aidx UNION ALL SELECT alias, corpus_idx, 1 FROM nk)
SELECT alias, arg_max(corpus_idx, prio * 10000000 + corpus_idx) AS corpus_idx FROM both_k GROUP BY alias""")
def q_alias_upsert(spark, d):
    c = v_catalog(spark, d)
    idx = cat.alias_index(cat.alias_rows(c))
    new = appended(spark, d).where(F.col("corpus_idx") > c.agg(F.max("corpus_idx")).scalar()).select("corpus_idx", "name", "id")
    return cat.alias_upsert(idx, new)


@register("lookup_exact", CATQ + f"SELECT q.qid, a.corpus_idx FROM v_queries q JOIN aidx a ON a.alias = {O.normalize_key('q.query')}")
def q_lookup_exact(spark, d):
    idx = cat.alias_index(cat.alias_rows(v_catalog(spark, d)))
    return cat.lookup_exact(v_queries(spark, d), idx)


FUZZY = f"""qn AS (SELECT qid, {O.normalize_key('query')} AS norm FROM v_queries),
cn AS (SELECT corpus_idx, {O.normalize_key('name')} AS nn, {O.normalize_key('key')} AS ni FROM v_catalog),
fz AS (SELECT qn.qid, min(cn.corpus_idx) AS corpus_idx FROM qn JOIN cn
       ON qn.norm <> '' AND ((cn.nn <> '' AND (strpos(cn.nn, qn.norm) > 0 OR strpos(qn.norm, cn.nn) > 0))
                             OR (cn.ni <> '' AND strpos(cn.ni, qn.norm) > 0))
       GROUP BY qn.qid)"""


@register("lookup_fuzzy", CATQ + "," + FUZZY + " SELECT qid, corpus_idx FROM fz")
def q_lookup_fuzzy(spark, d):
    return cat.lookup_fuzzy(v_queries(spark, d), corpus(spark, d))


@register("lookup_product", CATQ + "," + FUZZY + "," + NEWP + f""", nk AS (SELECT k AS alias, max(corpus_idx) AS corpus_idx FROM (
  SELECT corpus_idx, {O.normalize_key('name')} AS k FROM newp UNION ALL SELECT corpus_idx, id FROM newp) z WHERE k <> '' GROUP BY 1),
ahead AS (SELECT coalesce(nk.alias, a.alias) AS alias, coalesce(nk.corpus_idx, a.corpus_idx) AS corpus_idx FROM aidx a FULL JOIN nk ON nk.alias = a.alias),
ex AS (SELECT q.qid, a.corpus_idx FROM qn q JOIN ahead a ON a.alias = q.norm WHERE a.corpus_idx IN (SELECT corpus_idx FROM v_catalog))
SELECT q.qid, coalesce(ex.corpus_idx, fz.corpus_idx) AS corpus_idx,
       CASE WHEN ex.qid IS NOT NULL THEN 'exact' WHEN fz.qid IS NOT NULL THEN 'fuzzy' END AS how
FROM v_queries q LEFT JOIN ex USING (qid) LEFT JOIN fz USING (qid)""")
def q_lookup_product(spark, d):
    """The index is one batch of new products ahead of the corpus: their names point to positions that the corpus doesn't have yet."""
    c = v_catalog(spark, d)
    new = appended(spark, d).where(F.col("corpus_idx") > c.agg(F.max("corpus_idx")).scalar()).select("corpus_idx", "name", "id")
    idx = cat.alias_upsert(cat.alias_index(cat.alias_rows(c)), new)
    return cat.lookup_product(v_queries(spark, d), idx, corpus(spark, d))


@register("corpus_append", O.with_(O.CONV, PAYLOAD_SQL, O.V_CATALOG, NEWP) + """, firsts AS (SELECT name, min(conv_id) AS bundle_ord FROM named_bundles GROUP BY 1)
SELECT corpus_idx, key AS id, name, key, 0 AS n_comments, NULL AS comments, NULL AS review_texts FROM v_catalog
UNION ALL SELECT n.corpus_idx, n.id, n.name, '' AS key, p.n_comments, md5(p.untitled), md5(p.review_texts) FROM newp n JOIN firsts f USING (name) JOIN pay p USING (bundle_ord)""")
def q_corpus_append(spark, d):
    return appended(spark, d).select("corpus_idx", "id", "name", "key", *payload_columns(F.col("reviews")))


@register("alias_coverage", CATQ + """SELECT c.corpus_idx, coalesce(n.n, 0)::BIGINT AS n_aliases FROM v_catalog c
LEFT JOIN (SELECT corpus_idx, count(*) AS n FROM aidx GROUP BY 1) n USING (corpus_idx)""")
def q_alias_coverage(spark, d):
    c = v_catalog(spark, d)
    return cat.alias_coverage(c, cat.alias_index(cat.alias_rows(c)))


@register("spec_lookup", O.with_(O.V_CATALOG, O.V_QUERIES) + """, qc AS (SELECT qid, replace(replace(lower(query), ' ', ''), '_', '') AS cq FROM v_queries),
dc AS (SELECT corpus_idx, replace(replace(lower(name), ' ', ''), '_', '') AS cn, replace(replace(lower(key), ' ', ''), '_', '') AS ck FROM v_catalog)
SELECT qc.qid, (SELECT min(corpus_idx) FROM dc WHERE qc.cq <> '' AND (strpos(dc.cn, qc.cq) > 0 OR (dc.cn <> '' AND strpos(qc.cq, dc.cn) > 0) OR strpos(dc.ck, qc.cq) > 0)) AS doc_id
FROM qc""")
def q_spec_lookup(spark, d):
    return sp.spec_lookup(v_queries(spark, d), v_catalog(spark, d))
