"""Registered queries for text cleaning, keys and product relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from revidence.functions import text as T
from revidence.functions.columns import computed
from revidence.operators import relevance as rel
from revidence.plans import oracle_sql as O
from revidence.sources.bridges import v_catalog, v_products, v_reviews

QUERIES: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


CLEAN = O.clean_text("raw_text")
REV = O.with_(O.V_REVIEWS, f"cl AS (SELECT *, {CLEAN} AS text FROM v_reviews)")


def cleaned(spark, d, strict=False):
    return computed(v_reviews(spark, d), text=T.clean_text(F.col("raw_text"), strict))


@register("clean_text", REV + "SELECT review_id, text FROM cl")
def q_clean_text(spark, d):
    return cleaned(spark, d).select("review_id", "text")


@register("clean_text_strict", O.with_(O.V_REVIEWS) + f"SELECT review_id, {O.clean_text('raw_text', True)} AS text FROM v_reviews")
def q_clean_text_strict(spark, d):
    return cleaned(spark, d, strict=True).select("review_id", "text")


@register("min_words", REV + f"SELECT review_id, {O.word_count('text')}::BIGINT AS n_words, "
          f"{O.word_count('text')} > 15 AS keep FROM cl")
def q_min_words(spark, d):
    c = cleaned(spark, d)
    n = T.word_count(F.col("text"))
    return c.select("review_id", n.cast("bigint").alias("n_words"), (n > 15).alias("keep"))


ASSEMBLE_SQL = REV + f"""SELECT product_id, review_id, origin, (CASE WHEN origin = 'comment' THEN 0 ELSE 1 END)::INTEGER AS origin_ord,
       pos, text, likes FROM cl WHERE {O.word_count('text')} > 15"""


def assemble(spark, d):
    c = cleaned(spark, d)
    return c.where(T.word_count(F.col("text")) > 15).select(
        "product_id", "review_id", "origin",
        F.when(F.col("origin") == "comment", 0).otherwise(1).cast("int").alias("origin_ord"),
        "pos", "text", "likes")


@register("assemble_reviews", ASSEMBLE_SQL)
def q_assemble_reviews(spark, d):
    return assemble(spark, d)


@register("valid_reviews", REV + f"SELECT review_id, product_id FROM cl WHERE {O.ws_trim('text')} <> ''")
def q_valid_reviews(spark, d):
    c = cleaned(spark, d)
    return c.where(T.ws_trim(F.col("text")) != "").select("review_id", "product_id")


@register("normalize_key", O.with_(O.V_REVIEWS) + f"SELECT review_id, {O.normalize_key('raw_text')} AS norm_key FROM v_reviews")
def q_normalize_key(spark, d):
    return v_reviews(spark, d).select("review_id", T.normalize_key(F.col("raw_text")).alias("norm_key"))


CAT = O.with_(O.V_CATALOG)


@register("compact_key", CAT + "SELECT corpus_idx, replace(replace(lower(name), ' ', ''), '_', '') AS compact_key FROM v_catalog")
def q_compact_key(spark, d):
    return v_catalog(spark, d).select("corpus_idx", T.compact_key(F.col("name")).alias("compact_key"))


@register("product_oid", CAT + "SELECT corpus_idx, left(md5(lower(name)), 24) AS product_oid FROM v_catalog")
def q_product_oid(spark, d):
    return v_catalog(spark, d).select("corpus_idx", T.product_oid(F.col("name")).alias("product_oid"))


@register("slug_id", CAT + f"SELECT corpus_idx, replace({O.normalize_key('name')}, ' ', '_') AS slug_id FROM v_catalog")
def q_slug_id(spark, d):
    return v_catalog(spark, d).select("corpus_idx", T.slug_id(F.col("name")).alias("slug_id"))


@register("search_query", CAT + """SELECT corpus_idx, '"' || name || '" review OR experience OR thoughts' AS query,
       url_encode(name || ' review OR experience OR thoughts') AS query_encoded FROM v_catalog""")
def q_search_query(spark, d):
    c = v_catalog(spark, d)
    return c.select("corpus_idx", T.search_query(F.col("name")).alias("query"),
                    T.url_quote(F.concat(F.col("name"), F.lit(" review OR experience OR thoughts"))).alias("query_encoded"))


PROD = O.with_(O.V_REVIEWS, f"cl AS (SELECT *, {CLEAN} AS text FROM v_reviews)", f"vp AS {O.v_products_sql()}")


@register("prompt_text", PROD + "SELECT cl.review_id, 'Main product: ' || vp.name || '. Review: ' || cl.text AS prompt "
          "FROM cl JOIN vp USING (product_id)")
def q_prompt_text(spark, d):
    c = cleaned(spark, d).join(v_products(spark), "product_id")
    return c.select("review_id", T.prompt_text(F.col("name"), F.col("text")).alias("prompt"))


@register("token_weight", CAT + f"""SELECT corpus_idx, (i - 1)::INTEGER AS pos, toks[i] AS token, {O.token_weight('toks[i]')} AS weight
FROM (SELECT corpus_idx, string_split({O.normalize_key('name')}, ' ') AS toks FROM v_catalog) x,
     (SELECT unnest(range(1, 40)) AS i) r WHERE i <= len(toks) AND toks[i] <> ''""")
def q_token_weight(spark, d):
    c = v_catalog(spark, d).select("corpus_idx", T.tokens(T.normalize_key(F.col("name"))).alias("toks"))
    e = c.select("corpus_idx", F.posexplode("toks").alias("pos", "token"))
    return e.select("corpus_idx", F.col("pos").cast("int").alias("pos"), "token",
                    T.token_weight(F.col("token")).alias("weight"))


MS = O.match_score_norm(O.normalize_key("cl.text"), O.normalize_key("vp.name"))


@register("match_score", PROD + f"SELECT cl.review_id, cl.product_id, {MS} AS score FROM cl JOIN vp USING (product_id)")
def q_match_score(spark, d):
    c = cleaned(spark, d).join(v_products(spark), "product_id")
    return c.select("review_id", "product_id", T.match_score(F.col("text"), F.col("name")).alias("score"))


@register("relevance_known", PROD + f"""SELECT product_id, score AS relevance, count(*) AS n FROM
  (SELECT cl.product_id, {MS} AS score FROM cl JOIN vp USING (product_id)) x GROUP BY product_id, score""")
def q_relevance_known(spark, d):
    r = rel.relevance_known(cleaned(spark, d), v_products(spark))
    return r.groupBy("product_id", "relevance").agg(F.count("*").alias("n"))


CTX_SQL = O.with_(O.V_REVIEWS, f"cl AS (SELECT *, {CLEAN} AS text FROM v_reviews)", f"vp AS {O.v_products_sql()}",
                  "ctx AS (SELECT doc_id - 1 AS review_id, text AS context FROM documents)")


@register("relevance_ctx", CTX_SQL + f"""SELECT cl.review_id, cl.product_id,
  CASE WHEN coalesce(ctx.context, '') <> ''
       THEN greatest({MS}, {O.match_score_norm(O.normalize_key('ctx.context'), O.normalize_key('vp.name'))})
       ELSE {MS} END AS relevance
FROM cl JOIN vp USING (product_id) LEFT JOIN ctx ON ctx.review_id = cl.review_id""")
def q_relevance_ctx(spark, d):
    from revidence.sources.bridges import table
    docs = table(spark, d, "documents")
    ctx = docs.select((F.col("doc_id") - 1).alias("review_id"), F.col("text").alias("context"))   # the whole next document
    c = cleaned(spark, d).join(v_products(spark), "product_id").join(ctx, "review_id", "left")
    context = F.coalesce("context", F.lit(""))
    return c.select("review_id", "product_id", T.relevance(F.col("text"), F.col("name"), context).alias("relevance"))


def _attr_prefix():
    return O.with_(O.V_REVIEWS, f"cl AS (SELECT *, {CLEAN} AS text FROM v_reviews)", f"vp AS {O.v_products_sql()}",
                   f"""pairs AS (
  SELECT cl.review_id, vp.product_id, {O.match_score_norm(O.normalize_key('cl.text'), O.normalize_key('vp.name'))} AS score
  FROM cl CROSS JOIN vp)""")


@register("attribution_pairs", _attr_prefix() + "SELECT review_id, product_id, score FROM pairs WHERE score > 0.7")
def q_attribution_pairs(spark, d):
    return rel.attribution_pairs(v_reviews(spark, d), v_products(spark), "raw_text", raw=True)


@register("attribute_products", _attr_prefix() + """SELECT review_id, product_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY score DESC, product_id) AS rk FROM pairs WHERE score > 0.7
) x WHERE rk = 1""")
def q_attribute_products(spark, d):
    return rel.attribute_products(v_reviews(spark, d), v_products(spark), "raw_text", raw=True)


@register("sql_functions", PROD + f"""SELECT cl.review_id, cl.text, {O.word_count('cl.text')}::INTEGER AS n_words,
  {O.normalize_key('cl.raw_text')} AS norm_key, {MS} AS score
FROM cl JOIN vp USING (product_id)""")
def q_sql_functions(spark, d):
    """The SQL surface (2.12): the same operators called as temporary SQL functions."""
    from revidence.functions.sql import register_sql_functions
    register_sql_functions(spark)
    v_reviews(spark, d).createOrReplaceTempView("rv_reviews")
    v_products(spark).createOrReplaceTempView("rv_products")
    return spark.sql("""
        SELECT r.review_id, clean_text(r.raw_text) AS text, word_count(clean_text(r.raw_text)) AS n_words,
               normalize_key(r.raw_text) AS norm_key, match_score(clean_text(r.raw_text), p.name) AS score
        FROM rv_reviews r JOIN rv_products p USING (product_id)""")
