"""Registered queries for sources and sinks (A1-A10, B3 over bundles, I4, I5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from revidence import dims
from revidence.operators import catalog as cat
from revidence.operators import specs as sp
from revidence.plans import oracle_sql as O
from revidence.session import cut_lineage
from revidence.sources import ingest as ing
from revidence.sources.bridges import land_bundles, land_pages, table, v_bundles, v_catalog, v_posts, v_spec_docs, v_spec_html

QUERIES: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def bundles(spark, d):
    b = v_bundles(spark, d)
    return ing.parse_bundles(b.select("bundle_ord", F.parse_json("json").alias("v")), "v")


ITEM_SQL = """items AS (SELECT conv_id AS bundle_ord,
  CASE WHEN conv_id % 2 = 0 THEN (conv_id % 40)::VARCHAR ELSE 'k_' || (conv_id % 50)::VARCHAR END AS product_oid,
  conv_id % 2 <> 0 AS product_is_str,
  CASE WHEN conv_id % 5 = 1 THEN 'Apple iPhone ' || (((conv_id % 30) * 8) % 17)::VARCHAR || ' Pro Max'
       ELSE 'Product ' || (conv_id % 13)::VARCHAR END AS product_name FROM heads)"""
SRC = O.with_(O.CONV, ITEM_SQL)


@register("load_bundles", SRC + """SELECT (row_number() OVER (ORDER BY i.bundle_ord) - 1)::BIGINT AS bundle_ord, i.product_oid, i.product_is_str, i.product_name,
  coalesce(c.n, 0)::INTEGER AS n_comments, 1 AS n_review_texts
FROM items i LEFT JOIN (SELECT post_id, count(*) AS n FROM v_comments GROUP BY 1) c ON c.post_id = i.bundle_ord""")
def q_load_bundles(spark, d):
    """Bundles written as JSON arrays under the shared checkpoint dir and read from the files."""
    path = ing.scratch_path(spark, "bundles")
    land_bundles(spark, d, path)
    b = ing.load_bundles(spark, path)
    return b.select("bundle_ord", "product_oid", "product_is_str", "product_name",
                    F.size("comments").alias("n_comments"), F.size("review_texts").alias("n_review_texts"))


def _listed(spark, d):
    """(posts, comments) from landed search and comment pages."""
    path = ing.scratch_path(spark, "pages")
    land_pages(spark, d, path)
    search = spark.read.text(f"{path}/search").select(F.col("value").alias("json"), F.col("product_id").cast("bigint").alias("product_id"))
    posts = ing.post_listings(search).withColumn("post_id", F.col("post_id").cast("bigint"))
    return posts, ing.comment_listings(spark.read.schema("permalink STRING, json STRING").json(f"{path}/comments"))


@register("post_texts", O.with_(O.CONV) + f"""SELECT product_id, post_id, (row_number() OVER (PARTITION BY product_id, post_id // 25 ORDER BY post_id) - 1)::INTEGER AS pos,
  CASE WHEN length({O.ws_trim('selftext')}) > 30 THEN title || '. ' || selftext ELSE title END AS review_text
FROM v_posts WHERE length({O.ws_trim('selftext')}) > 30 OR title <> ''""")
def q_post_texts(spark, d):
    return ing.post_texts(_listed(spark, d)[0])


def _comments_sql(k: int, min_len: int, kept_first: bool) -> str:
    """Twin over landed pages: posts with a link (post_id % 7 <> 2) and a positive count (% 11 <> 3); positions count from 0."""
    keep = f"length({O.ws_trim('body')}) > {min_len}"
    src = """(SELECT *, (row_number() OVER (PARTITION BY post_id ORDER BY c_pos) - 1)::INTEGER AS nth FROM v_comments
      WHERE post_id % 7 <> 2 AND post_id % 11 <> 3) s"""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY nth) AS rk FROM {src}" + (f" WHERE {keep}" if kept_first else "")
    return (O.with_(O.CONV) + f"SELECT product_id, post_id, nth AS c_pos, title || '. ' || body AS body, coalesce(ups, 0)::BIGINT AS ups "
            f"FROM ({ranked}) x WHERE rk <= {k} AND {keep}")


@register("post_comments", _comments_sql(dims.MAX_COMMENTS_PER_POST, 20, False))
def q_post_comments(spark, d):
    return ing.post_comments(ing.listed_comments(*_listed(spark, d)), k=dims.MAX_COMMENTS_PER_POST, min_len=20)


@register("post_comments_kept", _comments_sql(dims.MAX_COMMENTS_PER_POST, 30, True))
def q_post_comments_kept(spark, d):
    return ing.post_comments(ing.listed_comments(*_listed(spark, d)), k=dims.MAX_COMMENTS_PER_POST, min_len=30, count_kept_only=True)


@register("post_cap", O.with_(O.CONV) + """SELECT post_id, product_id, pos, title, selftext FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY pos) AS rk FROM v_posts) x WHERE rk <= 50""")
def q_post_cap(spark, d):
    return ing.post_cap(v_posts(spark, d), dims.MAX_POSTS).select("post_id", "product_id", "pos", "title", "selftext")


@register("comment_projection", O.with_(O.CONV) + """SELECT post_id AS bundle_ord,
  (row_number() OVER (PARTITION BY post_id ORDER BY c_pos) - 1)::INTEGER AS pos, coalesce(body, '') AS body,
  (CASE WHEN c_pos % 3 = 0 THEN c_pos ELSE coalesce(ups, 0) END)::BIGINT AS ups,
  CASE WHEN c_pos % 2 = 0 AND title <> '' THEN title END AS post_title FROM v_comments""")
def q_comment_projection(spark, d):
    c = ing.bundle_comments(bundles(spark, d), key="bundle_ord")
    return c.select("bundle_ord", "pos", "body", "ups", "post_title")


@register("bundle_union", O.with_(O.CONV) + """SELECT (row_number() OVER (ORDER BY conv_id % 2, conv_id) - 1)::BIGINT AS corpus_idx,
  (conv_id % 2)::INTEGER AS source_ord, conv_id AS bundle_ord FROM heads""")
def q_bundle_union(spark, d):
    b = bundles(spark, d)
    u = ing.bundle_union(b.where(F.col("bundle_ord") % 2 == 0), b.where(F.col("bundle_ord") % 2 == 1))
    return ing.dense_index(u, ["source_ord", "bundle_ord"]).select("corpus_idx", "source_ord", "bundle_ord")


@register("bundle_reviews", O.with_(O.CONV) + f""", br AS (
  SELECT post_id AS bundle_ord, 0 AS origin_ord, (row_number() OVER (PARTITION BY post_id ORDER BY c_pos) - 1)::INTEGER AS pos,
         {O.clean_text('body')} AS text, coalesce(ups, 0)::BIGINT AS likes, c_pos FROM v_comments
), kept AS (SELECT bundle_ord, origin_ord, pos, text, likes FROM br WHERE c_pos % 3 <> 0
  UNION ALL SELECT conv_id, 1, 0, {O.clean_text('t0')}, NULL::BIGINT FROM heads)
SELECT * FROM kept WHERE {O.word_count('text')} > 15""")
def q_bundle_reviews(spark, d):
    r = ing.assemble_bundle_reviews(bundles(spark, d), key="bundle_ord")
    return r.select("bundle_ord", "origin_ord", F.col("pos").cast("int").alias("pos"), "text", "likes")


def _specs_df(spark, d):
    docs = sp.parse_spec_docs(v_spec_docs(spark, d))
    return docs.select(F.col("product_id").alias("oid"), "key", "name", F.col("product_id").cast("bigint").alias("spec_ord"),
                       F.col("product_id").cast("bigint").alias("spec_doc_id"))


def _items(spark, d):
    b = bundles(spark, d)
    return b.select("bundle_ord", F.col("product_oid").alias("oid"), "product_is_str", "product_name")


RESOLVE = O.with_(O.CONV, ITEM_SQL, O.V_CATALOG) + f""", bo AS (SELECT corpus_idx::VARCHAR AS oid, max(corpus_idx) AS doc FROM v_catalog GROUP BY 1),
bn AS (SELECT {O.normalize_key('name')} AS k, max(corpus_idx) AS doc FROM v_catalog WHERE {O.normalize_key('name')} <> '' GROUP BY 1),
bk AS (SELECT key, max(corpus_idx) AS doc FROM v_catalog GROUP BY 1),
res AS (SELECT i.*, coalesce(bo.doc, bn.doc, bk.doc) AS spec_doc_id FROM items i
  LEFT JOIN bo ON bo.oid = i.product_oid LEFT JOIN bn ON bn.k = {O.normalize_key("coalesce(i.product_name, '')")}
  LEFT JOIN bk ON i.product_is_str AND bk.key = i.product_oid)
"""


@register("resolve_specs", RESOLVE + "SELECT bundle_ord, spec_doc_id FROM res")
def q_resolve_specs(spark, d):
    return cat.resolve_specs(_items(spark, d), _specs_df(spark, d)).select("bundle_ord", "spec_doc_id")


def corpus_df(spark, d):
    specs = cut_lineage(_specs_df(spark, d))   # read four times: documents are parsed once
    res = cat.resolve_specs(_items(spark, d), specs)
    res = ing.dense_index(res, ["bundle_ord"])
    return cat.corpus_entries(res, specs)


CORPUS_SQL = RESOLVE + f""", ce AS (SELECT (row_number() OVER (ORDER BY r.bundle_ord) - 1)::BIGINT AS corpus_idx, r.*, c.name AS spec_name, c.key AS spec_key
  FROM res r LEFT JOIN v_catalog c ON c.corpus_idx = r.spec_doc_id),
named AS (SELECT corpus_idx,
  CASE WHEN spec_doc_id IS NOT NULL THEN coalesce(nullif(spec_name, ''), nullif(product_name, ''), 'Product_' || product_oid)
       WHEN coalesce(product_name, '') <> '' THEN product_name
       WHEN coalesce(product_oid, '') <> '' THEN 'Product_' || product_oid ELSE 'Product_' || corpus_idx::VARCHAR END AS name, bundle_ord,
  CASE WHEN spec_doc_id IS NOT NULL THEN coalesce(spec_key, '')
       WHEN coalesce(product_name, '') <> '' THEN replace({O.normalize_key('product_name')}, ' ', '_')
       ELSE coalesce(product_oid, '') END AS key, product_oid, spec_doc_id FROM ce)
"""


def payload_columns(reviews):
    """Checkable form of the reviews of an entry: counts and digests in order."""
    one = lambda c: F.concat_ws("|", c["body"], c["ups"].cast("string"), F.coalesce(c["post_title"], F.lit("-")))
    return [F.coalesce(F.size(F.filter(reviews["comments"], lambda c: c.isNotNull())), F.lit(0)).alias("n_comments"),
            F.md5(F.array_join(F.transform(reviews["comments"], one), "\n")).alias("comments"),
            F.md5(F.array_join(reviews["review_texts"], "\n")).alias("review_texts")]


#: Twin of the payload, by bundle: comments in order, their count, the first turn as review text.
PAYLOAD_SQL = """pay AS (SELECT h.conv_id AS bundle_ord, count(c.post_id)::INTEGER AS n_comments,
  coalesce(string_agg(coalesce(c.body, '') || '|' || (CASE WHEN c.c_pos % 3 = 0 THEN c.c_pos ELSE coalesce(c.ups, 0) END)::VARCHAR || '|' ||
    CASE WHEN c.c_pos % 2 = 0 AND c.title <> '' THEN c.title ELSE '-' END, chr(10) ORDER BY c.c_pos), '') AS comments,
  coalesce(string_agg(coalesce(c.body, '') || '|' || (CASE WHEN c.c_pos % 3 = 0 THEN c.c_pos ELSE coalesce(c.ups, 0) END)::VARCHAR || '|-', chr(10) ORDER BY c.c_pos), '') AS untitled,
  coalesce(any_value(h.t0), '') AS review_texts
  FROM heads h LEFT JOIN v_comments c ON c.post_id = h.conv_id GROUP BY h.conv_id)"""


def full_corpus(spark, d):
    """Corpus entries with reviews and specifications."""
    b = bundles(spark, d)
    spec_texts = v_spec_docs(spark, d).select(F.col("corpus_idx").cast("bigint").alias("spec_doc_id"), F.col("json").alias("specifications"))
    return cat.with_payload(corpus_df(spark, d), ing.bundle_payload(b), spec_texts)


@register("corpus_entries", CORPUS_SQL + "," + PAYLOAD_SQL + """
SELECT corpus_idx, coalesce(nullif(key, ''), nullif(product_oid, ''), 'prod_' || corpus_idx::VARCHAR) AS id,
  name, key, spec_doc_id::VARCHAR AS spec_doc, n_comments, md5(comments) AS comments, md5(review_texts) AS review_texts
  FROM named JOIN pay USING (bundle_ord)""")
def q_corpus_entries(spark, d):
    c = full_corpus(spark, d)
    doc = F.try_variant_get(F.parse_json("specifications"), "$._id['$oid']", "string")
    return c.select("corpus_idx", "id", "name", "key", doc.alias("spec_doc"), *payload_columns(F.col("reviews")))


@register("corpus_roundtrip", CORPUS_SQL + "," + PAYLOAD_SQL + "," + O.FLAT_SPECS + f""",
sp AS (SELECT product_id, string_agg(spec_key || '=' || spec_value, chr(10) ORDER BY spec_key) AS specs FROM flat_specs GROUP BY 1),
ids AS (SELECT *, coalesce(nullif(key, ''), nullif(product_oid, ''), 'prod_' || corpus_idx::VARCHAR) AS id FROM named),
al AS (SELECT alias, min(corpus_idx) AS corpus_idx FROM (SELECT corpus_idx, unnest({O.aliases_sql('name', 'key')}) AS alias FROM ids) x GROUP BY 1),
na AS (SELECT corpus_idx, count(*) AS n FROM al GROUP BY 1)
SELECT ids.corpus_idx, id, name, key, coalesce(na.n, 0)::BIGINT AS n_aliases, n_comments, md5(comments) AS comments, md5(review_texts) AS review_texts,
  md5(specs) AS specifications
FROM ids JOIN pay USING (bundle_ord) LEFT JOIN na USING (corpus_idx) LEFT JOIN sp ON sp.product_id = ids.spec_doc_id::VARCHAR""")
def q_corpus_roundtrip(spark, d):
    """Corpus with payload and alias index written as JSON under the shared checkpoint dir and read back; documents flattened from what was read."""
    path = ing.scratch_path(spark, "corpus")
    c = cut_lineage(full_corpus(spark, d))
    ing.write_corpus(c, cat.alias_index(cat.alias_rows(c)), path, fmt="json")
    back, index = ing.read_corpus(spark, path, fmt="json")
    docs = sp.parse_spec_docs(back.where(F.col("specifications").isNotNull()).select(F.col("specifications").alias("json")).distinct())
    flat = sp.flatten_specs(docs).groupBy(F.col("product_id").alias("doc")).agg(
        F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("spec_key", "spec_value"))), lambda x: F.concat(x["spec_key"], F.lit("="), x["spec_value"])), "\n")).alias("specs"))
    doc = F.try_variant_get(F.parse_json("specifications"), "$._id['$oid']", "string")
    owned = index.groupBy("corpus_idx").agg(F.count("*").alias("n"))
    return (back.withColumn("doc", doc).join(flat, "doc", "left").join(owned, "corpus_idx", "left")
            .select("corpus_idx", "id", "name", "key", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_aliases"), *payload_columns(F.col("reviews")), F.col("specs").alias("specifications")))


@register("corpus_load_tolerant", O.with_(O.V_CATALOG) + """SELECT CASE WHEN corpus_idx % 50 = 0 THEN NULL ELSE corpus_idx END AS corpus_idx,
  CASE WHEN corpus_idx % 50 = 0 THEN NULL ELSE name END AS name, corpus_idx % 50 = 0 AS is_corrupt FROM v_catalog""")
def q_corpus_load_tolerant(spark, d):
    c = v_catalog(spark, d)
    line = F.when(F.col("corpus_idx") % 50 == 0, F.concat(F.lit('{"corpus_idx": '), F.col("corpus_idx").cast("string"), F.lit(', "name": ')))\
        .otherwise(F.to_json(F.struct("corpus_idx", "name")))
    path = ing.scratch_path(spark, "corpus-lines")
    c.select(line.alias("value")).write.mode("overwrite").text(path)
    r = ing.read_corpus_tolerant(spark, path, "corpus_idx BIGINT, name STRING")
    return r.select("corpus_idx", "name", F.col("_corrupt").isNotNull().alias("is_corrupt"))


@register("spec_html_parse", """SELECT p_partkey AS page_id, s.section_ord, s.section, s.sub_ord, s.title, s.value FROM part, (
  SELECT * FROM (VALUES (0, 'Battery', 0, 'Type'), (0, 'Battery', 1, 'Charging'), (1, 'Body', 0, 'Weight'), (1, 'Body', 1, 'SIM'),
                        (2, 'Main Camera', 0, 'Single'), (3, 'Platform', 0, 'OS')) t(section_ord, section, sub_ord, title)) s0,
  LATERAL (SELECT s0.section_ord::INTEGER AS section_ord, s0.section, s0.sub_ord::INTEGER AS sub_ord, s0.title,
    CASE s0.title WHEN 'Type' THEN trim(p_type) WHEN 'Charging' THEN p_size::VARCHAR || 'W'
      WHEN 'Weight' THEN (p_partkey % 150 + 100)::VARCHAR || ' g' WHEN 'SIM' THEN 'Nano-SIM'
      WHEN 'Single' THEN (p_size % 50)::VARCHAR || ' MP f/1.8' ELSE 'OS ' || (p_partkey % 7)::VARCHAR END AS value) s""")
def q_spec_html_parse(spark, d):
    return ing.spec_html_parse(v_spec_html(spark, d))


LINK_RE = 'href="(/[a-z]+)"'


@register("page_links", f"""SELECT page_id, link, split_part(replace(string_split(link, '/')[-1], '.php', ''), '-', 1) AS page_key FROM (
  SELECT page_id, regexp_extract_all(html, {O.str_lit(LINK_RE)}, 1)[1] AS link FROM pages) x WHERE link IS NOT NULL""")
def q_page_links(spark, d):
    return ing.page_links(table(spark, d, "pages"), LINK_RE)
