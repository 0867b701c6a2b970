"""Bridge views: the driver's tables re-shaped into the engine's input schemas.

Each view here has a DuckDB twin in ``revidence.plans.oracle_sql`` (same arithmetic on ids,
no randomness), so every operator can be checked against SQL on the same parquet files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _e(i: Column | int) -> Column:
    """1-based element of the scaled embedding ``e`` (same indexing as the SQL twin)."""
    return F.element_at(F.col("e"), i if isinstance(i, Column) else F.lit(i))


def v_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored reviews: relevance, usefulness and four logit blocks derived from ``embeddings``."""
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 16).alias("e"))
    vid = F.col("vec_id")
    off = F.when(vid % 10 == 3, F.lit(50.0)).otherwise(F.lit(0.0))
    seq = F.sequence(F.lit(0), F.lit(28))
    return emb.select(
        vid.alias("review_id"),
        F.when(vid % 50 == 0, F.lit(99).cast("bigint")).otherwise(vid % 7).alias("product_id"),
        F.when(vid % 9 == 0, F.lit(0.7)).when(vid % 11 == 0, F.lit(0.45)).otherwise(F.lit(1.0)).alias("relevance"),
        (F.lit(10.0) / (F.lit(1.0) + F.exp(-_e(64)))).alias("usefulness"),
        F.transform(F.slice("e", 1, 9), lambda x: x - off).alias("top"),
        F.slice("e", 10, 29).alias("sub"),
        F.transform(seq, lambda s: _e((s + 38) % 64 + 1)).alias("comp"),
        F.transform(seq, lambda s: F.struct(_e((s + 20) % 64 + 1).alias("neg"),
                                            _e((s + 45) % 64 + 1).alias("pos"))).alias("sent"),
    )


def v_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold labels per review in long form: (review_id, top_idx) and (review_id, sub_idx, sent, comp)."""
    from revidence import dims
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("review_id"), "label")
    tx = dims.dim_taxonomy(spark)
    cells = (emb.where(F.col("label") < 9)
             .join(F.broadcast(tx), F.col("label") == tx.top_idx)
             .where((F.col("review_id") + F.col("sub_idx")) % 3 != 0)
             .select("review_id", "top_idx", "sub_idx",
                     ((F.col("review_id") + F.col("sub_idx")) % 2).cast("int").alias("y_sent"),
                     ((F.col("review_id") + 2 * F.col("sub_idx")) % 5 == 0).cast("int").alias("y_comp")))
    return cells


def v_label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per labelled review, as a labelling tool writes it. Even ids carry 0/1 vectors, odd ids one top index and a list of sub indices with a -1."""
    from revidence import dims
    sub = F.col("sub_idx").cast("int")
    raw = F.element_at(F.array(F.lit("negative"), F.lit("positive"), F.lit("neutral")), ((F.col("review_id") + sub) % 3 + 1).cast("int"))
    per = v_labels(spark, sf_dir).groupBy("review_id", "top_idx").agg(
        F.sort_array(F.collect_list(sub)).alias("idx"), F.collect_list(F.struct(sub.cast("string").alias("k"), raw.alias("v"))).alias("s"))
    even = F.col("review_id") % 2 == 0

    def hot(n, has):
        return F.to_json(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: has(i).cast("int")))
    top = F.when(even, hot(dims.N_TOP, lambda i: i == F.col("top_idx"))).otherwise(F.col("top_idx").cast("string"))
    subs = F.when(even, hot(dims.N_SUB, lambda i: F.array_contains("idx", i))).otherwise(F.to_json(F.concat("idx", F.array(F.lit(-1)))))
    return per.select("review_id", F.parse_json(top).alias("top_cluster_ids"), F.parse_json(subs).alias("sub_cluster_ids"),
                      F.create_map(F.col("top_idx").cast("string"), F.col("idx")).alias("top_to_sub_ids"),
                      F.map_from_entries("s").alias("sentiments"))


def v_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per labelled review with its top label (or none)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("review_id"),
                      F.when(F.col("label") < 9, F.col("label")).alias("y_top"))


# --- reviews and products (from documents) --------------------------------------------------

# Fixture product names, one per document source (FIXTURES.md: every match tier occurs).
PRODUCT_NAMES = [
    "The And", "with that 17", "est que le 5", "de la que", "und der die", "on 12 pro",
    "Nokia the 3310", "Galaxy of the", "zzz of qqq www", "qqq zzz", "in the", "for and with 15",
    "the the zzz", "la les des", "ing tion", "of", "el que 7a", "die und zzz", "que", "",
]

# Decorations by doc_id % 8 so that every cleaner rule fires: (prefix, suffix).
DECORATIONS = [
    ("https://a.example/x?y=1 ", ""),
    ("", " www.b.example/z"),
    ("\"it's\" ", ""),
    ("", " a/b \\/ c"),
    ("\U0001F600 ", ""),
    ("", " , ,, , end"),
    ("日本 ", "\\n\\ntail"),
    ("\u00a0", ""),
]


def raw_text_col(doc_id: Column, text: Column) -> Column:
    m = doc_id % 8
    out = None
    for i, (pre, suf) in enumerate(DECORATIONS):
        v = F.concat(F.lit(pre), text, F.lit(suf))
        out = F.when(m == i, v) if out is None else out.when(m == i, v)
    return out


def v_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw review items: (product_id, review_id, origin, pos, raw_text, likes)."""
    d = table(spark, sf_dir, "documents")
    is_comment = (F.col("doc_id") % 3) != 0
    return d.select(
        F.col("source").alias("product_id"),
        F.col("doc_id").alias("review_id"),
        F.when(is_comment, F.lit("comment")).otherwise(F.lit("review")).alias("origin"),
        F.col("doc_id").alias("pos"),
        raw_text_col(F.col("doc_id"), F.col("text")).alias("raw_text"),
        F.when(is_comment, F.col("n_chars") % 101).cast("bigint").alias("likes"),
    )


def v_products(spark: SparkSession) -> DataFrame:
    """(product_id, name). Literal rows, whose size the planner knows: joins on the few products need no shuffle of the texts, and no Python
    worker reads them."""
    rows = ", ".join(f"('src{i}', '{n}')" for i, n in enumerate(PRODUCT_NAMES))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(product_id, name)")


# --- catalog (from part) ---------------------------------------------------------------------

def catalog_name_col(k: Column, p_name: Column, p_brand: Column) -> Column:
    m = k % 8
    k17, k19, k13 = (k % 17).cast("string"), (k % 19).cast("string"), (k % 13).cast("string")
    return (F.when(m == 0, F.concat(F.lit("Apple iPhone "), k17, F.lit(" Pro Max")))
            .when(m == 1, F.concat(F.lit("Apple iPhone "), k17, F.lit(" Pro")))
            .when(m == 2, F.concat(F.lit("Apple iPhone "), k17, F.lit(" Plus")))
            .when(m == 3, F.concat(F.lit("Apple iPhone "), k17, F.lit(" Mini")))
            .when(m == 4, F.concat(F.lit("Samsung Galaxy S"), k19))
            .when(m == 5, F.concat(F.lit("Google Pixel "), k13, F.lit("a")))
            .when(m == 6, F.concat(F.lit("Nokia "), p_name))
            .otherwise(F.concat(p_name, F.lit(" "), p_brand)))


def v_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries: (corpus_idx, key, oid, name)."""
    p = table(spark, sf_dir, "part")
    key = F.concat(F.lit("k_"), F.col("p_partkey").cast("string"))
    return p.select(F.col("p_partkey").alias("corpus_idx"), key.alias("key"),
                    F.substring(F.md5(key), 1, 24).alias("oid"),
                    catalog_name_col(F.col("p_partkey"), F.col("p_name"), F.col("p_brand")).alias("name"))


# --- specification documents (from part) -----------------------------------------------------

def _j(s: Column) -> Column:
    """JSON list leaf ["s"] (escaped by to_json)."""
    return F.to_json(F.array(s))


def _jstr(s: Column) -> Column:
    """JSON string literal "s" (escaped by to_json)."""
    return F.regexp_extract(F.to_json(F.struct(s.alias("n"))), r'^\{"n":(.*)\}$', 1)


def _sec(title: str, body: Column) -> Column:
    return F.concat(F.lit('{"title":"' + title + '","data":'), body, F.lit("}"))


def _obj(*secs: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *secs), F.lit("]"))


def _parts(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Columns of part, dealt out by key: the packed file is a few splits, and a row becomes a document of many times its size.
    The number is given, as rows this narrow would be put together again."""
    return table(spark, sf_dir, "part").select("p_partkey", *cols).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def v_spec_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spec documents as JSON text, one per part. By p_partkey % 5: three-level nesting, empty
    list, scalar leaf, duplicate key (last wins), plain."""
    p = _parts(spark, sf_dir, "p_name", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    m = k % 5
    ks = lambda c: c.cast("string")
    battery = _sec("Battery", _obj(_sec("Type", _j(F.concat(F.lit(" "), F.col("p_type"), F.lit(" ")))),
                                   _sec("Charging", _j(F.concat(ks(F.col("p_size")), F.lit("W"))))))
    body = _sec("Body", _obj(_sec("Weight", _j(F.concat(ks(k % 150 + 100), F.lit(" g")))),
                             _sec("SIM", _j(F.lit("Nano-SIM")))))
    camera = _sec("Main Camera", _obj(_sec("Single", F.to_json(F.array(
        F.concat(ks(F.col("p_size") % 50), F.lit(" MP")), F.lit(" f/1.8"))))))
    platform = _sec(" Platform ", _obj(_sec("OS", _j(F.concat(F.lit("OS "), ks(k % 7))))))
    extra = (F.when(m == 0, _sec("Our Tests", _obj(_sec("Battery", _obj(_sec("Life", _j(
                 F.concat(F.lit("Endurance "), ks(k % 90), F.lit("h")))))))))
             .when(m == 1, _sec("Misc", F.lit("[]")))
             .when(m == 2, _sec("Launch", _jstr(F.concat(F.lit("Announced "), ks(k % 25 + 2000)))))
             .when(m == 3, _sec("Platform", _obj(_sec("OS", _j(F.lit("Updated OS"))))))
             .otherwise(None))
    secs = F.concat(F.lit("["), F.concat_ws(",", battery, body, camera, platform, extra), F.lit("]"))
    doc = F.concat(F.lit('{"_id":{"$oid":"'), ks(k), F.lit('"},"key":"k_'), ks(k), F.lit('","name":'),
                   _jstr(catalog_name_col(k, F.col("p_name"), F.col("p_brand"))),
                   F.lit(',"specification":{"key":"k_'), ks(k), F.lit('","more_specification":'), secs, F.lit("}}"))
    return p.select(k.alias("corpus_idx"), doc.alias("json"))


def v_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lookup probe per catalog row, by corpus_idx % 6: exact name, alias (brand dropped),
    mid-word fragment, miss, empty string, upper-cased name with punctuation."""
    from revidence.functions.text import normalize_key
    c = v_catalog(spark, sf_dir)
    k = F.col("corpus_idx")
    n = normalize_key(F.col("name"))
    m = k % 6
    q = (F.when(m == 0, F.col("name"))
         .when(m == 1, F.regexp_replace(n, "^(apple|samsung|google) +", ""))
         .when(m == 2, F.substring(n, 2, 6))
         .when(m == 3, F.concat(F.lit("zz"), k.cast("string"), F.lit("qq")))
         .when(m == 4, F.lit(""))
         .otherwise(F.concat(F.upper(F.col("name")), F.lit("!!"))))
    return c.select(k.alias("qid"), q.alias("query"))


# --- forum posts, comments and review bundles (from conversations) -------------------------------

def _conv_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("t0"), F.min("turn").alias("t_min"))


def v_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of two products (four fifths are product 0): the first turn is title and text, or the title alone in one of three."""
    h = _conv_heads(spark, sf_dir)
    cid = F.col("conv_id")
    link_only = cid % 3 == 0
    return h.select(cid.alias("post_id"), (cid % 5 == 0).cast("bigint").alias("product_id"), cid.alias("pos"),
                    F.when(link_only, F.col("t0")).otherwise(F.array_join(F.slice(F.split("t0", " "), 1, 8), " ")).alias("title"),
                    F.when(~link_only, F.col("t0")).otherwise(F.lit("")).alias("selftext"))


def v_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    h = _conv_heads(spark, sf_dir)
    p = v_posts(spark, sf_dir).select("post_id", "product_id", "title")
    # first turns are whole texts: shuffled (all by conversation), not guessed to be small from the packed file and broadcast
    j = c.join(h.hint("merge"), "conv_id").where(F.col("turn") > F.col("t_min")).join(p.hint("merge"), F.col("conv_id") == F.col("post_id"))
    return j.select("post_id", "product_id", F.col("turn").alias("c_pos"), F.col("text").alias("body"),
                    F.when(F.col("turn") == 5, F.lit(None)).otherwise(F.col("turn") * 3).cast("bigint").alias("ups"),
                    "title")


def v_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON review bundle per conversation: union-typed product ({"$oid"} or a key string),
    name, comments with body/text and ups/upvotes variants, and the first turn as review text."""
    cm = v_comments(spark, sf_dir)
    t = F.col("c_pos")
    with_title = F.when(t % 2 == 0, F.col("title"))
    js = F.when(t % 3 == 0, F.to_json(F.struct(F.col("body").alias("text"), t.alias("upvotes"), with_title.alias("post_title")))) \
        .otherwise(F.to_json(F.struct(F.col("body").alias("body"), F.col("ups").alias("ups"), with_title.alias("post_title"))))
    per = cm.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct(t.alias("k"), js.alias("j")))).alias("cs"))
    h = _conv_heads(spark, sf_dir)
    b = h.join(per.hint("merge"), h.conv_id == per.post_id, "left")
    cid = F.col("conv_id")
    product = F.when(cid % 2 == 0, F.concat(F.lit('{"$oid":"'), (cid % 40).cast("string"), F.lit('"}'))) \
        .otherwise(F.concat(F.lit('"k_'), (cid % 50).cast("string"), F.lit('"')))
    name = F.when(cid % 5 == 1, F.concat(F.lit("Apple iPhone "), (((cid % 30) * 8) % 17).cast("string"), F.lit(" Pro Max"))) \
        .otherwise(F.concat(F.lit("Product "), (cid % 13).cast("string")))
    comments = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("cs", lambda x: x["j"]), ","), F.lit("")), F.lit("]"))
    doc = F.concat(F.lit('{"product":'), product, F.lit(',"name":'), F.to_json(F.array(name)).substr(F.lit(2), F.length(F.to_json(F.array(name))) - 2),
                   F.lit(',"comments":'), comments, F.lit(',"review_texts":'), F.to_json(F.array("t0")), F.lit("}"))
    return b.select(cid.alias("bundle_ord"), doc.alias("json"))


#: Posts a landed search page holds, bundles a landed JSON array holds.
PAGE, BUNDLES_A_FILE = 25, 20


def _json_member(name: str, value: Column) -> Column:
    """"name":value of a string column, escaped."""
    return F.regexp_extract(F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"}), r"(?s)^\{(.*)\}$", 1)


def land_bundles(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Bundles as JSON files: arrays of BUNDLES_A_FILE bundles on one line, in order over the files."""
    b = v_bundles(spark, sf_dir).withColumn("f", F.floor(F.col("bundle_ord") / BUNDLES_A_FILE))
    arrays = b.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("bundle_ord", "json"))).alias("x")).select(
        "f", F.concat(F.lit("[ "), F.array_join(F.col("x.json"), ", "), F.lit(" ]")).alias("value"))
    arrays.repartitionByRange(4, "f").sortWithinPartitions("f").select("value").write.text(path)


def land_pages(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Search pages and comment pages as JSON lines, one response a line: path/search/product_id=.., path/comments (permalink, json)."""
    posts, comments = v_posts(spark, sf_dir), v_comments(spark, sf_dir)
    n = comments.groupBy("post_id").agg(F.count("*").alias("n"))
    # posts without a link, and with a link but no comments, so that their comment pages must not be used
    link = F.concat(F.lit("/r/x/comments/"), F.col("post_id").cast("string"), F.lit("/"))
    p = posts.join(n, "post_id", "left").withColumn("j", F.concat(
        F.lit('{"kind":"t3","data":{'), _json_member("id", F.col("post_id").cast("string")), F.lit(","), _json_member("title", F.col("title")), F.lit(","),
        _json_member("selftext", F.col("selftext")), F.lit(',"num_comments":'), F.when(F.col("post_id") % 11 == 3, 0).otherwise(F.coalesce("n", F.lit(0))).cast("string"),
        F.when(F.col("post_id") % 7 == 2, F.lit("")).otherwise(F.concat(F.lit(","), _json_member("permalink", link))), F.lit("}}")))
    search = p.groupBy("product_id", F.floor(F.col("post_id") / PAGE).alias("page")).agg(F.sort_array(F.collect_list(F.struct("pos", "j"))).alias("c"))
    search.select("product_id", F.concat(F.lit('{"kind":"Listing","data":{"after":null,"children":['), F.array_join(F.col("c.j"), ","), F.lit("]}}")).alias("value")) \
        .write.partitionBy("product_id").text(f"{path}/search")
    c = comments.withColumn("j", F.concat(F.lit('{"kind":"t1","data":{'), _json_member("body", F.col("body")), F.lit(',"ups":'), F.coalesce(F.col("ups").cast("string"), F.lit("null")), F.lit("}}")))
    pages = c.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("c_pos", "j"))).alias("c"))
    pages.select(link.alias("permalink"), F.concat(F.lit('[{"kind":"Listing","data":{"children":[]}},{"kind":"Listing","data":{"children":['), F.array_join(F.col("c.j"), ","), F.lit("]}}]")).alias("json")) \
        .write.json(f"{path}/comments")


def v_spec_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spec pages rendered as tables (th / td.ttl / td.nfo); an untitled continuation row when
    p_partkey % 4 = 0."""
    p = _parts(spark, sf_dir, "p_type", "p_size")
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    cont = F.when(k % 4 == 0, F.lit('<tr><td class="ttl"></td><td class="nfo">continued</td></tr>')).otherwise(F.lit(""))
    html = F.concat(
        F.lit('<html><body><table><tr><th>Battery</th><td class="ttl">Type</td><td class="nfo"> '), F.col("p_type"),
        F.lit(' </td></tr><tr><td class="ttl">Charging</td><td class="nfo">'), s(F.col("p_size")), F.lit("W</td></tr>"), cont,
        F.lit('</table><table><tr><th>Body</th><td class="ttl">Weight</td><td class="nfo">'), s(k % 150 + 100),
        F.lit(' g</td></tr><tr><td class="ttl">SIM</td><td class="nfo">Nano-SIM</td></tr></table>'
              '<table><tr><th>Main Camera</th><td class="ttl">Single</td><td class="nfo">'), s(F.col("p_size") % 50),
        F.lit(' MP<br>f/1.8</td></tr></table><table><tr><th>Platform</th><td class="ttl">OS</td><td class="nfo">OS '),
        s(k % 7), F.lit("</td></tr></table></body></html>"))
    return p.select(k.alias("page_id"), html.alias("html"))
