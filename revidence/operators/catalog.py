"""Catalog, aliases and lookup as joins.

The reference keeps a Python dict ``alias -> corpus position`` and falls back to a linear
substring scan. Here the alias index is a table, the exact lookup is an equi join, and the
substring fallback is ``contains_join``: an exact containment join that never forms the
full needle x haystack product. Needles of >= 3 characters join haystack trigrams on their
rarest trigram (every haystack that contains the needle contains that trigram); needles of
1-2 characters equi-join the haystack's distinct 1- and 2-grams. No nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revidence.functions import text as T

# ---------------------------------------------------------------------------
# Fixed values (alias rules that must equal the reference)
# ---------------------------------------------------------------------------
BRANDS = ["apple", "samsung", "google", "sony", "oneplus", "xiaomi", "motorola", "realme", "vivo", "oppo", "asus"]
BRAND_RE = "^(" + "|".join(BRANDS) + ") +"
GALAXY_PIXEL_BRAND_RE = "^(samsung|google) +"


def generate_aliases(name: Column, key: Column | None = None, compat: bool = False) -> Column:
    """Distinct, sorted search aliases of a product name (and optional key).

    ``compat=True`` keeps the reference's double space left by removing "iphone"
    (unreachable by a normalised query); the default collapses it.
    """
    n = T.normalize_key(name)
    k = T.normalize_key(F.coalesce(key, F.lit(""))) if key is not None else F.lit("")
    no_brand = F.regexp_replace(n, BRAND_RE, "")
    no_iphone = F.trim(F.replace(n, F.lit("iphone"), F.lit("")))
    if not compat:
        no_iphone = F.trim(F.regexp_replace(no_iphone, " +", " "))
    num = F.regexp_extract(n, r"(\d+)", 1)
    has = lambda s: F.instr(n, s) > 0
    is_iphone = has("iphone")
    has_num = num != ""
    c = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    pm, pro, plus, mini = has("pro max"), has("pro"), has("plus"), has("mini")
    base = is_iphone & has_num
    cands = [
        F.when(n != "", n),
        F.when(k != "", k),
        F.when((no_brand != "") & (no_brand != n), no_brand),
        F.when(is_iphone & (no_iphone != ""), no_iphone),
        F.when(base & pm, c(num, " pro max")), F.when(base & pm, c(num, "pm")), F.when(base & pm, c("pro max ", num)),
        F.when(base & ~pm & pro, c(num, " pro")), F.when(base & ~pm & pro, c("pro ", num)),
        F.when(base & ~pm & pro, c(num, "p")),
        F.when(base & ~pm & ~pro & plus, c(num, " plus")), F.when(base & ~pm & ~pro & plus, c("plus ", num)),
        F.when(base & ~pm & ~pro & ~plus & mini, c(num, " mini")),
        F.when(base & ~pm & ~pro & ~plus & mini, c("mini ", num)),
        F.when((has("galaxy") | has("pixel")) & (F.regexp_replace(n, GALAXY_PIXEL_BRAND_RE, "") != ""),
               F.regexp_replace(n, GALAXY_PIXEL_BRAND_RE, "")),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*cands))))


def alias_rows(corpus: DataFrame, compat: bool = False) -> DataFrame:
    """(corpus_idx, alias) for every entry."""
    return corpus.select("corpus_idx", F.explode(generate_aliases(F.col("name"), F.col("key"), compat)).alias("alias"))


def alias_index(aliases: DataFrame) -> DataFrame:
    """First product to claim an alias keeps it (lowest corpus position)."""
    return aliases.groupBy("alias").agg(F.min("corpus_idx").alias("corpus_idx"))


def alias_upsert(index: DataFrame, new_entries: DataFrame) -> DataFrame:
    """New entries (corpus_idx, name, id) overwrite their normalised-name and id keys (last wins)."""
    new_keys = new_entries.select("corpus_idx", F.explode(F.array_distinct(F.array_compact(F.array(
        F.when(T.normalize_key(F.col("name")) != "", T.normalize_key(F.col("name"))), F.col("id"))))).alias("alias"))
    both = (index.select("alias", "corpus_idx", F.lit(0).alias("prio"))
            .unionByName(new_keys.select("alias", "corpus_idx", F.lit(1).alias("prio"))))
    return both.groupBy("alias").agg(F.max_by("corpus_idx", F.struct("prio", "corpus_idx")).alias("corpus_idx"))


def short_grams(c: Column) -> Column:
    """Distinct 1- and 2-character substrings: a 1-2 character needle is contained in ``c``
    exactly when it equals one of them."""
    one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.substring(c, i, 1))
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, 2))
    return F.array_distinct(F.filter(F.concat(one, two), lambda g: g != ""))


def _tri(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))),
                                        lambda i: F.substring(c, i, 3)))


def contains_join(needles: DataFrame, hay: DataFrame, n_col: str = "needle", h_col: str = "hay") -> DataFrame:
    """All (needle row, hay row) with needle a substring of hay (needle non-empty). Exact.

    Needles of >= 3 characters are blocked on their rarest trigram (document frequency over the
    hay side; a needle with a trigram absent from every hay row matches nothing). Every hay row
    containing the needle contains that trigram, so the equi join is an exact superset that
    the ``instr`` check then verifies.
    """
    ht = hay.where(F.length(h_col) >= 3).select("*", F.explode(_tri(F.col(h_col))).alias("_tri"))
    df = ht.groupBy("_tri").agg(F.count("*").alias("_df"))
    nl = needles.where(F.length(n_col) >= 3)
    nvals = nl.select(F.col(n_col).alias("_nv")).distinct()
    ng = nvals.select("_nv", F.explode(_tri(F.col("_nv"))).alias("_tri")).join(df, "_tri", "left")
    key = ng.groupBy("_nv").agg(F.min_by("_tri", F.coalesce(F.col("_df"), F.lit(0))).alias("_tri"))
    nk = nl.join(key, F.col(n_col) == F.col("_nv")).drop("_nv")
    long_hits = ht.join(nk, "_tri").where(F.instr(F.col(h_col), F.col(n_col)) > 0).drop("_tri")
    short = needles.where((F.length(n_col) > 0) & (F.length(n_col) < 3))
    hg = hay.select("*", F.explode(short_grams(F.col(h_col))).alias("_sg"))
    short_hits = hg.join(short, F.col("_sg") == F.col(n_col)).drop("_sg")
    return long_hits.unionByName(short_hits)


def resolve_specs(items: DataFrame, specs: DataFrame) -> DataFrame:
    """I4: spec doc per review bundle: by oid, else normalised name, else key (when the bundle's
    product field is a string). On duplicate right-side keys the last spec (highest ord) wins.
    The specs are shuffled, never broadcast: their size is guessed from the packed files, far below what the driver would have to hold."""
    def last_by(col: Column, name: str) -> DataFrame:
        s = specs.where(col.isNotNull() & (col != "")).select(col.alias(name), "spec_ord", "spec_doc_id")
        return s.groupBy(name).agg(F.max_by("spec_doc_id", "spec_ord").alias(f"doc_{name}"))
    by_oid = last_by(F.col("oid"), "k_oid")
    by_name = last_by(T.normalize_key(F.col("name")), "k_name")
    by_key = last_by(F.col("key"), "k_key")
    it = items.withColumn("k_name", T.normalize_key(F.coalesce("product_name", F.lit(""))))
    j = (it.join(by_oid.hint("merge"), it.oid == by_oid.k_oid, "left")
         .join(by_name.hint("merge"), "k_name", "left")
         .join(by_key.hint("merge"), F.when(it.product_is_str, it.oid) == by_key.k_key, "left"))
    return j.select(*items.columns, F.coalesce("doc_k_oid", "doc_k_name", "doc_k_key").alias("spec_doc_id"))


def corpus_entries(resolved: DataFrame, specs: DataFrame) -> DataFrame:
    """Corpus name/id per bundle (spec name/key, else own name + slug, else Product_{oid|n})."""
    s = specs.select("spec_doc_id", F.col("name").alias("spec_name"), F.col("key").alias("spec_key"))
    j = resolved.join(s.hint("merge"), "spec_doc_id", "left")   # as in resolve_specs
    matched = F.col("spec_doc_id").isNotNull()
    has_name = F.coalesce(F.col("product_name"), F.lit("")) != ""
    pos = F.col("corpus_idx").cast("string")
    name = (F.when(matched, F.coalesce(F.when(F.col("spec_name") != "", F.col("spec_name")),
                                       F.when(has_name, F.col("product_name")), F.concat(F.lit("Product_"), F.col("oid"))))
            .when(has_name, F.col("product_name"))
            .when(F.coalesce(F.col("oid"), F.lit("")) != "", F.concat(F.lit("Product_"), F.col("oid")))
            .otherwise(F.concat(F.lit("Product_"), pos)))
    skey = (F.when(matched, F.coalesce(F.col("spec_key"), F.lit("")))
            .when(has_name, F.replace(T.normalize_key(F.col("product_name")), F.lit(" "), F.lit("_")))
            .otherwise(F.coalesce(F.col("oid"), F.lit(""))))
    cid = F.coalesce(F.when(skey != "", skey), F.when(F.col("oid") != "", F.col("oid")), F.concat(F.lit("prod_"), pos))
    ord_ = ["bundle_ord"] if "bundle_ord" in resolved.columns else []
    return j.select("corpus_idx", *ord_, cid.alias("id"), name.alias("name"), skey.alias("key"), "spec_doc_id")


def with_payload(entries: DataFrame, payload: DataFrame, spec_texts: DataFrame) -> DataFrame:
    """Entries (with bundle_ord and spec_doc_id) and their payload: reviews from ``payload`` (bundle_ord, reviews), specifications from
    ``spec_texts`` (spec_doc_id, specifications). Texts are joined last, once each; positions and keys were settled on ids alone.
    Neither side is broadcast. Specifications come first, while entries are ids: many bundles may share a document, and the reviews
    are then dealt out by bundle_ord, which is unique."""
    return (entries.join(spec_texts.hint("merge"), "spec_doc_id", "left").join(payload.hint("merge"), "bundle_ord", "left")
            .select("corpus_idx", "id", "name", "key", "reviews", "specifications"))


def lookup_exact(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, corpus_idx) for queries whose normalised form is an alias."""
    q = queries.select("qid", T.normalize_key(F.col("query")).alias("norm"))
    return q.join(index.withColumnRenamed("alias", "norm"), "norm").select("qid", "corpus_idx")


def lookup_fuzzy(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """For each query, the lowest corpus position with norm in name, name in norm, or norm in
    id (normalised). Empty names are excluded (the reference lets them match everything).

    Only the minimum position matters, so both sides are pre-aggregated before the containment
    join: distinct query strings, and distinct names / ids carrying their lowest position. The
    join then enumerates distinct-string matches, not row pairs.
    """
    q = queries.select("qid", T.normalize_key(F.col("query")).alias("norm")).where(F.col("norm") != "")
    qd = q.select("norm").distinct()
    c = corpus.select("corpus_idx", T.normalize_key(F.col("name")).alias("nn"), T.normalize_key(F.col("id")).alias("ni"))
    names = c.where(F.col("nn") != "").groupBy("nn").agg(F.min("corpus_idx").alias("ci"))
    ids = c.where(F.col("ni") != "").groupBy("ni").agg(F.min("corpus_idx").alias("ci"))
    a = contains_join(qd, names, "norm", "nn").select("norm", "ci")
    b = contains_join(names, qd, "nn", "norm").select("norm", "ci")
    i = contains_join(qd, ids, "norm", "ni").select("norm", "ci")
    best = a.unionByName(b).unionByName(i).groupBy("norm").agg(F.min("ci").alias("corpus_idx"))
    return q.join(best, "norm").select("qid", "corpus_idx")


def lookup_product(queries: DataFrame, index: DataFrame, corpus: DataFrame) -> DataFrame:
    """I8: exact hit, else fuzzy on the misses only, else null. An index position that the corpus doesn't have (a stale index) is a miss."""
    ex = lookup_exact(queries, index).join(corpus.select("corpus_idx"), "corpus_idx", "left_semi").select("qid", "corpus_idx")
    misses = queries.join(ex.select("qid"), "qid", "left_anti")
    fz = lookup_fuzzy(misses, corpus)
    hits = ex.withColumn("how", F.lit("exact")).unionByName(fz.withColumn("how", F.lit("fuzzy")))
    return queries.select("qid").join(hits, "qid", "left")


def corpus_append(corpus: DataFrame, new_items: DataFrame) -> DataFrame:
    """Append new products (name, new_ord and any payload: reviews, specifications) with id = slug and dense positions after the
    current maximum (distributed dense index over the batch, no global window). Payload columns that one side lacks are null there;
    the dense index sees names only, the payload is joined to the settled positions by new_ord (unique in a batch)."""
    from revidence.sources.ingest import dense_index
    payload = [c for c in ("reviews", "specifications") if c in new_items.columns]
    last = corpus.agg(F.coalesce(F.max("corpus_idx"), F.lit(-1))).scalar()
    n = dense_index(new_items.select("name", "new_ord"), ["new_ord"], out="rn")
    if payload:
        n = n.join(new_items.select("new_ord", *payload), "new_ord")
    add = n.select((last + F.col("rn") + 1).alias("corpus_idx"), T.slug_id(F.col("name")).alias("id"), "name", F.lit("").alias("key"), *payload)
    old = corpus.select("corpus_idx", "id", "name", "key", *(c for c in ("reviews", "specifications") if c in corpus.columns))
    return old.unionByName(add, allowMissingColumns=True)


def alias_coverage(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """Aliases owned per product (0 for products that own none)."""
    owned = index.groupBy("corpus_idx").agg(F.count("*").alias("n_aliases"))
    return corpus.select("corpus_idx").join(owned, "corpus_idx", "left").select(
        "corpus_idx", F.coalesce("n_aliases", F.lit(0)).cast("bigint").alias("n_aliases"))


def comment_projection(comments: DataFrame) -> DataFrame:
    """A5: body (fallback text, else ''), ups (fallback upvotes; non-int -> 0), post title if set."""
    body = F.coalesce(F.when(F.col("body") != "", F.col("body")), F.when(F.col("text") != "", F.col("text")), F.lit(""))
    ups_raw = F.when(F.col("ups").isNotNull(), F.col("ups")).otherwise(F.coalesce(F.col("upvotes"), F.lit("0")))
    ups = F.coalesce(F.when(ups_raw.rlike("^-?[0-9]+$"), ups_raw.try_cast("bigint")), F.lit(0).cast("bigint"))
    return comments.select("*", body.alias("clean_body"), ups.alias("clean_ups"),
                           F.when(F.coalesce(F.col("post_title"), F.lit("")) != "", F.col("post_title")).alias("clean_title"))
