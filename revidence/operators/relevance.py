"""Product relevance over tables.

``relevance_known`` scores each review against its own product (equi join on product_id).

``attribute_products`` scores every review against a whole product catalog without a cross
join. Only pairs that can score > 0.7 matter: a substring hit (1.0) or token coverage >= 0.75
(0.9). Candidates come from equi joins that are exact supersets of those pairs:

* coverage path: a qualifying matched set must contain a "key" token of the name. Keys are
  the heavy (weight 1.0) distinct tokens when the light ones together stay below 0.75 of the
  total, else all distinct tokens;
* substring path, names of >= 3 tokens: the middle tokens occur as whole text tokens, so the
  first middle token is a key;
* substring path, names of 1-2 tokens (can match mid-word): the longest name token must lie
  inside some text token. That containment is computed once on the vocabulary (distinct text
  tokens): trigram equi join for probes of >= 3 characters, equi join on the tokens' distinct
  1- and 2-grams for shorter probes. No nested-loop join.

Candidates are then verified with the exact score; the best product per review is a
``row_number`` window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revidence.functions import text as T
from revidence.operators.catalog import short_grams
from revidence.functions.columns import computed
from revidence.session import cut_lineage


def relevance_known(reviews: DataFrame, products: DataFrame, text_col: str = "text") -> DataFrame:
    """(review_id, product_id, relevance) for each review against its own product."""
    j = reviews.join(products, "product_id")   # planner/AQE broadcast the catalog when it is small
    return j.select("review_id", "product_id", T.match_score(F.col(text_col), F.col("name")).alias("relevance"))


def _name_keys(products: DataFrame) -> DataFrame:
    """(product_id, key) equi-join keys on whole text tokens."""
    p = products.select("product_id", T.normalize_key(F.col("name")).alias("nn")).where(F.col("nn") != "")
    nt = T.tokens(F.col("nn"))
    dist = F.array_distinct(nt)
    heavy = F.filter(dist, lambda t: T.token_weight(t) >= 1.0)
    light_w = F.aggregate(F.transform(F.filter(dist, lambda t: T.token_weight(t) < 1.0), T.token_weight),
                          F.lit(0.0), lambda a, b: a + b)
    total_w = F.aggregate(F.transform(nt, T.token_weight), F.lit(0.0), lambda a, b: a + b)
    cov_keys = F.when((F.size(heavy) > 0) & (light_w < F.lit(0.75) * total_w), heavy).otherwise(dist)
    mid_key = F.when(F.size(nt) >= 3, F.array(F.get(nt, 1))).otherwise(F.array().cast("array<string>"))
    return p.select("product_id", F.explode(F.array_distinct(F.concat(cov_keys, mid_key))).alias("tok"))


def _short_name_probes(products: DataFrame) -> DataFrame:
    """(product_id, probe) for names of 1-2 tokens: the longest token (first on ties)."""
    p = products.select("product_id", T.normalize_key(F.col("name")).alias("nn")).where(F.col("nn") != "")
    nt = T.tokens(F.col("nn"))
    longest = F.aggregate(nt, F.lit(""), lambda acc, t: F.when(F.length(t) > F.length(acc), t).otherwise(acc))
    return p.where(F.size(nt) <= 2).select("product_id", longest.alias("probe"))


def _trigrams(c):
    return F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3))


#: Bytes of (token, product) pairs that are still broadcast to the reviews' tokens; with more, the tokens are shuffled.
HITS_BYTES = 16 << 20


def candidate_pairs(doc_tokens: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct (review_id, product_id) that may score > 0.7 (exact superset).

    The tokens that lead to a product are settled first, on the vocabulary, and written; as long as they are few the tokens of the
    reviews stay where they are, and only candidates are shuffled.
    """
    keys = _name_keys(products)
    probes = _short_name_probes(products)
    vocab = doc_tokens.select("tok").distinct()
    long_p = probes.where(F.length("probe") >= 3).withColumn("tri", F.substring("probe", 1, 3))
    vtri = (vocab.where(F.length("tok") >= 3)
            .select("tok", F.explode(F.array_distinct(_trigrams(F.col("tok")))).alias("tri")))
    hits_long = (vtri.join(long_p, "tri").where(F.instr(F.col("tok"), F.col("probe")) > 0)
                 .select("tok", "product_id"))
    short_p = probes.where(F.length("probe") < 3)
    vgrams = vocab.select("tok", F.explode(short_grams(F.col("tok"))).alias("probe"))
    hits_short = vgrams.join(short_p, "probe").select("tok", "product_id")
    hits = cut_lineage(keys.select("tok", "product_id").unionByName(hits_long).unionByName(hits_short).distinct())
    size = hits.agg(F.coalesce(F.sum(F.length("tok") + F.length(F.col("product_id").cast("string")) + F.lit(64)), F.lit(0))).first()[0]
    hits = F.broadcast(hits) if size <= HITS_BYTES else hits.hint("merge")
    return doc_tokens.join(hits, "tok").select("review_id", "product_id").distinct()


def attribution_pairs(reviews: DataFrame, products: DataFrame, text_col: str = "text",
                      threshold: float = 0.7, raw: bool = False) -> DataFrame:
    """All (review_id, product_id, score) with score > threshold (threshold >= 0.7).

    ``raw=True``: ``text_col`` holds raw text; its normalised cleaned form is computed with
    ``relevance_form`` (same result as cleaning then normalising, fewer regex passes).

    The normalised text is computed once and written as a reliable checkpoint (the regex cleaner is the dominant cost and
    every branch below reads the table: column pruning gives each consumer a different projection, so exchanges are not
    reused). Its distinct tokens are split off where they are used: they would be as large again as the text.
    """
    if threshold < 0.7:
        raise ValueError("candidate generation is exact only for thresholds >= 0.7")
    norm = T.relevance_form(F.col(text_col)) if raw else T.normalize_key(F.col(text_col))
    r = computed(reviews.select("review_id", text_col), tn=norm)
    r = cut_lineage(r.where(F.col("tn") != "").select("review_id", "tn"))
    doc_tokens = r.select("review_id", F.explode(F.array_distinct(F.split("tn", " "))).alias("tok"))
    cand = candidate_pairs(doc_tokens, products)
    p = products.select("product_id", T.normalize_key(F.col("name")).alias("nn"))
    both = cand.join(r.hint("merge"), "review_id").join(p, "product_id").select("review_id", "product_id", "tn", "nn")
    scored = computed(both, score=T.match_score_norm(F.col("tn"), F.col("nn")))   # once, also under the filter
    return scored.select("review_id", "product_id", "score").where(F.col("score") > F.lit(float(threshold)))


def attribute_products(reviews: DataFrame, products: DataFrame, text_col: str = "text",
                       threshold: float = 0.7, raw: bool = False) -> DataFrame:
    """Best product per review among pairs above the threshold (ties: smallest product_id)."""
    pairs = attribution_pairs(reviews, products, text_col, threshold, raw)
    w = Window.partitionBy("review_id").orderBy(F.col("score").desc(), F.col("product_id"))
    return pairs.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")
