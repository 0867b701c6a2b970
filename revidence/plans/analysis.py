"""Composition of the core operators for all products at once.

    scored reviews -> gate -> sufficiency -> (cells, medians) -> evidence -> report rows

Shuffles: one count per product (sufficiency), the median refinement passes (bounded per
group), one (product, sub) aggregation, and the top-k windows. Dimension joins broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from revidence import dims
from revidence.operators import evidence as ev
from revidence.operators import predict, report
from revidence.session import cut_lineage


@dataclass
class Analysis:
    gated: DataFrame          # gated reviews of every product
    status: DataFrame         # (product_id, n_gated, status)
    gated_ok: DataFrame       # gated reviews of products with enough evidence
    cells: DataFrame          # 29 decoded cells per gated_ok review
    medians: DataFrame        # (product_id, med_c, med_u)
    evidence: DataFrame       # (product_id, sub_idx, ... confidence)
    sub_rows: DataFrame       # report rows per (product, sub)


def analyze(spark: SparkSession, scored: DataFrame, products: DataFrame | None = None,
            agreement: str = "aggregated", taxonomy=None, checkpoint: bool = True) -> Analysis:
    """Small per-product results (status, medians, evidence: at most products x 29 rows) are
    checkpointed, so every consumer (report rows, supporting reviews, report assembly) reads
    them instead of re-planning the median rounds and aggregations."""
    cut = cut_lineage if checkpoint else (lambda x: x)
    gated = report.evidence_gate(scored)
    status = cut(report.evidence_sufficiency(products if products is not None else scored, gated))
    gated_ok = report.sufficient(gated, status)
    keep = tuple(c for c in ("product_id", "usefulness") if c in gated_ok.columns)
    cells = predict.decode_cells(gated_ok, taxonomy=taxonomy, keep=keep)
    medians = ev.product_medians(gated_ok, checkpoint=checkpoint)   # read once, by the evidence below
    evid = cut(ev.sub_evidence(cells, medians, agreement=agreement))
    rows = report.sub_aspect_rows(spark, evid, taxonomy)
    return Analysis(gated, status, gated_ok, cells, medians, evid, rows)


def end_to_end(spark: SparkSession, reviews: DataFrame, products: DataFrame, flat_specs: DataFrame | None = None,
               scorer="native", text_col: str = "raw_text") -> tuple[Analysis, DataFrame, DataFrame]:
    """Raw review items -> report for every product at once (the reference's per-product pipeline).

    reviews:  (product_id, review_id, raw_text) - comments and review texts, any number per product
    products: (product_id, name)
    scorer:   "native" (deterministic stand-in, SQL-checkable) or a scorer factory for the
              Arrow-batched ``mapInPandas`` stage (see ``operators.scoring``)

    Returns (analysis, status with ``no_reviews_found`` and ``no_valid_reviews``, nested report rows). The relevance gate is
    applied before the aspect scorer runs (nothing is pushed through a Python stage), and the
    scored stage is checkpointed because every branch of the analysis reads it.
    """
    from pyspark.sql import functions as F

    from revidence.functions import text as T
    from revidence.functions.columns import computed
    from revidence.operators import scoring

    r = computed(reviews.select("product_id", "review_id", text_col), text=T.clean_text(F.col(text_col)))
    r = r.where((T.word_count(F.col("text")) > 15) & (T.ws_trim(F.col("text")) != ""))
    j = r.join(products.select("product_id", "name"), "product_id")
    j = j.select("review_id", "product_id", "text", T.prompt_text(F.col("name"), F.col("text")).alias("prompt"),
                 T.match_score(F.col("text"), F.col("name")).alias("relevance"))
    if scorer == "native":
        scored = j.select("review_id", "product_id", "relevance", *scoring.native_scores(F.col("prompt")))
    else:
        u = scoring.score_usefulness(j.select("review_id", "product_id", "relevance", "prompt"), "prompt", scorer)
        gated_in = u.where((F.col("relevance") > dims.RELEVANCE_THRESHOLD) & (F.col("usefulness") > dims.USEFULNESS_GATE))
        scored = scoring.score_aspects(gated_in, "prompt", scorer, keep_text=False)
    scored = cut_lineage(scored)
    a = analyze(spark, scored, products=products.select("product_id"))
    valid = scored.groupBy("product_id").agg(F.count("*").alias("n_valid")) if scorer == "native" else j.groupBy("product_id").agg(F.count("*").alias("n_valid"))
    raw = reviews.groupBy("product_id").agg(F.count("*").alias("n_raw"))
    status = a.status.join(valid, "product_id", "left").join(raw, "product_id", "left").withColumn(
        "status", F.when(F.col("n_valid").isNotNull(), F.col("status")).when(F.col("n_raw").isNotNull(), F.lit(report.STATUS_NO_VALID))
        .otherwise(F.lit(report.STATUS_NO_REVIEWS))).drop("n_valid", "n_raw")
    a.status = status
    rep = report.build_report(spark, a, flat_specs, names=products.select("product_id", "name"), texts=j.select("product_id", "review_id", "text"))
    return a, status, rep


def corpus_reviews(corpus: DataFrame) -> DataFrame:
    """(product_id, review_id, raw_text) of corpus records: comments first, then review texts; null texts are left out."""
    from pyspark.sql import functions as F

    parts = [(0, F.transform("reviews.comments", lambda c: c["body"])), (1, F.col("reviews.review_texts"))]
    out = None
    for origin, texts in parts:
        one = corpus.select("corpus_idx", F.posexplode(texts).alias("pos", "raw_text")).where(F.col("raw_text").isNotNull()).select(
            F.col("corpus_idx").alias("product_id"),
            (F.shiftleft("corpus_idx", 32) + F.lit(origin << 31) + F.col("pos")).alias("review_id"), "raw_text")
        out = one if out is None else out.unionByName(one)
    return out


def reports_by_name(spark: SparkSession, queries: DataFrame, index: DataFrame, corpus: DataFrame, scorer="native") -> tuple[DataFrame, DataFrame]:
    """Product names (qid, query) -> lookup -> corpus record -> reviews and specifications -> report, for all names at once.

    ``corpus`` holds records with payload (``ingest.CORPUS_SCHEMA``). Returns a row per query (qid, corpus_idx, how, status, n_gated) and the
    nested report of every product found with enough evidence. A name that nothing matches, and a record without reviews, are
    ``no_reviews_found``; reviews that are all too short are ``no_valid_reviews``. A product asked for many times is analysed once.
    """
    from pyspark.sql import functions as F

    from revidence.operators import catalog, specs

    hits = cut_lineage(catalog.lookup_product(queries, index, corpus))
    found = cut_lineage(corpus.join(hits.where(F.col("corpus_idx").isNotNull()).select("corpus_idx").distinct(), "corpus_idx", "left_semi"))
    entries = F.try_variant_get(F.try_parse_json("specifications"), "$.specification.more_specification", "array<variant>")
    docs = found.select(F.col("corpus_idx").alias("product_id"), entries.alias("entries")).where(F.col("entries").isNotNull())
    products = found.select(F.col("corpus_idx").alias("product_id"), "name")
    _, status, rep = end_to_end(spark, corpus_reviews(found), products, specs.drop_spec_keys(specs.flatten_specs(docs)), scorer)
    rows = hits.join(status.withColumnRenamed("product_id", "corpus_idx"), "corpus_idx", "left").select(
        "qid", "corpus_idx", "how", F.coalesce("status", F.lit(report.STATUS_NO_REVIEWS)).alias("status"), F.coalesce("n_gated", F.lit(0)).cast("bigint").alias("n_gated"))
    return rows, rep
