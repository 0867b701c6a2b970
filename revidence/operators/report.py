"""Gate, sufficiency, ranking and report assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revidence import dims
from revidence.functions import text as T
from revidence.session import cut_lineage

STATUS_OK = "ok"
STATUS_INSUFFICIENT = "insufficient_review_evidence"
STATUS_NO_REVIEWS = "no_reviews_found"
STATUS_NO_VALID = "no_valid_reviews"      # there are reviews, but none of them is long enough once cleaned


def evidence_gate(scored: DataFrame, relevance_thr: float = dims.RELEVANCE_THRESHOLD,
                  usefulness_thr: float = dims.USEFULNESS_GATE) -> DataFrame:
    """relevance > 0.7 AND usefulness > 7.0 (both strict)."""
    return scored.where((F.col("relevance") > F.lit(float(relevance_thr)))
                        & (F.col("usefulness") > F.lit(float(usefulness_thr))))


def evidence_sufficiency(products: DataFrame, gated: DataFrame,
                         min_evidence: int = dims.MIN_EVIDENCE) -> DataFrame:
    """(product_id, n_gated, status): 'ok' needs MORE than ``min_evidence`` gated reviews.

    ``products`` lists every product (with or without reviews); products with zero gated
    reviews are kept by the left join.
    """
    counts = gated.groupBy("product_id").agg(F.count("*").alias("n_gated"))
    return (products.select("product_id").distinct()
            .join(counts, "product_id", "left")
            .select("product_id", F.coalesce("n_gated", F.lit(0)).cast("bigint").alias("n_gated"))
            .withColumn("status", F.when(F.col("n_gated") > min_evidence, F.lit(STATUS_OK))
                        .otherwise(F.lit(STATUS_INSUFFICIENT))))


def sufficient(gated: DataFrame, status: DataFrame) -> DataFrame:
    ok = status.where(F.col("status") == STATUS_OK).select("product_id")
    return gated.join(ok, "product_id", "left_semi")


def primary_parent(spark: SparkSession, taxonomy=None) -> DataFrame:
    """Lowest top index that owns each sub; subs without a parent have no row."""
    tx = dims.dim_taxonomy(spark, taxonomy)
    return tx.groupBy("sub_idx").agg(F.min("top_idx").alias("top_idx"))


def top_k(df: DataFrame, part: list[str], k: int, order=None) -> DataFrame:
    """k best rows per group by usefulness desc, review_id desc (plans to WindowGroupLimit,
    which pre-limits each map partition, so a hot group ships at most k rows per partition)."""
    order = order or [F.col("usefulness").desc(), F.col("review_id").desc()]
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_reviews(gated_ok: DataFrame, k: int = dims.TOP_REVIEWS_COUNT) -> DataFrame:
    return top_k(gated_ok.select("product_id", "review_id", "usefulness", *(
        ["text"] if "text" in gated_ok.columns else [])), ["product_id"], k)


def supporting_reviews(cells: DataFrame, k: int = dims.SUB_ASPECT_REVIEWS_COUNT,
                       usefulness_thr: float = dims.REVIEW_USEFULNESS_THRESHOLD) -> DataFrame:
    """Per (product, sub): predicted cells with usefulness > 8.0, best k."""
    c = cells.where(F.col("pred_sub") & (F.col("usefulness") > F.lit(float(usefulness_thr))))
    return top_k(c.select("product_id", "sub_idx", "review_id", "usefulness"), ["product_id", "sub_idx"], k)


def evidence_listing(cells: DataFrame, usefulness_thr: float = 8.75) -> DataFrame:
    """Uncapped evidence: every predicted cell above the usefulness threshold."""
    return cells.where(F.col("pred_sub") & (F.col("usefulness") > F.lit(float(usefulness_thr)))).select(
        "product_id", "sub_idx", "review_id", "usefulness")


def sub_aspect_rows(spark: SparkSession, evidence: DataFrame, taxonomy=None) -> DataFrame:
    """Report rows: skip confidence 0, positive iff sign > 0, half-even rounding,
    placed under the primary parent."""
    names_sub = dims.dim_sub(spark).select("sub_idx", F.col("sub_name").alias("sub_aspect_name"))
    names_top = dims.dim_top(spark).select("top_idx", F.col("top_name").alias("top_aspect_name"))
    pp = primary_parent(spark, taxonomy)
    ev = evidence.where(F.col("confidence") != 0.0)
    return (ev.join(F.broadcast(pp), "sub_idx")
            .join(F.broadcast(names_sub), "sub_idx")
            .join(F.broadcast(names_top), "top_idx")
            .select("product_id", F.col("top_idx").cast("int").alias("top_idx"), "top_aspect_name",
                    F.col("sub_idx").cast("int").alias("sub_idx"), "sub_aspect_name",
                    F.when(F.col("sign") > 0, F.lit("positive")).otherwise(F.lit("negative"))
                    .alias("sub_aspect_sentiment"),
                    F.bround("confidence", 0).cast("bigint").alias("sub_aspect_confidence"),
                    F.round("confidence", 6).alias("confidence")))


def _pad_tops() -> F.Column:
    return F.sequence(F.lit(0), F.lit(dims.N_TOP - 1))


def with_texts(ranked: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Late materialisation: ids go through the ranking, and the texts of (product_id, review_id, text) are joined to the kept rows only. Kept
    rows are few (5 a product, 3 a sub-aspect), so the texts are filtered by them before any text is shuffled. With raw_text in the place of text,
    the kept rows' texts are cleaned here. Without ``texts`` text is null."""
    if texts is None:
        return ranked if "text" in ranked.columns else ranked.withColumn("text", F.lit(None).cast("string"))
    kept = cut_lineage(ranked.drop("text"))
    one = texts.join(kept.select("product_id", "review_id").distinct(), ["product_id", "review_id"], "left_semi")
    text = T.clean_text(F.col("raw_text")) if "raw_text" in texts.columns else F.col("text")
    one = one.select("product_id", "review_id", text.alias("text"))
    return kept.join(one, ["product_id", "review_id"], "left")


def report_parts(spark: SparkSession, a, flat_specs: DataFrame | None, texts: DataFrame | None = None):
    """Shared pieces of the report: top reviews, supporting reviews (both with their texts), sub rows, spec fusion."""
    top = with_texts(top_reviews(a.gated_ok), texts)
    support = with_texts(supporting_reviews(a.cells).join(a.sub_rows.select("product_id", "sub_idx"),
                                                          ["product_id", "sub_idx"], "left_semi"), texts)
    specs = None
    if flat_specs is not None:
        ds = dims.dim_spec(spark)
        specs = flat_specs.join(F.broadcast(ds), "spec_key").select("product_id", "top_idx", "ord", "spec_key",
                                                                     "spec_value")
    return top, support, specs


#: A review in a report.
REVIEW = "struct<review_id:bigint,text:string,usefulness:double>"


def build_report(spark: SparkSession, a, flat_specs: DataFrame | None = None, names: DataFrame | None = None,
                 product_type: str = "Latest Smartphones", texts: DataFrame | None = None) -> DataFrame:
    """One nested row per product; ``texts`` (product_id, review_id, text) are the reviews' texts. Every collect below is bounded (<= 5 top reviews,
    <= 29 subs x 3 supporting reviews, <= 11 spec keys per aspect, 9 aspects)."""
    top, support, specs = report_parts(spark, a, flat_specs, texts)
    sup = (support.groupBy("product_id", "sub_idx")
           .agg(F.sort_array(F.collect_list(F.struct("rank", "review_id", "text", "usefulness"))).alias("sr")))
    subs = (a.sub_rows.join(sup, ["product_id", "sub_idx"], "left")
            .groupBy("product_id", "top_idx")
            .agg(F.sort_array(F.collect_list(F.struct(
                "sub_idx", "sub_aspect_name", "sub_aspect_sentiment", "sub_aspect_confidence",
                F.coalesce(F.transform("sr", lambda x: x.dropFields("rank")),
                           F.array().cast(f"array<{REVIEW}>"))
                .alias("supporting_reviews")))).alias("subs")))
    status = a.status
    ok = status.where(F.col("status") == STATUS_OK).select("product_id")
    grid = ok.select("product_id", F.explode(_pad_tops()).alias("top_idx"))
    tnames = dims.dim_top(spark).select("top_idx", F.col("top_name").alias("top_aspect_name"))
    g = grid.join(F.broadcast(tnames), "top_idx").join(subs, ["product_id", "top_idx"], "left")
    if specs is not None:
        sp = (specs.groupBy("product_id", "top_idx")
              .agg(F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("ord", "spec_key", "spec_value"))),
                                                  lambda x: F.struct(x["spec_key"], x["spec_value"]))).alias("specifications")))
        g = g.join(sp, ["product_id", "top_idx"], "left")
    else:
        g = g.withColumn("specifications", F.lit(None).cast("map<string,string>"))
    by_top = lambda l, r: F.when(l["top_idx"] < r["top_idx"], -1).when(l["top_idx"] > r["top_idx"], 1).otherwise(0)  # noqa: E731,E741
    summary = (g.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(
        "top_idx", "top_aspect_name",
        F.coalesce(F.transform("subs", lambda x: x.dropFields("sub_idx")),
                   F.array().cast("array<struct<sub_aspect_name:string,sub_aspect_sentiment:string,"
                                  f"sub_aspect_confidence:bigint,supporting_reviews:array<{REVIEW}>>>")).alias("sub_aspects"),
        F.coalesce("specifications", F.create_map().cast("map<string,string>")).alias("specifications"))), by_top).alias("ps")))
    tops = (top.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("rank", "review_id", "text", "usefulness")))
                                          .alias("tr")))
    out = (status.join(summary, "product_id", "left").join(tops, "product_id", "left"))
    if names is not None:
        out = out.join(names, "product_id", "left")
    else:
        out = out.withColumn("name", F.col("product_id").cast("string"))
    return out.select(
        "product_id",
        F.struct(F.col("name").alias("product_name"), F.lit(product_type).alias("product_type")).alias("product_info"),
        F.coalesce(F.transform("tr", lambda x: x.dropFields("rank")),
                   F.array().cast(f"array<{REVIEW}>")).alias("top_reviews"),
        F.coalesce(F.transform("ps", lambda x: x.dropFields("top_idx")),
                   F.array().cast("array<struct<top_aspect_name:string,sub_aspects:array<struct<sub_aspect_name:string,"
                                  f"sub_aspect_sentiment:string,sub_aspect_confidence:bigint,supporting_reviews:array<{REVIEW}>>>,"
                                  "specifications:map<string,string>>>"))
        .alias("product_summary"),
        "status")


def report_long(spark: SparkSession, a, flat_specs: DataFrame | None, texts: DataFrame | None = None) -> DataFrame:
    """Flat, hashable form of the report: 9 rows per ok product, one row per other product. Texts appear by their md5."""
    top, support, specs = report_parts(spark, a, flat_specs, texts)
    seen = F.concat_ws("=", F.col("review_id").cast("string"), F.md5("text"))
    sup = (support.groupBy("product_id", "sub_idx")
           .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", seen.alias("seen")))),
                                         lambda x: x["seen"]), ",").alias("sr")))
    sub_txt = F.concat_ws(":", "sub_aspect_name", "sub_aspect_sentiment",
                          F.col("sub_aspect_confidence").cast("string"), F.coalesce("sr", F.lit("")))
    subs = (a.sub_rows.join(sup, ["product_id", "sub_idx"], "left")
            .groupBy("product_id", "top_idx")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sub_idx", sub_txt.alias("t")))),
                                          lambda x: x["t"]), "|").alias("sub_aspects")))
    sp = (specs.groupBy("product_id", "top_idx")
          .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
              "ord", F.concat_ws("=", "spec_key", "spec_value").alias("t")))), lambda x: x["t"]), ";")
               .alias("specifications")))
    ntop = top.groupBy("product_id").agg(F.count("*").alias("n_top_reviews"), F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("rank", seen.alias("seen")))), lambda x: x["seen"]), ",").alias("top_reviews"))
    ok = a.status.where(F.col("status") == STATUS_OK).select("product_id")
    grid = ok.select("product_id", F.explode(_pad_tops()).alias("top_idx"))
    tnames = dims.dim_top(spark).select("top_idx", F.col("top_name").alias("top_aspect_name"))
    rows_ok = (grid.join(F.broadcast(tnames), "top_idx")
               .join(subs, ["product_id", "top_idx"], "left").join(sp, ["product_id", "top_idx"], "left")
               .join(ntop, "product_id", "left")
               .select("product_id", F.lit(STATUS_OK).alias("status"), F.col("top_idx").cast("int").alias("top_idx"),
                       "top_aspect_name", F.coalesce("sub_aspects", F.lit("")).alias("sub_aspects"),
                       F.coalesce("specifications", F.lit("")).alias("specifications"),
                       F.coalesce("n_top_reviews", F.lit(0)).cast("bigint").alias("n_top_reviews"),
                       F.coalesce("top_reviews", F.lit("")).alias("top_reviews")))
    rows_other = a.status.where(F.col("status") != STATUS_OK).select(
        "product_id", "status", F.lit(None).cast("int").alias("top_idx"), F.lit(None).cast("string").alias("top_aspect_name"),
        F.lit(None).cast("string").alias("sub_aspects"), F.lit(None).cast("string").alias("specifications"),
        F.lit(0).cast("bigint").alias("n_top_reviews"), F.lit(None).cast("string").alias("top_reviews"))
    return rows_ok.unionByName(rows_other)


def compare_products(sub_rows: DataFrame, product_ids: list) -> DataFrame:
    """Chosen reports side by side per sub-aspect (pivot over a given, bounded id list)."""
    sel = sub_rows.where(F.col("product_id").isin(product_ids))
    signed = F.when(F.col("sub_aspect_sentiment") == "positive", F.col("sub_aspect_confidence")).otherwise(
        -F.col("sub_aspect_confidence"))
    p = (sel.groupBy("sub_idx", "sub_aspect_name").pivot("product_id", product_ids)
         .agg(F.first(signed)))
    return p.select("sub_idx", "sub_aspect_name",
                    *[F.col(str(pid)).cast("bigint").alias(f"p{pid}_signed_conf") for pid in product_ids])
