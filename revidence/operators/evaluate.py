"""Evaluation operators (J1-J10, J15-J22): metrics, weights, splits and loss audits.

Everything is counts or sums per class/label, so each metric is one grouped aggregation
with map-side combine over the long cell table; sklearn-style zero division gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revidence import dims
from revidence.operators.predict import sigmoid


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column):
    """precision, recall, f1 with zero_division=0 (f1 = 2tp / (2tp + fp + fn))."""
    tp, fp, fn = tp.cast("double"), fp.cast("double"), fn.cast("double")
    return safe_div(tp, tp + fp), safe_div(tp, tp + fn), safe_div(2 * tp, 2 * tp + fp + fn)


def class_counts(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    yy, pp = F.col(y).cast("boolean"), F.col(p).cast("boolean")
    return df.groupBy(*keys).agg(
        F.sum((yy & pp).cast("long")).alias("tp"), F.sum((~yy & pp).cast("long")).alias("fp"),
        F.sum((yy & ~pp).cast("long")).alias("fn"), F.sum(yy.cast("long")).alias("support"))


def class_metrics(df: DataFrame, keys: list[str], y: str = "y", p: str = "pred") -> DataFrame:
    """Per-class precision, recall, f1, support."""
    c = class_counts(df, keys, y, p)
    pr, rc, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select(*keys, pr.alias("precision"), rc.alias("recall"), f1.alias("f1"), "support")


def macro(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over classes."""
    return metrics.groupBy(*keys).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                      F.avg("f1").alias("f1"))


LABELS3 = (-1, 0, 1)


def three_way(df: DataFrame, keys: list[str], y: str, p: str, labels=LABELS3) -> DataFrame:
    """Macro P/R/F1 over a fixed label list per group (sklearn ``labels=..., average='macro'``)."""
    lab = F.array(*[F.lit(v) for v in labels])
    e = df.select(*keys, F.col(y).alias("y"), F.col(p).alias("p"), F.explode(lab).alias("l"))
    c = e.groupBy(*keys, "l").agg(
        F.sum(((F.col("y") == F.col("l")) & (F.col("p") == F.col("l"))).cast("long")).alias("tp"),
        F.sum(((F.col("y") != F.col("l")) & (F.col("p") == F.col("l"))).cast("long")).alias("fp"),
        F.sum(((F.col("y") == F.col("l")) & (F.col("p") != F.col("l"))).cast("long")).alias("fn"))
    pr, rc, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select(*keys, "l", pr.alias("precision"), rc.alias("recall"), f1.alias("f1"))


def present_labels_macro(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", superset=(0, 1)) -> DataFrame:
    """Macro P/R/F1 over the labels present in y or p (sklearn default ``labels=None``):
    count over a known superset of labels, then average only labels that occur."""
    lab = F.array(*[F.lit(v) for v in superset])
    e = df.select(*keys, F.col(y).alias("y"), F.col(p).alias("p"), F.explode(lab).alias("l"))
    c = e.groupBy(*keys, "l").agg(
        F.sum(((F.col("y") == F.col("l")) & (F.col("p") == F.col("l"))).cast("long")).alias("tp"),
        F.sum(((F.col("y") != F.col("l")) & (F.col("p") == F.col("l"))).cast("long")).alias("fp"),
        F.sum(((F.col("y") == F.col("l")) & (F.col("p") != F.col("l"))).cast("long")).alias("fn"))
    c = c.where(F.col("tp") + F.col("fp") + F.col("fn") > 0)
    pr, rc, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    m = c.select(*keys, pr.alias("precision"), rc.alias("recall"), f1.alias("f1"))
    return macro(m, keys)


def pos_weights(df: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """(N - n) / (n + 1e-6) per class."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(F.col(y).cast("long")).alias("n_pos")).select(
        *keys, ((F.col("n_rows") - F.col("n_pos")) / (F.col("n_pos") + F.lit(1e-6))).alias("pos_weight"))


HASH_PRIME = 1000003            # ids are reduced modulo this prime first: no 64-bit overflow for any id


def id_hash(id_col: Column, seed: int = 0) -> Column:
    """Multiplicative hash of an integer id in [0, 2^32) (identical in SQL)."""
    return ((id_col % F.lit(HASH_PRIME)) * F.lit(2654435761) + F.lit(seed * 40503)) % F.lit(4294967296)


def holdout_flag(id_col: Column, pct: int = 10) -> Column:
    """Stable hash split on the id, ``pct`` percent validation."""
    return (id_hash(id_col) % 100) < pct


def focal_terms(logit: Column, y: Column, alpha: float = 0.25, gamma: float = 1.5, eps: float = 1e-8) -> Column:
    """J16 element loss (before weights)."""
    p = F.least(F.greatest(sigmoid(logit), F.lit(eps)), F.lit(1 - eps))
    yd = y.cast("double")
    ce = -(yd * F.log(p) + (1 - yd) * F.log(1 - p))
    pt = yd * p + (1 - yd) * (1 - p)
    return (yd * alpha + (1 - yd) * (1 - alpha)) * F.pow(1 - pt, F.lit(gamma)) * ce


def bce_with_logits(logit: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    """J17/J20 element: -(pw * y * log s(x) + (1 - y) * log(1 - s(x))), written stably."""
    yd = y.cast("double")
    pw = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    log_sig = -F.log1p(F.exp(-F.abs(logit))) + F.least(logit, F.lit(0.0))
    log_one_minus = -F.log1p(F.exp(-F.abs(logit))) + F.least(-logit, F.lit(0.0))
    return -(pw * yd * log_sig + (1 - yd) * log_one_minus)


def sentiment_ce(neg: Column, pos: Column, y: Column, margin: float = 0.5, lam: float = 0.1) -> Column:
    """J19 element: 2-class cross entropy + lam * relu(margin - |delta|)."""
    m = F.greatest(neg, pos)
    lse = m + F.log(F.exp(neg - m) + F.exp(pos - m))
    chosen = F.when(y == 1, pos).otherwise(neg)
    return (lse - chosen) + F.lit(lam) * F.greatest(F.lit(margin) - F.abs(pos - neg), F.lit(0.0))


def label_vectors(emb: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label in long form (label, d, v), L2-normalised."""
    long = emb.select(label_col, F.posexplode(vec_col).alias("d", "x"))
    mean = long.groupBy(label_col, "d").agg(F.avg(F.col("x").cast("double")).alias("v"))
    norm = mean.groupBy(label_col).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nrm"))
    return mean.join(norm, label_col).select(F.col(label_col).alias("label"), "d",
                                             (F.col("v") / F.col("nrm")).alias("v"))


def cosine_pairs(vecs: DataFrame) -> DataFrame:
    """(a, b, cos) for all ordered label pairs; the pair count is labels^2 (a fixed, small set),
    built by an equi join on the dimension index."""
    a = vecs.select(F.col("label").alias("a"), "d", F.col("v").alias("va"))
    b = vecs.select(F.col("label").alias("b"), "d", F.col("v").alias("vb"))
    return a.join(b, "d").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("cos"))


def label_separability(vecs: DataFrame) -> DataFrame:
    """Mean off-diagonal |cos| and the collapse flag (> 0.5)."""
    c = cosine_pairs(vecs)
    return c.agg(F.avg(F.when(F.col("a") != F.col("b"), F.abs("cos"))).alias("avg_off_diag")).withColumn(
        "collapsed", F.col("avg_off_diag") > 0.5)


def ortho_penalty(vecs: DataFrame, lam: float = 0.1) -> DataFrame:
    """Lam * mean over all n^2 cells of the squared off-diagonal cosine."""
    c = cosine_pairs(vecs)
    return c.agg((F.lit(lam) * F.avg(F.when(F.col("a") != F.col("b"), F.col("cos") * F.col("cos")).otherwise(0.0)))
                 .alias("ortho_penalty"))


#: Labelled records as JSON lines: top_cluster_ids is one index or a 0/1 vector (kept as JSON text), sub_cluster_ids a 0/1 vector or
#: a list of indices, the maps have string keys.
LABEL_SCHEMA = ("review_id BIGINT, top_cluster_ids STRING, sub_cluster_ids ARRAY<DOUBLE>, top_to_sub_ids MAP<STRING, ARRAY<INT>>, "
                "sentiments MAP<STRING, STRING>")


def load_label_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SCHEMA).json(path)


def taxonomy_from_records(records: DataFrame) -> DataFrame:
    """Union over all records of the (top, sub) pairs in ``top_to_sub_ids``; records without the map add nothing."""
    tops = records.select(F.explode("top_to_sub_ids").alias("top", "subs"))
    return tops.select(F.col("top").cast("int").alias("top_idx"), F.explode("subs").alias("sub_idx")).distinct()


def taxonomy_override(tx: DataFrame, top: int = 3, n_sub: int = dims.N_SUB) -> DataFrame:
    """Force one top to own every sub."""
    forced = tx.select(F.lit(top).alias("top_idx"), F.explode(F.sequence(F.lit(0), F.lit(n_sub - 1))).alias("sub_idx"))
    return tx.select(F.col("top_idx").cast("int"), F.col("sub_idx").cast("int")).unionByName(
        forced.select(F.col("top_idx").cast("int"), F.col("sub_idx").cast("int"))).distinct()


def normalize_label_vector(v: Column, n: int = dims.N_SUB) -> Column:
    """A vector of length n -> positions above 0; otherwise an index list (>= 0 kept); null -> empty."""
    listed = F.transform(F.filter(v, lambda x: x.cast("int") >= 0), lambda x: x.cast("int"))
    hot = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(v, i) > 0)
    return F.coalesce(F.when(F.size(v) == n, hot).otherwise(listed), F.array().cast("array<int>"))


def top_vector(top: Column, n: int = dims.N_TOP) -> Column:
    """JSON text of one top index -> one-hot vector; of a vector -> that vector. An index outside 0..n-1 or no JSON -> null."""
    index = top.try_cast("int")
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == index).cast("int"))
    vector = F.transform(F.from_json(top, "array<double>"), lambda x: (x > 0).cast("int"))
    return F.when(index.between(0, n - 1), one_hot).when(F.ltrim(top).startswith("["), vector)


def map_sentiments(records: DataFrame, label_map: dict | None, id_col: str = "review_id") -> DataFrame:
    """(id, sub_idx, y) from the string-keyed ``sentiments``; values outside ``label_map`` are dropped, without a map all non-null stay."""
    cells = records.select(id_col, F.explode("sentiments").alias("k", "raw"))
    y = F.col("raw")
    if label_map:
        y = F.try_element_at(F.create_map(*[F.lit(x) for kv in label_map.items() for x in kv]), y)
    return cells.select(id_col, F.col("k").cast("int").alias("sub_idx"), y.alias("y")).where(F.col("y").isNotNull())


def dense_from_indices(idx: Column, n: int = dims.N_SUB) -> Column:
    """Index list -> dense 0/1 vector."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(idx, i).cast("int"))


def weighted_sample(df: DataFrame, id_col: str, weight_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """J10 sampler: keep each row with probability min(1, fraction * w / mean(w)).

    The uniform draw is a hash of (id, seed), so reruns and recomputation after executor loss
    keep the same rows; the mean weight is one aggregate joined back as a one-row table.
    """
    mean_w = df.agg(F.avg(weight_col).alias("_mw"))
    u = id_hash(F.col(id_col), seed).cast("double") / F.lit(4294967296.0)
    p = F.least(F.lit(1.0), F.lit(float(fraction)) * F.col(weight_col) / F.col("_mw"))
    return df.join(F.broadcast(mean_w), how="inner", on=F.lit(True)).where(u < p).drop("_mw")
