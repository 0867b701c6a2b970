"""Registered queries for evaluation and label operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from revidence import dims
from revidence.operators import evaluate as ev
from revidence.operators import predict
from revidence.operators import thresholds as th
from revidence.plans import oracle_sql as O
from revidence.sources.bridges import table, v_label_records, v_labels, v_scored
from revidence.sources.ingest import scratch_path

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
D = O.sdiv


def eval_cells(spark, d):
    """All 29 cells of every scored review with gold labels (y, y_sent3, y_comp) and 3-way preds."""
    s = v_scored(spark, d)
    cells = predict.decode_cells(s, keep=("product_id", "usefulness"))
    lab = v_labels(spark, d).select("review_id", "sub_idx", "y_sent", "y_comp", F.lit(1).alias("y"))
    c = cells.join(lab, ["review_id", "sub_idx"], "left")
    p3 = F.when(F.col("delta") > 0, 1).when(F.col("delta") < 0, 0).otherwise(-1)
    return c.select("*", F.coalesce("y", F.lit(0)).alias("y0"), F.coalesce("y_sent", F.lit(-1)).alias("y_sent3"),
                    p3.alias("p_sent3"), F.when(F.col("pred_sub"), p3).otherwise(-1).alias("joint")).drop("y").withColumnRenamed("y0", "y")


def top_cells(spark, d):
    s = v_scored(spark, d)
    t = predict.predict_top(s)
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("review_id"), "label")
    return t.join(emb, "review_id").select("review_id", "top_idx", "p_top", "pred_top",
                                           (F.col("label") == F.col("top_idx")).alias("y"))


TOPC = f"""tc AS (
  SELECT b.vec_id AS review_id, t::INTEGER AS top_idx, {O.sigmoid('s.top[t + 1]')} > {O.dbl_list(dims.TOP_THRESHOLDS)}[t + 1] AS pred_top,
         (b.label = t) AS y
  FROM embeddings b JOIN v_scored s ON s.review_id = b.vec_id CROSS JOIN (SELECT unnest(range(9)) AS t) x
)"""


def _cm_sql(src: str, cls: str, y: str, p: str, level: str, rnd: bool = True) -> str:
    r = (lambda x: f"round({x}, 6)") if rnd else (lambda x: x)
    return f"""SELECT '{level}' AS level, {cls}::INTEGER AS class_idx,
  {r(D('tp', 'tp + fp'))} AS precision, {r(D('tp', 'tp + fn'))} AS recall,
  {r(D('2 * tp', '2 * tp + fp + fn'))} AS f1, support FROM (
  SELECT {cls}, sum(({y} AND {p})::INTEGER)::BIGINT AS tp, sum((NOT {y} AND {p})::INTEGER)::BIGINT AS fp,
         sum(({y} AND NOT {p})::INTEGER)::BIGINT AS fn, sum({y}::INTEGER)::BIGINT AS support
  FROM {src} GROUP BY {cls}) x"""


CM_SQL = (O.eval_prefix((TOPC,)) + _cm_sql("ec", "sub_idx", "(y = 1)", "pred_sub", "sub") + "\nUNION ALL\n"
          + _cm_sql("tc", "top_idx", "y", "pred_top", "top"))


def class_metrics_df(spark, d):
    c = eval_cells(spark, d)
    sub = ev.class_metrics(c.withColumn("yb", F.col("y") == 1), ["sub_idx"], "yb", "pred_sub").select(
        F.lit("sub").alias("level"), F.col("sub_idx").cast("int").alias("class_idx"), "precision", "recall", "f1", "support")
    top = ev.class_metrics(top_cells(spark, d), ["top_idx"], "y", "pred_top").select(
        F.lit("top").alias("level"), F.col("top_idx").cast("int").alias("class_idx"), "precision", "recall", "f1", "support")
    return sub.unionByName(top)


@register("class_metrics", CM_SQL)
def q_class_metrics(spark, d):
    m = class_metrics_df(spark, d)
    return m.select("level", "class_idx", R6("precision").alias("precision"), R6("recall").alias("recall"),
                    R6("f1").alias("f1"), F.col("support").cast("bigint").alias("support"))


CM_RAW = (O.eval_prefix((TOPC,)).rstrip() + ",\ncm AS (" + _cm_sql("ec", "sub_idx", "(y = 1)", "pred_sub", "sub", False)
          + "\nUNION ALL\n" + _cm_sql("tc", "top_idx", "y", "pred_top", "top", False) + ")\n")


@register("macro_metrics", CM_RAW + f"""
SELECT level, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1
FROM cm GROUP BY level""")
def q_macro_metrics(spark, d):
    m = ev.macro(class_metrics_df(spark, d), ["level"])
    return m.select("level", R6("precision").alias("precision"), R6("recall").alias("recall"), R6("f1").alias("f1"))


def _three_sql(keys: str, y: str, p: str) -> str:
    return f"""(SELECT {keys}, l, {D('tp', 'tp + fp')} AS pr, {D('tp', 'tp + fn')} AS rc, {D('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (
  SELECT {keys}, l, sum(({y} = l AND {p} = l)::INTEGER) AS tp, sum(({y} <> l AND {p} = l)::INTEGER) AS fp,
         sum(({y} = l AND {p} <> l)::INTEGER) AS fn
  FROM ec CROSS JOIN (SELECT unnest([-1, 0, 1]) AS l) L GROUP BY {keys}, l) x)"""


@register("joint_metrics", O.eval_prefix() + f"""SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1
FROM (SELECT sub_idx, avg(pr) AS p, avg(rc) AS r, avg(f1) AS f FROM {_three_sql('sub_idx', 'y_sent3', 'joint')} t GROUP BY sub_idx) a""")
def q_joint_metrics(spark, d):
    t = ev.three_way(eval_cells(spark, d), ["sub_idx"], "y_sent3", "joint")
    per = ev.macro(t, ["sub_idx"])
    return per.agg(R6(F.avg("precision")).alias("precision"), R6(F.avg("recall")).alias("recall"), R6(F.avg("f1")).alias("f1"))


@register("sample_metrics", O.eval_prefix() + f"""SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1
FROM (SELECT review_id, avg(pr) AS p, avg(rc) AS r, avg(f1) AS f FROM {_three_sql('review_id', 'y_sent3', 'joint')} t GROUP BY review_id) a""")
def q_sample_metrics(spark, d):
    t = ev.three_way(eval_cells(spark, d), ["review_id"], "y_sent3", "joint")
    per = ev.macro(t, ["review_id"])
    return per.agg(R6(F.avg("precision")).alias("precision"), R6(F.avg("recall")).alias("recall"), R6(F.avg("f1")).alias("f1"))


@register("hier_accuracy", O.eval_prefix((TOPC,)) + """SELECT round(avg((coalesce(t.ok, false) AND coalesce(s.ok, false))::INTEGER), 6) AS hier_acc
FROM (SELECT DISTINCT review_id FROM v_scored) r
LEFT JOIN (SELECT review_id, bool_or(y AND pred_top) AS ok FROM tc GROUP BY 1) t USING (review_id)
LEFT JOIN (SELECT review_id, bool_or(y = 1 AND allowed AND p_sub > 0.5) AS ok FROM ec GROUP BY 1) s USING (review_id)""")
def q_hier_accuracy(spark, d):
    t = top_cells(spark, d).groupBy("review_id").agg(F.bool_or(F.col("y") & F.col("pred_top")).alias("t_ok"))
    s = (eval_cells(spark, d).groupBy("review_id")
         .agg(F.bool_or((F.col("y") == 1) & F.col("allowed") & (F.col("p_sub") > 0.5)).alias("s_ok")))
    r = t.join(s, "review_id", "full")
    return r.agg(R6(F.avg((F.coalesce("t_ok", F.lit(False)) & F.coalesce("s_ok", F.lit(False))).cast("int"))).alias("hier_acc"))


SENT_CELLS = "ec WHERE y_sent3 <> -1 AND p_sent3 <> -1"


@register("sentiment_confusion", O.eval_prefix() + f"SELECT y_sent3 AS y, p_sent3 AS p, count(*) AS n FROM {SENT_CELLS} GROUP BY 1, 2")
def q_sentiment_confusion(spark, d):
    c = eval_cells(spark, d).where((F.col("y_sent3") != -1) & (F.col("p_sent3") != -1))
    return c.groupBy(F.col("y_sent3").alias("y"), F.col("p_sent3").alias("p")).agg(F.count("*").alias("n"))


def _present_sql(keys: str, where: str) -> str:
    sel = f"{keys}, " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {sel}round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall, round(avg(f1), 6) AS f1 FROM (
  SELECT {sel}l, {D('tp', 'tp + fp')} AS pr, {D('tp', 'tp + fn')} AS rc, {D('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (
    SELECT {sel}l, sum((y_sent3 = l AND p_sent3 = l)::INTEGER) AS tp, sum((y_sent3 <> l AND p_sent3 = l)::INTEGER) AS fp,
           sum((y_sent3 = l AND p_sent3 <> l)::INTEGER) AS fn
    FROM ec CROSS JOIN (SELECT unnest([0, 1]) AS l) L WHERE {where} GROUP BY {sel}l) x WHERE tp + fp + fn > 0) z {grp}"""


@register("sentiment_metrics", O.eval_prefix() + _present_sql("", "y_sent3 <> -1 AND p_sent3 <> -1"))
def q_sentiment_metrics(spark, d):
    c = eval_cells(spark, d).where((F.col("y_sent3") != -1) & (F.col("p_sent3") != -1))
    m = ev.present_labels_macro(c, [], "y_sent3", "p_sent3")
    return m.select(R6("precision").alias("precision"), R6("recall").alias("recall"), R6("f1").alias("f1"))


@register("aspect_sentiment_f1", O.eval_prefix() + _present_sql("sub_idx", "y_sent3 <> -1 AND p_sent3 <> -1"))
def q_aspect_sentiment_f1(spark, d):
    c = eval_cells(spark, d).where((F.col("y_sent3") != -1) & (F.col("p_sent3") != -1))
    m = ev.present_labels_macro(c, ["sub_idx"], "y_sent3", "p_sent3")
    return m.select("sub_idx", R6("precision").alias("precision"), R6("recall").alias("recall"), R6("f1").alias("f1"))


@register("pos_weights", O.eval_prefix() + "SELECT sub_idx, round((count(*) - sum(y)) / (sum(y) + 1e-6), 6) AS pos_weight FROM ec GROUP BY sub_idx")
def q_pos_weights(spark, d):
    return ev.pos_weights(eval_cells(spark, d), ["sub_idx"]).select("sub_idx", R6("pos_weight").alias("pos_weight"))


@register("holdout_split", "SELECT vec_id AS review_id, (((vec_id % 1000003) * 2654435761) % 4294967296) % 100 < 10 AS is_valid FROM embeddings")
def q_holdout_split(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("review_id"), ev.holdout_flag(F.col("vec_id")).alias("is_valid"))


@register("sampling_weights", O.with_(O.v_labels_sql()) + """SELECT l.review_id, round(max(1.0 / n.n), 6) AS w_max, round(avg(1.0 / n.n), 6) AS w_mean
FROM v_labels l JOIN (SELECT sub_idx, count(*) AS n FROM v_labels GROUP BY 1) n USING (sub_idx) GROUP BY l.review_id""")
def q_sampling_weights(spark, d):
    lab = v_labels(spark, d)
    n = lab.groupBy("sub_idx").agg(F.count("*").alias("n"))
    j = lab.join(n, "sub_idx").withColumn("w", F.lit(1.0) / F.col("n"))
    return j.groupBy("review_id").agg(R6(F.max("w")).alias("w_max"), R6(F.avg("w")).alias("w_mean"))


GRID = [round(0.05 * i, 2) for i in range(1, 20)]


@register("best_thresholds", O.eval_prefix() + f"""SELECT sub_idx, first(t ORDER BY f1 DESC, t) AS best_thr, round(max(f1), 6) AS best_f1 FROM (
  SELECT sub_idx, t, {D('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (
    SELECT sub_idx, t, sum((y = 1 AND allowed AND p_sub > t)::INTEGER) AS tp, sum((y = 0 AND allowed AND p_sub > t)::INTEGER) AS fp,
           sum((y = 1 AND NOT (allowed AND p_sub > t))::INTEGER) AS fn
    FROM ec CROSS JOIN (SELECT unnest({O.dbl_list(GRID)}) AS t) g GROUP BY 1, 2) x) z GROUP BY sub_idx""")
def q_best_thresholds(spark, d):
    b = th.best_thresholds(eval_cells(spark, d), GRID)
    return b.select("sub_idx", "best_thr", R6("best_f1").alias("best_f1"))


@register("best_thresholds_cv", O.eval_prefix() + f""", h AS (
  SELECT review_id % 5 AS fold, sub_idx, t, sum((y = 1 AND allowed AND p_sub > t)::INTEGER) AS tp, sum((y = 0 AND allowed AND p_sub > t)::INTEGER) AS fp,
         sum((y = 1 AND NOT (allowed AND p_sub > t))::INTEGER) AS fn
  FROM ec CROSS JOIN (SELECT unnest({O.dbl_list(GRID)}) AS t) g GROUP BY 1, 2, 3),
x AS (SELECT fold, sub_idx, t, tp, fp, fn, sum(tp) OVER w - tp AS rtp, sum(fp) OVER w - fp AS rfp, sum(fn) OVER w - fn AS rfn FROM h WINDOW w AS (PARTITION BY sub_idx, t)),
s AS (SELECT fold, sub_idx, t, {D('2 * rtp', '2 * rtp + rfp + rfn')} AS train_f1, {D('2 * tp', '2 * tp + fp + fn')} AS test_f1 FROM x)
SELECT fold::BIGINT AS fold, sub_idx, t AS best_thr, round(train_f1, 6) AS train_f1, round(test_f1, 6) AS test_f1 FROM s
QUALIFY row_number() OVER (PARTITION BY fold, sub_idx ORDER BY train_f1 DESC, t) = 1""")
def q_best_thresholds_cv(spark, d):
    c = eval_cells(spark, d).withColumn("fold", F.col("review_id") % 5)
    b = th.cross_validated_thresholds(c, GRID, "fold")
    return b.select("fold", "sub_idx", "best_thr", R6("train_f1").alias("train_f1"), R6("test_f1").alias("test_f1"))


@register("focal_loss", O.eval_prefix() + """, pw AS (SELECT sub_idx, (count(*) - sum(y)) / (sum(y) + 1e-6) AS pw FROM ec GROUP BY 1),
fl AS (SELECT ec.*, pw.pw * allowed::INTEGER AS w,
  greatest(least(1.0 / (1.0 + exp(-ln(p_sub / (1 - p_sub)))), 1 - 1e-8), 1e-8) AS p FROM ec JOIN pw USING (sub_idx))
SELECT round(sum(w * (y * 0.25 + (1 - y) * 0.75) * pow(1 - (y * p + (1 - y) * (1 - p)), 1.5)
       * -(y * ln(p) + (1 - y) * ln(1 - p))) / (count_if(w <> 0) + 1e-6), 6) AS focal_loss FROM fl""")
def q_focal_loss(spark, d):
    c = eval_cells(spark, d)
    pw = ev.pos_weights(c, ["sub_idx"])
    j = c.join(pw, "sub_idx").withColumn("w", F.col("pos_weight") * F.col("allowed").cast("int"))
    logit = F.log(F.col("p_sub") / (1 - F.col("p_sub")))
    loss = F.col("w") * ev.focal_terms(logit, F.col("y"))
    return j.agg(R6(F.sum(loss) / (F.count(F.when(F.col("w") != 0, 1)) + F.lit(1e-6))).alias("focal_loss"))


def _bce_sql(x: str, y: str, pw: str) -> str:
    ls = f"(-ln(1 + exp(-abs({x}))) + least({x}, 0.0))"
    l1 = f"(-ln(1 + exp(-abs({x}))) + least(-({x}), 0.0))"
    return f"(-({pw} * {y} * {ls} + (1 - {y}) * {l1}))"


@register("bce_loss", O.eval_prefix() + f""", pw AS (SELECT sub_idx, (count(*) - sum(y)) / (sum(y) + 1e-6) AS pw FROM ec GROUP BY 1)
SELECT round(avg({_bce_sql('ln(p_sub / (1 - p_sub))', 'y', 'pw.pw')}), 6) AS bce_loss FROM ec JOIN pw USING (sub_idx)""")
def q_bce_loss(spark, d):
    c = eval_cells(spark, d)
    pw = ev.pos_weights(c, ["sub_idx"])
    logit = F.log(F.col("p_sub") / (1 - F.col("p_sub")))
    return c.join(pw, "sub_idx").agg(R6(F.avg(ev.bce_with_logits(logit, F.col("y"), F.col("pos_weight")))).alias("bce_loss"))


@register("sentiment_loss", O.with_(O.V_SCORED, O.v_labels_sql()) + """SELECT round(avg(
  greatest(neg, pos) + ln(exp(neg - greatest(neg, pos)) + exp(pos - greatest(neg, pos))) - CASE WHEN y_sent = 1 THEN pos ELSE neg END
  + 0.1 * greatest(0.5 - abs(pos - neg), 0.0)), 6) AS sentiment_loss
FROM (SELECT l.y_sent, s.sent[l.sub_idx + 1].neg AS neg, s.sent[l.sub_idx + 1].pos AS pos
      FROM v_labels l JOIN v_scored s USING (review_id)) x""")
def q_sentiment_loss(spark, d):
    s = v_scored(spark, d).select("review_id", "sent")
    lab = v_labels(spark, d)
    j = lab.join(s, "review_id").select("y_sent", F.get("sent", F.col("sub_idx")).alias("z"))
    return j.agg(R6(F.avg(ev.sentiment_ce(F.col("z.neg"), F.col("z.pos"), F.col("y_sent")))).alias("sentiment_loss"))


@register("comparison_loss", O.with_(O.V_SCORED, O.v_labels_sql()) + f"""SELECT round(avg({_bce_sql('x', 'y_comp', '1.0')}), 6) AS comparison_loss
FROM (SELECT l.y_comp, s.comp[l.sub_idx + 1] AS x FROM v_labels l JOIN v_scored s USING (review_id)) z""")
def q_comparison_loss(spark, d):
    s = v_scored(spark, d).select("review_id", "comp")
    lab = v_labels(spark, d)
    j = lab.join(s, "review_id").select("y_comp", F.get("comp", F.col("sub_idx")).alias("x"))
    return j.agg(R6(F.avg(ev.bce_with_logits(F.col("x"), F.col("y_comp")))).alias("comparison_loss"))


def _sibling_sql() -> str:
    return O.with_(O.V_SCORED, O.v_labels_sql(), f"tx AS {O.taxonomy_sql()}") + """, nsub AS (SELECT top_idx, count(*) AS ns FROM tx GROUP BY 1 HAVING count(*) >= 2),
rows AS (SELECT b.vec_id AS review_id, b.label AS top_idx FROM embeddings b JOIN nsub ON nsub.top_idx = b.label),
cellz AS (
  SELECT r.review_id, r.top_idx, tx.sub_idx, s.sub[tx.sub_idx + 1] AS logit, (l.review_id IS NOT NULL) AS pos
  FROM rows r JOIN tx ON tx.top_idx = r.top_idx JOIN v_scored s ON s.review_id = r.review_id
  LEFT JOIN v_labels l ON l.review_id = r.review_id AND l.sub_idx = tx.sub_idx
),
pmax AS (SELECT review_id, top_idx, max(logit) AS pl FROM cellz WHERE pos GROUP BY 1, 2),
negs AS (SELECT review_id, top_idx, logit, row_number() OVER (PARTITION BY review_id, top_idx ORDER BY logit DESC) AS k
         FROM cellz WHERE NOT pos),
viol AS (SELECT n.review_id, n.top_idx, sum(greatest(0.3 - (p.pl - n.logit), 0.0)) AS v
         FROM negs n JOIN pmax p USING (review_id, top_idx) WHERE n.k <= 3 GROUP BY 1, 2),
per_top AS (SELECT v.top_idx, sum(v.v) / (count(*) * least(3, max(nsub.ns))) AS lt FROM viol v JOIN nsub USING (top_idx) GROUP BY 1)
SELECT round(avg(lt), 6) AS sibling_margin FROM per_top"""


@register("sibling_margin", _sibling_sql())
def q_sibling_margin(spark, d):
    from pyspark.sql import Window
    tx = dims.dim_taxonomy(spark)
    nsub = tx.groupBy("top_idx").agg(F.count("*").alias("ns")).where("ns >= 2")
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("review_id"), F.col("label").alias("top_idx"))
    rows = emb.join(F.broadcast(nsub), "top_idx")
    s = v_scored(spark, d).select("review_id", "sub")
    lab = v_labels(spark, d).select("review_id", "sub_idx", F.lit(True).alias("pos"))
    cz = (rows.join(F.broadcast(tx), "top_idx").join(s, "review_id")
          .select("review_id", "top_idx", "sub_idx", "ns", F.get("sub", F.col("sub_idx")).alias("logit"))
          .join(lab, ["review_id", "sub_idx"], "left").withColumn("pos", F.coalesce("pos", F.lit(False))))
    pmax = cz.where("pos").groupBy("review_id", "top_idx").agg(F.max("logit").alias("pl"))
    w = Window.partitionBy("review_id", "top_idx").orderBy(F.col("logit").desc())
    negs = cz.where(~F.col("pos")).withColumn("k", F.row_number().over(w)).where("k <= 3")
    viol = (negs.join(pmax, ["review_id", "top_idx"])
            .groupBy("review_id", "top_idx", "ns")
            .agg(F.sum(F.greatest(F.lit(0.3) - (F.col("pl") - F.col("logit")), F.lit(0.0))).alias("v")))
    per_top = viol.groupBy("top_idx").agg((F.sum("v") / (F.count("*") * F.least(F.lit(3), F.max("ns")))).alias("lt"))
    return per_top.agg(R6(F.avg("lt")).alias("sibling_margin"))


VEC_SQL = """vm AS (SELECT label, d, avg(x::DOUBLE) AS v FROM (
  SELECT label, generate_subscripts(embedding, 1) AS d, unnest(embedding) AS x FROM embeddings) z GROUP BY 1, 2),
vn AS (SELECT vm.label, vm.d, vm.v / n.nrm AS v FROM vm JOIN (SELECT label, sqrt(sum(v * v)) AS nrm FROM vm GROUP BY 1) n USING (label)),
cosm AS (SELECT a.label AS a, b.label AS b, sum(a.v * b.v) AS cos FROM vn a JOIN vn b USING (d) GROUP BY 1, 2)"""


@register("label_separability", "WITH " + VEC_SQL + """
SELECT round(avg(CASE WHEN a <> b THEN abs(cos) END), 6) AS avg_off_diag, avg(CASE WHEN a <> b THEN abs(cos) END) > 0.5 AS collapsed FROM cosm""")
def q_label_separability(spark, d):
    r = ev.label_separability(ev.label_vectors(table(spark, d, "embeddings")))
    return r.select(R6("avg_off_diag").alias("avg_off_diag"), "collapsed")


@register("ortho_penalty", "WITH " + VEC_SQL + """
SELECT round(0.1 * avg(CASE WHEN a <> b THEN cos * cos ELSE 0.0 END), 6) AS ortho_penalty FROM cosm""")
def q_ortho_penalty(spark, d):
    r = ev.ortho_penalty(ev.label_vectors(table(spark, d, "embeddings")))
    return r.select(R6("ortho_penalty").alias("ortho_penalty"))


def _records(spark, d):
    """Labelled records landed as JSON lines under the shared checkpoint dir and read from there."""
    path = scratch_path(spark, "label-records")
    v_label_records(spark, d).write.json(path)
    return ev.load_label_records(spark, path)


@register("derive_taxonomy", O.with_(O.v_labels_sql()) + "SELECT DISTINCT top_idx::INTEGER AS top_idx, sub_idx::INTEGER AS sub_idx FROM v_labels")
def q_derive_taxonomy(spark, d):
    return ev.taxonomy_from_records(_records(spark, d))


@register("taxonomy_override", O.with_(O.v_labels_sql()) + """SELECT DISTINCT top_idx, sub_idx FROM (
  SELECT top_idx::INTEGER AS top_idx, sub_idx::INTEGER AS sub_idx FROM v_labels
  UNION ALL SELECT 3, unnest(range(29))::INTEGER) x""")
def q_taxonomy_override(spark, d):
    return ev.taxonomy_override(ev.taxonomy_from_records(_records(spark, d)), top=3)


@register("normalize_labels", O.with_(O.v_labels_sql()) + """SELECT review_id, repeat('0', top_idx::INTEGER) || '1' || repeat('0', 8 - top_idx::INTEGER) AS top_hot,
  sub_idx::INTEGER AS sub_idx FROM v_labels""")
def q_normalize_labels(spark, d):
    r = _records(spark, d)
    top = F.array_join(ev.top_vector(F.col("top_cluster_ids")).cast("array<string>"), "")
    return r.select("review_id", top.alias("top_hot"), F.explode(ev.normalize_label_vector(F.col("sub_cluster_ids"))).alias("sub_idx"))


@register("dense_sparse", O.with_(O.v_labels_sql()) + """SELECT review_id, count(*) AS n_active,
  array_to_string(list_transform(range(29), lambda i: CASE WHEN list_contains(list(sub_idx), i) THEN '1' ELSE '0' END), '') AS dense
FROM v_labels GROUP BY review_id""")
def q_dense_sparse(spark, d):
    lab = v_labels(spark, d).groupBy("review_id").agg(F.collect_list(F.col("sub_idx").cast("int")).alias("idx"))
    dense = ev.dense_from_indices(F.col("idx"))
    back = ev.normalize_label_vector(dense)
    return lab.select("review_id", F.size(back).cast("bigint").alias("n_active"),
                      F.array_join(F.transform(dense, lambda x: x.cast("string")), "").alias("dense"))


SENT_MAP = {"negative": 0, "positive": 1}


@register("map_sentiments", O.with_(O.v_labels_sql()) + """SELECT review_id, sub_idx::INTEGER AS sub_idx,
  CASE (review_id + sub_idx) % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS y FROM v_labels WHERE (review_id + sub_idx) % 3 <> 2""")
def q_map_sentiments(spark, d):
    return ev.map_sentiments(_records(spark, d), SENT_MAP)


@register("weighted_sample", O.with_(O.v_labels_sql()) + """, w AS (
  SELECT l.review_id, max(1.0 / n.n) AS w FROM v_labels l JOIN (SELECT sub_idx, count(*) AS n FROM v_labels GROUP BY 1) n
  USING (sub_idx) GROUP BY l.review_id)
SELECT review_id FROM w, (SELECT avg(w) AS mw FROM w) m
WHERE ((((review_id % 1000003) * 2654435761 + 42 * 40503) % 4294967296)::DOUBLE / 4294967296.0) < least(1.0, 0.3 * w / mw)""")
def q_weighted_sample(spark, d):
    lab = v_labels(spark, d)
    n = lab.groupBy("sub_idx").agg(F.count("*").alias("n"))
    w = lab.join(n, "sub_idx").groupBy("review_id").agg(F.max(F.lit(1.0) / F.col("n")).alias("w"))
    return ev.weighted_sample(w, "review_id", "w", 0.3, seed=42).select("review_id")
