"""Registered queries for the threshold study and the robustness lab."""

from __future__ import annotations

from pyspark.sql import functions as F

from revidence import dims
from revidence.operators import predict
from revidence.operators import robust as rb
from revidence.operators import thresholds as th
from revidence.plans import oracle_sql as O
from revidence.plans.analysis import analyze
from revidence.sources.bridges import v_labels, v_scored
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
dbl = O.dbl
N_TRIALS = 500
LO, HI = 0.15, 0.5


def _thr_sql(i: str, j: str) -> str:
    return f"({dbl(LO)} + {dbl(HI - LO)} * (('0x' || substr(md5({i}::VARCHAR || ':' || {j}::VARCHAR), 1, 8))::BIGINT)::DOUBLE / {dbl(float(1 << 32))})"


def _trial_sql() -> str:
    return O.with_(O.V_SCORED, O.v_labels_sql(), f"""tw AS (
  SELECT i AS trial, list_transform(range(38), lambda j: {_thr_sql('i', 'j')}) AS thr FROM range({N_TRIALS}) t(i)
)""", f"""rt AS (
  SELECT s.review_id, tw.trial, s.sub, tw.thr,
         list_filter(range(9), lambda k: {O.sigmoid('s.top[k + 1]')} > tw.thr[k + 1]) AS fired
  FROM v_scored s CROSS JOIN tw
)""", "ylab AS (SELECT review_id, list(sub_idx) AS ys FROM v_labels GROUP BY 1)", f"""tcells AS (
  SELECT rt.trial, x.sub_idx,
         (len(fired) = 0 OR len(list_intersect(fired, {O.parents_list()}[x.sub_idx + 1])) > 0)
           AND {O.sigmoid('rt.sub[x.sub_idx + 1]')} > rt.thr[9 + x.sub_idx + 1] AS pred,
         coalesce(list_contains(ylab.ys, x.sub_idx), false) AS y
  FROM rt LEFT JOIN ylab USING (review_id) CROSS JOIN (SELECT unnest(range(29)) AS sub_idx) x
)""", f"""tsc AS (
  SELECT trial, avg({O.sdiv('tp', 'tp + fp')}) AS ap, avg({O.sdiv('tp', 'tp + fn')}) AS ar FROM (
    SELECT trial, sub_idx, sum((y AND pred)::INTEGER) AS tp, sum((NOT y AND pred)::INTEGER) AS fp,
           sum((y AND NOT pred)::INTEGER) AS fn FROM tcells GROUP BY 1, 2) c GROUP BY trial
)""", """tobj AS (
  SELECT trial, ap, ar, CASE WHEN ar < 0.75 THEN ar - 1 ELSE ap END AS op, CASE WHEN ar < 0.75 THEN ar - 1 ELSE ar END AS orc FROM tsc
)""")


def scores_df(spark, d):
    counts = th.trial_counts(v_scored(spark, d), th.labels_dense(v_labels(spark, d)), N_TRIALS, lo=LO, hi=HI)
    return th.trial_scores(counts)


def _ts_out(df):
    return df.select(F.col("trial").cast("bigint").alias("trial"), R6("aspect_precision").alias("aspect_precision"),
                     R6("aspect_recall").alias("aspect_recall"), R6("obj_precision").alias("obj_precision"),
                     R6("obj_recall").alias("obj_recall"))


TS_COLS = ("SELECT trial::BIGINT AS trial, round(ap, 6) AS aspect_precision, round(ar, 6) AS aspect_recall, "
           "round(op, 6) AS obj_precision, round(orc, 6) AS obj_recall FROM tobj")


@register("trial_scores", _trial_sql() + TS_COLS)
def q_trial_scores(spark, d):
    return _ts_out(scores_df(spark, d))


@register("trial_penalty", _trial_sql() + "SELECT trial::BIGINT AS trial, ar < 0.75 AS penalised, round(op, 6) AS obj_precision FROM tobj")
def q_trial_penalty(spark, d):
    s = scores_df(spark, d)
    return s.select(F.col("trial").cast("bigint").alias("trial"), (F.col("aspect_recall") < 0.75).alias("penalised"),
                    R6("obj_precision").alias("obj_precision"))


@register("pareto_front", _trial_sql() + TS_COLS + """ t WHERE NOT EXISTS (
  SELECT 1 FROM tobj o WHERE o.op >= t.op AND o.orc >= t.orc AND (o.op > t.op OR o.orc > t.orc))""")
def q_pareto_front(spark, d):
    return _ts_out(th.pareto_front_2d(scores_df(spark, d), "obj_precision", "obj_recall"))


#: Six objectives of a trial: macro precision and recall over three groups of sub-aspects.
GROUPS = 3
OBJECTIVES = [f"{m}{g}" for g in range(GROUPS) for m in ("precision", "recall")]


@register("pareto_front_nd", _trial_sql() + ", six AS (SELECT trial::BIGINT AS trial, " + ", ".join(
    f"round(avg({O.sdiv('tp', 'tp + ' + other)}) FILTER (sub_idx % {GROUPS} = {g}), 9) AS {m}{g}" for g in range(GROUPS) for m, other in (("precision", "fp"), ("recall", "fn")))
    + """ FROM (SELECT trial, sub_idx, sum((y AND pred)::INTEGER) AS tp, sum((NOT y AND pred)::INTEGER) AS fp,
    sum((y AND NOT pred)::INTEGER) AS fn FROM tcells GROUP BY 1, 2) c GROUP BY trial)
SELECT trial, """ + ", ".join(f"round({o}, 6) AS {o}" for o in OBJECTIVES) + " FROM six t WHERE NOT EXISTS (SELECT 1 FROM six o WHERE "
    + " AND ".join(f"o.{o} >= t.{o}" for o in OBJECTIVES) + " AND (" + " OR ".join(f"o.{o} > t.{o}" for o in OBJECTIVES) + "))")
def q_pareto_front_nd(spark, d):
    from revidence.operators.evaluate import prf
    counts = th.trial_counts(v_scored(spark, d), th.labels_dense(v_labels(spark, d)), N_TRIALS, lo=LO, hi=HI)
    pr, rc, _ = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    here = lambda x, g: F.avg(F.when(F.col("sub_idx") % GROUPS == g, x))
    six = counts.groupBy("trial").agg(*[F.round(here(x, g), 9).alias(f"{m}{g}") for g in range(GROUPS) for m, x in (("precision", pr), ("recall", rc))])
    return th.pareto_front(six, OBJECTIVES).select("trial", *[R6(o).alias(o) for o in OBJECTIVES])


@register("threshold_candidates", O.with_(O.v_labels_sql()) + f"""SELECT i::BIGINT AS trial, j::INTEGER AS class_idx,
  round({_thr_sql('i', 'j')}, 6) AS thr, coalesce(s.n, 0)::BIGINT AS class_support
FROM range({N_TRIALS}) t(i) CROSS JOIN range(38) c(j)
LEFT JOIN (SELECT sub_idx + 9 AS cls, count(*) AS n FROM v_labels GROUP BY 1) s ON s.cls = j""")
def q_threshold_candidates(spark, d):
    c = th.threshold_candidates(spark, N_TRIALS, LO, HI)
    sup = v_labels(spark, d).groupBy((F.col("sub_idx") + 9).alias("class_idx")).agg(F.count("*").alias("n"))
    return (c.join(sup, "class_idx", "left")
            .select(F.col("trial").cast("bigint").alias("trial"), "class_idx", R6("thr").alias("thr"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("class_support")))


@register("trials_load", _trial_sql() + """SELECT tobj.trial::BIGINT AS trial, round(ap, 6) AS aspect_precision, round(ar, 6) AS aspect_recall,
  round(0.25 + tobj.trial / 1000.0, 6) AS duration_s, 'COMPLETE' AS state, c::INTEGER AS class_idx, round(tw.thr[c + 1], 6) AS thr
FROM tobj JOIN tw USING (trial) CROSS JOIN range(38) x(c)""")
def q_trials_load(spark, d):
    """The study written as a CSV export under the shared checkpoint dir, read through load_trials_csv and unpivoted to a row a threshold."""
    s = scores_df(spark, d).join(th.trials_wide(th.threshold_candidates(spark, N_TRIALS, LO, HI)), "trial")
    start = F.date_format(F.timestamp_seconds(F.lit(1767106800) + F.col("trial")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    micros = 250000 + F.col("trial") * 1000
    dur = F.concat(F.lit("0 days 00:00:00."), F.lpad(micros.cast("string"), 6, "0"))
    rows = s.select(F.col("trial").alias("number"), "aspect_precision", "aspect_recall", start.alias("datetime_start"), start.alias("datetime_complete"), dur.alias("duration"),
                    *[F.col("sub_thr")[i].alias(f"params_sub_thr_{i}") for i in range(dims.N_SUB)], *[F.col("top_thr")[i].alias(f"params_top_thr_{i}") for i in range(dims.N_TOP)],
                    F.lit("COMPLETE").alias("state"))
    path = scratch_path(spark, "trials")
    rows.write.option("header", True).csv(path)
    t = th.load_trials_csv(spark, path)
    long = th.trials_long(t)
    return t.join(long, "trial").select("trial", R6("aspect_precision").alias("aspect_precision"), R6("aspect_recall").alias("aspect_recall"),
                                        R6("duration_s").alias("duration_s"), "state", "class_idx", R6("thr").alias("thr"))


# --- robustness lab (cells of products with enough evidence) --------------------------------------

def lab_cells(spark, d):
    a = analyze(spark, v_scored(spark, d))
    return a.cells.where("pred_sub").select("product_id", "review_id", "sub_idx", "sign", "sconf", "usefulness"), a


def _lab_prefix(extra=()):
    return with_core(("pc AS (SELECT product_id, review_id, sub_idx, sign, sconf, usefulness FROM cells WHERE pred_sub)",) + tuple(extra))


def with_core(extra):
    return O.with_(O.V_SCORED, O.gate_ctes(), O.cells_ctes("gok"), O.evidence_ctes(), *extra)


REL = O.dbl_list(dims.SUB_RELIABILITY)


def _w(a=1.0, b=1.0):
    return f"(pow(sconf, {dbl(a)}) * ln(1 + {dbl(b)} * usefulness))"


def _rw_sql(src: str, keys: str, a=1.0, b=1.0) -> str:
    return (f"SELECT {keys}, sum(sign) / (count(*) + 1e-8) AS raw, "
            f"{REL}[sub_idx + 1] * sum(sign * {_w(a, b)}) / (sum({_w(a, b)}) + 1e-8) AS weighted FROM {src} GROUP BY {keys}")


@register("raw_sentiment", _lab_prefix() + "SELECT product_id, sub_idx, round(raw, 6) AS raw FROM (" + _rw_sql("pc", "product_id, sub_idx") + ") x")
def q_raw_sentiment(spark, d):
    c, _ = lab_cells(spark, d)
    return rb.raw_and_weighted(c, ["product_id", "sub_idx"]).select("product_id", "sub_idx", R6("raw").alias("raw"))


@register("reliable_sentiment", _lab_prefix() + "SELECT product_id, sub_idx, round(weighted, 6) AS weighted FROM (" + _rw_sql("pc", "product_id, sub_idx") + ") x")
def q_reliable_sentiment(spark, d):
    c, _ = lab_cells(spark, d)
    return rb.raw_and_weighted(c, ["product_id", "sub_idx"]).select("product_id", "sub_idx", R6("weighted").alias("weighted"))


@register("gain_power", _lab_prefix() + "SELECT review_id, sub_idx, round(pow(sconf, 0.5), 6) AS g FROM pc")
def q_gain_power(spark, d):
    from revidence.operators.evidence import g_power
    c, _ = lab_cells(spark, d)
    return c.select("review_id", "sub_idx", R6(g_power(F.col("sconf"), 0.5)).alias("g"))


@register("weighting_agreement", _lab_prefix() + """SELECT product_id, sub_idx, round(raw, 6) AS raw, round(weighted, 6) AS weighted,
  round(abs(raw - weighted), 6) AS disagreement,
  (CASE WHEN raw > 1e-6 THEN 1 WHEN raw < -1e-6 THEN -1 ELSE 0 END) = (CASE WHEN weighted > 1e-6 THEN 1 WHEN weighted < -1e-6 THEN -1 ELSE 0 END) AS sign_equal
FROM (""" + _rw_sql("pc", "product_id, sub_idx") + ") x")
def q_weighting_agreement(spark, d):
    c, _ = lab_cells(spark, d)
    r = rb.weighting_agreement(c)
    return r.select("product_id", "sub_idx", R6("raw").alias("raw"), R6("weighted").alias("weighted"),
                    R6("disagreement").alias("disagreement"), "sign_equal")


def _noise_sql(rates=(0.2, 0.3, 0.4), a=1.0, b=1.0, n=rb.N_TRIALS) -> str:
    rl = O.dbl_list(rates)
    return f"""(SELECT product_id, sub_idx, {rl}[p_idx + 1] AS drop_rate,
    sum(raw * raw) / {n}.0 - pow(sum(raw) / {n}.0, 2) AS raw_var, sum(weighted * weighted) / {n}.0 - pow(sum(weighted) / {n}.0, 2) AS weighted_var
  FROM ({_rw_sql(f'''(SELECT pc.*, k // {n} AS p_idx, k % {n} AS trial FROM pc CROSS JOIN range({len(rates) * n}) r(k)
        WHERE ((review_id * 7919 + (k % {n}) * 104729 + (k // {n}) * 15485863) % {rb.KEEP_MOD})::DOUBLE / {dbl(rb.KEEP_MOD)} > {rl}[k // {n} + 1]) e''',
                        'product_id, sub_idx, p_idx, trial', a, b)}) per GROUP BY product_id, sub_idx, p_idx)"""


@register("noise_robustness", _lab_prefix() + "SELECT product_id, sub_idx, round(drop_rate, 6) AS drop_rate, round(raw_var, 6) AS raw_var, "
          "round(weighted_var, 6) AS weighted_var FROM " + _noise_sql() + " v")
def q_noise_robustness(spark, d):
    c, _ = lab_cells(spark, d)
    r = rb.noise_robustness(c)
    return r.select("product_id", "sub_idx", R6("drop_rate").alias("drop_rate"), R6("raw_var").alias("raw_var"),
                    R6("weighted_var").alias("weighted_var"))


def _drift_sql(a=1.0, b=1.0) -> str:
    return f"""(SELECT coalesce(c.product_id, n.product_id) AS product_id, coalesce(c.sub_idx, n.sub_idx) AS sub_idx,
    abs(coalesce(c.s, 0) / (coalesce(c.n, 0) + 1e-8) - (coalesce(c.s, 0) + coalesce(n.s, 0)) / (coalesce(c.n, 0) + coalesce(n.n, 0) + 1e-8)) AS raw_drift,
    abs({REL}[coalesce(c.sub_idx, n.sub_idx) + 1] * (coalesce(c.sw, 0) / (coalesce(c.w, 0) + 1e-8)
        - (coalesce(c.sw, 0) + coalesce(n.sw, 0)) / (coalesce(c.w, 0) + coalesce(n.w, 0) + 1e-8))) AS weighted_drift
  FROM (SELECT product_id, sub_idx, sum(sign) AS s, count(*) AS n, sum(sign * {_w(a, b)}) AS sw, sum({_w(a, b)}) AS w FROM pc GROUP BY 1, 2) c
  FULL OUTER JOIN (SELECT product_id, sub_idx, sum(s) AS s, count(*) AS n, sum(s * w) AS sw, sum(w) AS w FROM nr GROUP BY 1, 2) n
  ON c.product_id = n.product_id AND c.sub_idx = n.sub_idx)"""


NOISE_CTES = (f"""nz AS (SELECT p.product_id, i, (i * 13 + p.product_id * 7) % {rb.MAX_ACTIVE} + 1 AS k
  FROM (SELECT DISTINCT product_id FROM pc) p CROSS JOIN range({rb.N_NOISE}) r(i))""",
              f"""nr AS (SELECT product_id, sub_idx::INTEGER AS sub_idx, CASE WHEN (i * 13 + sub_idx * 7) % 2 = 0 THEN 1 ELSE -1 END AS s,
  {dbl(0.01)} + {dbl(0.04)} * ((i * 37 + sub_idx * 101) % 97)::DOUBLE / {dbl(97.0)} AS w
  FROM nz CROSS JOIN (SELECT unnest(range(29)) AS sub_idx) x WHERE (sub_idx * 17 + i * 31 + product_id) % 29 < k)""")


@register("adversarial_drift", _lab_prefix(NOISE_CTES) + "SELECT product_id, sub_idx::INTEGER AS sub_idx, round(raw_drift, 6) AS raw_drift, "
          "round(weighted_drift, 6) AS weighted_drift FROM " + _drift_sql() + " d")
def q_adversarial_drift(spark, d):
    c, _ = lab_cells(spark, d)
    r = rb.adversarial_drift(c)
    return r.select("product_id", F.col("sub_idx").cast("int").alias("sub_idx"), R6("raw_drift").alias("raw_drift"),
                    R6("weighted_drift").alias("weighted_drift"))


@register("source_consistency", _lab_prefix() + """SELECT sub_idx, count(*) AS n_sources,
  round(avg((sgn = first_sgn)::INTEGER), 6) AS agreement_rate FROM (
  SELECT *, first_value(sgn) OVER (PARTITION BY sub_idx ORDER BY source) AS first_sgn FROM (
    SELECT source, sub_idx, CASE WHEN weighted > 1e-6 THEN 1 WHEN weighted < -1e-6 THEN -1 ELSE 0 END AS sgn FROM (
      """ + _rw_sql("(SELECT *, product_id % 3 AS source FROM pc) s", "source, sub_idx") + """) a) b) c GROUP BY sub_idx""")
def q_source_consistency(spark, d):
    c, _ = lab_cells(spark, d)
    r = rb.source_consistency(c, F.col("product_id") % 3)
    return r.select("sub_idx", "n_sources", R6("agreement_rate").alias("agreement_rate"))


GRID_A, GRID_B = (0.5, 1.0), (0.5, 1.0)


def _grid_sql() -> str:
    parts = []
    for a in GRID_A:
        for b in GRID_B:
            parts.append(f"""SELECT 'a{a}_b{b}' AS config_id, {dbl(a)} AS alpha, {dbl(b)} AS beta,
  (SELECT avg(raw_var) FROM {_noise_sql((0.3,), a, b)} v) AS raw_var_p30,
  (SELECT avg(weighted_var) FROM {_noise_sql((0.3,), a, b)} v) AS weighted_var_p30,
  (SELECT avg(raw_drift) FROM {_drift_sql(a, b)} d) AS raw_drift,
  (SELECT avg(weighted_drift) FROM {_drift_sql(a, b)} d) AS weighted_drift,
  (SELECT avg(abs(raw - weighted)) FROM ({_rw_sql('pc', 'product_id, sub_idx', a, b)}) x) AS disagreement_mag,
  (SELECT bool_and((CASE WHEN raw > 1e-6 THEN 1 WHEN raw < -1e-6 THEN -1 ELSE 0 END) = (CASE WHEN weighted > 1e-6 THEN 1 WHEN weighted < -1e-6 THEN -1 ELSE 0 END))
     FROM ({_rw_sql('pc', 'product_id, sub_idx', a, b)}) x) AS agreement_ok""")
    return _lab_prefix(NOISE_CTES) + ", grid AS (" + "\nUNION ALL\n".join(parts) + ")\n"


GRID_COLS = ("config_id, alpha, beta, round(raw_var_p30, 6) AS raw_var_p30, round(weighted_var_p30, 6) AS weighted_var_p30, "
             "round(raw_drift, 6) AS raw_drift, round(weighted_drift, 6) AS weighted_drift, "
             "round(disagreement_mag, 6) AS disagreement_mag, agreement_ok")


def _grid_out(g):
    return g.select("config_id", "alpha", "beta", *[R6(c).alias(c) for c in
                    ("raw_var_p30", "weighted_var_p30", "raw_drift", "weighted_drift", "disagreement_mag")], "agreement_ok")


@register("weighting_grid", _grid_sql() + "SELECT " + GRID_COLS + " FROM grid")
def q_weighting_grid(spark, d):
    c, _ = lab_cells(spark, d)
    return _grid_out(rb.weighting_grid(c, GRID_A, GRID_B))


@register("select_weighting", _grid_sql() + "SELECT config_id, (weighted_var_p30 < raw_var_p30 AND weighted_drift < raw_drift AND agreement_ok) AS selected FROM grid")
def q_select_weighting(spark, d):
    c, _ = lab_cells(spark, d)
    return rb.select_weighting(rb.weighting_grid(c, GRID_A, GRID_B))


@register("confidence_dispersion", O.with_(O.V_SCORED, O.gate_ctes(), O.cells_ctes("gok"), O.evidence_ctes()) + f""", s1 AS (
  SELECT product_id, sub_idx, CASE WHEN {REL}[sub_idx + 1] * s_num / (s_den + 1e-8) > 1e-6 THEN 1
         WHEN {REL}[sub_idx + 1] * s_num / (s_den + 1e-8) < -1e-6 THEN -1 ELSE 0 END AS S FROM agg
), a2 AS (
  SELECT w.product_id, w.sub_idx, s1.S, sum(sign * w.w) AS ssw, sum(abs(sign * w.w)) AS aw, sum(ln(1 + 0.6 * usefulness)) AS vol,
         sum(usefulness * CASE WHEN s1.S <> sign THEN 1.0 ELSE 1e-8 END) AS dn, sum(usefulness) AS dd
  FROM wcells w JOIN s1 USING (product_id, sub_idx) GROUP BY 1, 2, 3
)
SELECT product_id, sub_idx, S AS sign, round(dn / (dd + 1e-8), 6) AS dispersion,
  round(100 * pow((0.65 + 0.35 * pow({REL}[sub_idx + 1], 0.8)) * (abs(ssw) / (aw + 1e-8)) * (1 - exp(-vol / 24.0)) * (1 - dn / (dd + 1e-8)), 0.2), 6) AS confidence
FROM a2""")
def q_confidence_dispersion(spark, d):
    a = analyze(spark, v_scored(spark, d))
    r = rb.confidence_dispersion(a.cells, a.medians)
    return r.select("product_id", "sub_idx", F.col("sign").cast("int").alias("sign"), R6("dispersion").alias("dispersion"),
                    R6("confidence").alias("confidence"))


def _prior_sql() -> str:
    return f"list_sum(list_transform({O.parents_list()}[s + 1], lambda t: {O.sigmoid('top[t + 1]')}))"


@register("gate_logits", O.with_(O.V_SCORED) + f"""SELECT review_id, s::INTEGER AS sub_idx,
  round(sub[s + 1] + 0.5 * least(greatest({_prior_sql()}, 0.0), 1.0), 6) AS gated_add,
  round(sub[s + 1] * (1 + 0.4 * {_prior_sql()}), 6) AS gated_mul
FROM v_scored CROSS JOIN (SELECT unnest(range(29)) AS s) x""")
def q_gate_logits(spark, d):
    s = v_scored(spark, d)
    parents = dims.parents_col()
    e = s.select("review_id", "top", F.posexplode(F.arrays_zip(F.col("sub").alias("x"), parents.alias("par"))).alias("sub_idx", "z"))
    prior = F.aggregate(F.transform(F.col("z.par"), lambda t: predict.sigmoid(F.get(F.col("top"), t))), F.lit(0.0),
                        lambda acc, v: acc + v)
    return e.select("review_id", F.col("sub_idx").cast("int").alias("sub_idx"),
                    R6(predict.gate_logits(F.col("z.x"), prior, 0.5, "add", clamp=True)).alias("gated_add"),
                    R6(predict.gate_logits(F.col("z.x"), prior, 0.4, "mul", clamp=False)).alias("gated_mul"))
