"""Robustness lab for the weighting scheme.

Input: predicted cells (product_id, review_id, sub_idx, sign, sconf, usefulness). Every
experiment is additive per (product, sub[, trial]), so it is one grouped aggregation with
map-side combine. Random drops / injected rows use arithmetic on ids (stable and identical
in SQL); variances over trials come from sums of x and x^2 (absent trials count as 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revidence import dims
from revidence.operators.evidence import EPS, g_power, h_useful, reliability_col, robust_sign

DROP_RATES = (0.2, 0.3, 0.4)
N_TRIALS = 100
N_NOISE = 50
MAX_ACTIVE = 4
KEEP_MOD = 1000003


def lab_weight(sconf: Column, usefulness: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Lab weights: conf^alpha * log1p(beta * u)."""
    return g_power(sconf, alpha) * h_useful(usefulness, beta)


def keep_u(review_id: Column, trial: Column, p_idx: Column) -> Column:
    """Uniform in [0, 1) from (review, trial, rate); the id is reduced first so no id overflows."""
    return (((review_id % KEEP_MOD) * 7919 + trial * 104729 + p_idx * 15485863) % KEEP_MOD).cast("double") \
        / F.lit(float(KEEP_MOD))


def raw_and_weighted(cells: DataFrame, keys: list[str], alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """F7 and F8 per group: R = sum(s)/(n + eps); S = rel * sum(s w)/(sum(w) + eps)."""
    w = lab_weight(F.col("sconf"), F.col("usefulness"), alpha, beta)
    s = F.col("sign").cast("double")
    a = cells.groupBy(*keys).agg(F.sum(s).alias("ss"), F.count("*").alias("n"), F.sum(s * w).alias("ssw"),
                                 F.sum(w).alias("sw"))
    return a.select(*keys, (F.col("ss") / (F.col("n") + F.lit(EPS))).alias("raw"),
                    (reliability_col(F.col("sub_idx")) * F.col("ssw") / (F.col("sw") + F.lit(EPS))).alias("weighted"))


def noise_robustness(cells: DataFrame, drop_rates=DROP_RATES, n_trials: int = N_TRIALS,
                     alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Per (product, sub, p): population variance over trials of R and S on kept rows."""
    rates = F.array(*[F.lit(float(p)) for p in drop_rates])
    combos = F.explode(F.sequence(F.lit(0), F.lit(len(drop_rates) * n_trials - 1)))
    e = cells.select("*", combos.alias("k"))
    e = e.withColumn("p_idx", (F.col("k") / n_trials).cast("int")).withColumn("trial", F.col("k") % n_trials)
    e = e.where(keep_u(F.col("review_id"), F.col("trial"), F.col("p_idx")) > F.get(rates, F.col("p_idx")))
    per = raw_and_weighted(e, ["product_id", "sub_idx", "p_idx", "trial"], alpha, beta)
    n = F.lit(float(n_trials))
    v = per.groupBy("product_id", "sub_idx", "p_idx").agg(
        F.sum("raw").alias("s1"), F.sum(F.col("raw") * F.col("raw")).alias("s2"),
        F.sum("weighted").alias("w1"), F.sum(F.col("weighted") * F.col("weighted")).alias("w2"))
    return v.select("product_id", "sub_idx", F.get(rates, F.col("p_idx")).alias("drop_rate"),
                    (F.col("s2") / n - F.pow(F.col("s1") / n, 2)).alias("raw_var"),
                    (F.col("w2") / n - F.pow(F.col("w1") / n, 2)).alias("weighted_var"))


def noise_rows(products: DataFrame, n_noise: int = N_NOISE, max_active: int = MAX_ACTIVE) -> DataFrame:
    """J24 injected rows per product: 1..max_active active aspects, random sign, weight U(.01,.05)."""
    i = F.col("i")
    r = products.select("product_id", F.explode(F.sequence(F.lit(0), F.lit(n_noise - 1))).alias("i"))
    k = (i * 13 + F.col("product_id") * 7) % max_active + 1
    r = r.select("product_id", "i", k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(dims.N_SUB - 1))).alias("sub_idx"))
    active = ((F.col("sub_idx") * 17 + i * 31 + F.col("product_id")) % dims.N_SUB) < F.col("k")
    return r.where(active).select(
        "product_id", F.col("sub_idx").cast("int").alias("sub_idx"),
        F.when((i * 13 + F.col("sub_idx") * 7) % 2 == 0, F.lit(1)).otherwise(F.lit(-1)).alias("sign"),
        (F.lit(0.01) + F.lit(0.04) * ((i * 37 + F.col("sub_idx") * 101) % 97).cast("double") / F.lit(97.0)).alias("w"))


def adversarial_drift(cells: DataFrame, n_noise: int = N_NOISE, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """|clean - noisy| of R and S per (product, sub) after injecting noise rows."""
    w = lab_weight(F.col("sconf"), F.col("usefulness"), alpha, beta)
    clean = cells.select("product_id", "sub_idx", F.col("sign").cast("double").alias("s"), w.alias("w"))
    noise = noise_rows(cells.select("product_id").distinct(), n_noise).select(
        "product_id", "sub_idx", F.col("sign").cast("double").alias("s"), "w")
    both = clean.withColumn("is_noise", F.lit(0)).unionByName(noise.withColumn("is_noise", F.lit(1)))
    c = F.col("is_noise") == 0
    a = both.groupBy("product_id", "sub_idx").agg(
        F.sum(F.when(c, F.col("s"))).alias("cs"), F.count(F.when(c, 1)).alias("cn"),
        F.sum(F.when(c, F.col("s") * F.col("w"))).alias("csw"), F.sum(F.when(c, F.col("w"))).alias("cw"),
        F.sum("s").alias("ns"), F.count("*").alias("nn"), F.sum(F.col("s") * F.col("w")).alias("nsw"),
        F.sum("w").alias("nw"))
    rel = reliability_col(F.col("sub_idx"))
    z = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    raw_c = z("cs") / (F.col("cn") + F.lit(EPS))
    raw_n = z("ns") / (F.col("nn") + F.lit(EPS))
    w_c = rel * z("csw") / (z("cw") + F.lit(EPS))
    w_n = rel * z("nsw") / (z("nw") + F.lit(EPS))
    return a.select("product_id", "sub_idx", F.abs(raw_c - raw_n).alias("raw_drift"), F.abs(w_c - w_n).alias("weighted_drift"))


def weighting_agreement(cells: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """R, S, |R - S| and whether their signs agree, per (product, sub)."""
    r = raw_and_weighted(cells, ["product_id", "sub_idx"], alpha, beta)
    return r.select("product_id", "sub_idx", "raw", "weighted", F.abs(F.col("raw") - F.col("weighted")).alias("disagreement"),
                    (robust_sign(F.col("raw")) == robust_sign(F.col("weighted"))).alias("sign_equal"))


def source_consistency(cells: DataFrame, source: Column, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """S per (source, sub), its sign, and per sub the share of sources agreeing with the first."""
    c = cells.withColumn("source", source)
    r = raw_and_weighted(c, ["source", "sub_idx"], alpha, beta).withColumn("sgn", robust_sign(F.col("weighted")))
    first = r.groupBy("sub_idx").agg(F.min_by("sgn", "source").alias("first_sgn"))
    return (r.join(first, "sub_idx").groupBy("sub_idx")
            .agg(F.count("*").alias("n_sources"), F.avg((F.col("sgn") == F.col("first_sgn")).cast("double")).alias("agreement_rate")))


def weighting_grid(cells: DataFrame, alphas=(0.5, 1.0), betas=(0.5, 1.0), n_trials: int = N_TRIALS) -> DataFrame:
    """Per (alpha, beta) config the mean p=0.3 variances, mean drifts, mean disagreement and
    whether every sign is kept."""
    out = None
    for a in alphas:
        for b in betas:
            cid = f"a{a}_b{b}"
            v = noise_robustness(cells, (0.3,), n_trials, a, b).groupBy().agg(
                F.avg("raw_var").alias("raw_var_p30"), F.avg("weighted_var").alias("weighted_var_p30"))
            dr = adversarial_drift(cells, N_NOISE, a, b).groupBy().agg(
                F.avg("raw_drift").alias("raw_drift"), F.avg("weighted_drift").alias("weighted_drift"))
            ag = weighting_agreement(cells, a, b).groupBy().agg(
                F.avg("disagreement").alias("disagreement_mag"), F.bool_and("sign_equal").alias("agreement_ok"))
            row = (v.join(dr, how="inner", on=F.lit(True)).join(ag, how="inner", on=F.lit(True))
                   .select(F.lit(cid).alias("config_id"), F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta"), "*"))
            out = row if out is None else out.unionByName(row)
    return out


def select_weighting(grid: DataFrame) -> DataFrame:
    """Lower p=0.3 variance, lower drift, signs kept."""
    return grid.select("config_id", ((F.col("weighted_var_p30") < F.col("raw_var_p30"))
                                     & (F.col("weighted_drift") < F.col("raw_drift")) & F.col("agreement_ok"))
                       .alias("selected"))


def confidence_dispersion(cells: DataFrame, medians: DataFrame, alpha: float = dims.CONFIDENCE_ALPHA,
                          beta: float = dims.CONFIDENCE_BETA, gamma: float = dims.CONFIDENCE_GAMMA,
                          phi: float = 0.2) -> DataFrame:
    """notebook confidence with the dispersion penalty (per-review signs in the agreement,
    reliability inside the sentiment score, phi = 0.2)."""
    from revidence.operators.evidence import norm_weight, raw_weight, reliability_term
    pc = cells.where("pred_sub").join(medians, "product_id")
    s = F.col("sign").cast("double")
    wn = norm_weight(F.col("sconf"), F.col("usefulness"), F.col("med_c"), F.col("med_u"), alpha, beta)
    w = raw_weight(F.col("sconf"), F.col("usefulness"), alpha, beta)
    a1 = pc.groupBy("product_id", "sub_idx").agg(F.sum(s * wn).alias("s_num"), F.sum(wn).alias("s_den"))
    S = robust_sign(reliability_col(F.col("sub_idx")) * F.col("s_num") / (F.col("s_den") + F.lit(EPS)))
    a1 = a1.select("product_id", "sub_idx", S.alias("S"))
    j = pc.join(a1, ["product_id", "sub_idx"])
    dis = F.when(F.col("S") != F.col("sign"), F.lit(1.0)).otherwise(F.lit(1e-8))
    a2 = j.groupBy("product_id", "sub_idx", "S").agg(
        F.sum(s * w).alias("ssw"), F.sum(F.abs(s * w)).alias("aw"), F.sum(h_useful(F.col("usefulness"), beta)).alias("vol"),
        F.sum(F.col("usefulness") * dis).alias("dn"), F.sum("usefulness").alias("dd"))
    agree = F.abs(F.col("ssw")) / (F.col("aw") + F.lit(EPS))
    volume = F.lit(1.0) - F.exp(-F.col("vol") / F.lit(gamma))
    disp = F.col("dn") / (F.col("dd") + F.lit(EPS))
    conf = reliability_term(reliability_col(F.col("sub_idx"))) * agree * volume * (F.lit(1.0) - disp)
    return a2.select("product_id", "sub_idx", F.col("S").alias("sign"), disp.alias("dispersion"),
                     (F.lit(100.0) * F.pow(conf, F.lit(phi))).alias("confidence"))
