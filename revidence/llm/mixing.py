"""Operator 9: mixing domains to target weights by soft membership (native).

1. A bounded sample of a labelled table (rows text, domain) trains a multinomial naive Bayes classifier over hashed words: one count table of
   (domain, bucket), at most ``BUCKETS`` x domains numbers whatever the input.
2. Every document gets posteriors p_k over the domains, a softmax of its mean log-likelihood per word times
   ``SHARPNESS`` plus the log prior.
3. Rates r_i >= floor are fitted by accelerated projected gradient steps on the least squares
       |sum_i r_i p_i T_i - b|^2 / 2  in the norm of M^-1,  M = sum_i T_i p_i p_i'
   (T_i tokens, p_i posteriors, b the targets' totals). With M as preconditioner a step has length 1: each document moves by
   -p_i' M^-1 (residual), is projected onto the box and gets momentum, which is dropped when the error has grown. A step is a row of
   K numbers and its momentum, so a document's rate is a fold over the steps taken so far: a pass over the documents sums up 2 K
   numbers, and no rates are stored. Steps end when every total is within ``TOLERANCE`` of its target. Where no rates can do that
   (the floor, or a domain that no document belongs to), the closest totals found are kept once ``STALL`` steps have brought nothing,
   and ``mix`` warns with the relative errors that are left. ``floor`` is the lower end of the box (0; 1 keeps every document at least once).

Rows: null and empty texts have 0 tokens, prior posteriors and rate 1 (or the floor). Rows without a label, or whose
domain is not in the targets, are classified like any other. Repeated rows are fitted one by one and get equal
rates. An empty table gives an empty result; without any labelled row the posteriors are the targets.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revidence.functions.columns import computed
from revidence.llm.common import SPACES, bound, written

BUCKETS = 4096
SHARPNESS = 20.0
TOLERANCE = 1e-4   # of a domain's total, relative to its target
STEPS = 100        # passes over the documents at most; some ten are usual
STALL = 20         # passes without a tenth less error that end the fit


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def _bucket(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")


def train(labelled: DataFrame, domains: list[str]) -> tuple[list[list[float]], list[float]]:
    """Log-likelihood table [bucket][domain] and log priors from rows (text, domain)."""
    rows = labelled.where(F.col("domain").isin(domains)).select("domain", F.explode(words(F.col("text"))).alias("w"))
    counts = rows.groupBy("domain", _bucket(F.col("w")).alias("bucket")).count().collect()  # at most BUCKETS x domains rows
    n = [[0.5] * len(domains) for _ in range(BUCKETS)]
    for r in counts:
        n[r["bucket"]][domains.index(r["domain"])] += r["count"]
    sums = [sum(row[k] for row in n) for k in range(len(domains))]
    return [[math.log(x / sums[k]) for k, x in enumerate(row)] for row in n], [math.log(s / sum(sums)) for s in sums]


def posteriors(docs: DataFrame, table: list[list[float]], prior: list[float], keep: list[str]) -> DataFrame:
    """(columns of ``keep``, tokens, p) for each row, in one pass over the rows."""
    rows = docs.select(F.struct(*keep).alias("__kept"), "text")
    columns = [F.lit([row[k] for row in table]) for k in range(len(prior))]
    loglik = F.aggregate(F.transform(words(F.col("text")), _bucket),
                         F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(f"s{k}") for k in range(len(prior))]),
                         lambda s, b: F.struct((s.n + 1).alias("n"), *[(s[f"s{k}"] + F.get(c, b)).alias(f"s{k}") for k, c in enumerate(columns)]))
    rows = computed(rows, __l=loglik).select("__kept", F.col("__l.n").alias("tokens"), *[
        (F.when(F.col("__l.n") > 0, SHARPNESS * F.col(f"__l.s{k}") / F.col("__l.n")).otherwise(0.0) + prior[k]).alias(f"s{k}") for k in range(len(prior))])
    top = F.greatest(*[F.col(f"s{k}") for k in range(len(prior))]) if len(prior) > 1 else F.col("s0")
    parts = F.array(*[F.exp(F.col(f"s{k}") - top) for k in range(len(prior))])
    return rows.select("__kept", "tokens", bound(parts, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))).alias("p"))


def _rates(steps: list[list[float]], floor: float, K: int) -> Column:
    """struct(r, y): the rate after ``steps`` (rows of K moves and a momentum), and the rate carried on by the momentum."""
    start = F.lit(max(1.0, float(floor)))
    if not steps:
        return F.struct(start.alias("r"), start.alias("y"))

    def step(s: Column, g: Column) -> Column:
        moved = F.greatest(F.lit(float(floor)), s.y - sum((F.col("p")[k] * g[k] for k in range(K)), F.lit(0.0)))
        return bound(moved, lambda r: F.struct(r.alias("r"), (r + g[K] * (r - s.r)).alias("y")))
    return F.aggregate(F.lit(steps), F.struct(start.alias("r"), start.alias("y")), step)


def fit(members: DataFrame, goals: list[float], *, floor: float = 0.0, steps: int = STEPS) -> tuple[Column, list[dict]]:
    """Rate column over (tokens, p), and the relative error of each domain after each step; the last one is that of the rate."""
    K = len(goals)
    T = F.col("tokens").cast("double")
    p = [F.col("p")[k] for k in range(K)]
    b = np.array(goals, float)
    scale = np.maximum(b, 1.0)
    pairs = [(k, m) for k in range(K) for m in range(k + 1)]
    now = members.agg(*[F.sum(T * p[k] * p[m]).alias(f"m{k}_{m}") for k, m in pairs]).first()
    M = np.zeros((K, K))
    for k, m in pairs:
        M[k, m] = M[m, k] = now[f"m{k}_{m}"] or 0.0
    W = np.linalg.inv(M + 1e-9 * np.diag(np.maximum(M.diagonal(), 1.0)))

    def residuals(taken: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rows = computed(members.select("tokens", "p"), __s=_rates(taken, floor, K))
        got = rows.agg(*[F.sum(F.col(f"__s.{c}") * T * x).alias(f"{c}{k}") for c in "ry" for k, x in enumerate(p)]).first()
        return tuple(np.array([got[f"{c}{k}"] or 0.0 for k in range(K)]) - b for c in "ry")
    taken, errors, t, before = [], [], 1.0, math.inf
    best, best_at, stalled = math.inf, 0, 0
    while True:
        off, ahead = residuals(taken)
        errors.append(off / scale)
        found = np.abs(errors[-1]).max()
        stalled = 0 if found < 0.9 * best else stalled + 1
        if found < best:
            best, best_at, best_steps = found, len(taken), [list(g) for g in taken]
        if best < TOLERANCE or stalled >= STALL or len(errors) >= steps:
            break
        error = float(off @ W @ off)
        if error > before:  # the last step's momentum is dropped
            taken[-1][K], ahead, t = 0.0, off, 1.0
        before, after = error, (1 + math.sqrt(1 + 4 * t * t)) / 2
        taken.append([*(W @ ahead).tolist(), (t - 1) / after])
        t = after
    if best_at < len(taken):
        errors.append(errors[best_at])
    return _rates(best_steps, floor, K).r, [dict(enumerate(e.tolist())) for e in errors]


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], *, floor: float = 0.0, grow: bool = False, keep: list[str] | None = None,
        residuals: dict[str, float] | None = None) -> DataFrame:
    """One row per document: the columns of ``keep`` (doc_id), tokens, p (map domain -> posterior), rate, copies.

    The target totals share out the expected tokens of all documents; with ``grow`` they are scaled up so that no
    domain has to shrink. Relative errors of the domains' totals are put into ``residuals``, if given; a warning names them
    when one is above TOLERANCE. ``copies`` is the rate rounded down or up by a hash of the id, so its mean is the rate.
    """
    domains = sorted(targets)
    total = sum(targets.values())
    share = [targets[d] / total for d in domains]
    table, prior = train(labelled, domains)
    if len({round(x, 12) for row in table for x in row}) == 1:
        prior = [math.log(max(s, 1e-12)) for s in share]
    members = written(posteriors(docs, table, prior, list(dict.fromkeys(["doc_id", *(keep or [])]))), "mixing")
    K = len(domains)
    have = members.agg(*[F.sum(F.col("tokens") * F.col("p")[k]).alias(f"t{k}") for k in range(K)]).first()
    have = [have[f"t{k}"] or 0.0 for k in range(K)]
    scale = max([sum(have)] + [h / s for h, s in zip(have, share) if s > 0]) if grow else sum(have)
    rate, errors = fit(members, [s * scale for s in share], floor=floor)
    left = {d: errors[-1][k] for k, d in enumerate(domains)}
    if residuals is not None:
        residuals.update(left)
    if max(map(abs, left.values())) >= TOLERANCE:
        warnings.warn(f"mixing: relative errors of the targets after {len(errors)} steps: {left}", stacklevel=2)
    out = members.withColumn("rate", F.when(F.col("tokens") > 0, rate).otherwise(F.lit(max(1.0, floor))))
    out = out.withColumn("p", F.map_from_arrays(F.lit(domains), "p"))
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.coalesce(F.col("__kept.doc_id"), F.lit(-1))), F.lit(1 << 30)) / float(1 << 30)
    out = out.withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
    return out.select(*[F.col(f"__kept.`{c}`") for c in (keep or ["doc_id"])], "tokens", "p", "rate", "copies")
