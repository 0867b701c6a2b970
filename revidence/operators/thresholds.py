"""Threshold study as batch jobs.

All trials are scored at once, in counter arrays: a task holds the trial table (at most ``MAX_TRIALS`` rows of 9 + 29 thresholds,
built once) and adds up true positives, predictions and positives per (trial, sub) over blocks of its reviews; only these
counters leave the task. Per-class thresholds are searched in score histograms: suffix sums over the grid give the counts of every
threshold. The sequential adaptive sampler of the reference is replaced by hash-derived candidates (J14); the Pareto front is a skyline.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revidence import dims
from revidence.operators.evaluate import prf
from revidence.operators.predict import sigmoid
from revidence.session import cut_lineage

N_CLASSES = dims.N_TOP + dims.N_SUB


def candidate_thr(trial: Column, cls: Column, lo: float = 0.15, hi: float = 0.5) -> Column:
    """Deterministic uniform in [lo, hi) from a hash of (trial, class), so trials never repeat."""
    h = F.conv(F.substring(F.md5(F.concat(trial.cast("string"), F.lit(":"), cls.cast("string"))), 1, 8), 16, 10)
    return F.lit(lo) + F.lit(hi - lo) * h.cast("bigint").cast("double") / F.lit(float(1 << 32))


def threshold_candidates(spark: SparkSession, n_trials: int, lo: float = 0.15, hi: float = 0.5) -> DataFrame:
    """(trial, class_idx, thr) long form; classes 0-8 are tops, 9-37 subs."""
    t = spark.range(n_trials).select(F.col("id").alias("trial"))
    c = t.select("trial", F.explode(F.sequence(F.lit(0), F.lit(N_CLASSES - 1))).alias("class_idx"))
    return c.select("trial", F.col("class_idx").cast("int").alias("class_idx"),
                    candidate_thr(F.col("trial"), F.col("class_idx"), lo, hi).alias("thr"))


def trials_wide(cands: DataFrame) -> DataFrame:
    """(trial, top_thr array<double>[9], sub_thr array<double>[29]) from the long form."""
    g = cands.groupBy("trial").agg(F.sort_array(F.collect_list(F.struct("class_idx", "thr"))).alias("c"))
    return g.select("trial",
                    F.transform(F.slice("c", 1, dims.N_TOP), lambda x: x["thr"]).alias("top_thr"),
                    F.transform(F.slice("c", dims.N_TOP + 1, dims.N_SUB), lambda x: x["thr"]).alias("sub_thr"))


#: Trials that one study scores at most (the table is held by every task; 38 doubles a trial).
MAX_TRIALS = 100_000
#: Reviews and trials that are compared at once: bounds the memory of a task.
REVIEW_BLOCK, TRIAL_BLOCK = 512, 64


def _trial_table(spark: SparkSession, trials, lo: float, hi: float) -> tuple[list, np.ndarray]:
    """(trial ids, thresholds [trials, 38]) of hash-derived trials or of a wide trial DataFrame."""
    wide = trials_wide(threshold_candidates(spark, trials, lo, hi)) if isinstance(trials, int) else trials
    rows = wide.select("trial", F.concat("top_thr", "sub_thr").alias("thr")).limit(MAX_TRIALS + 1).collect()
    if len(rows) > MAX_TRIALS:
        raise ValueError(f"a study has at most {MAX_TRIALS} trials")
    return [r.trial for r in rows], np.array([r.thr for r in rows], float).reshape(len(rows), N_CLASSES)


def trial_counts(scored: DataFrame, labels_dense: DataFrame, trials, taxonomy=None,
                 lo: float = 0.15, hi: float = 0.5) -> DataFrame:
    """(trial, sub_idx, tp, fp, fn) for every trial at once.

    ``trials`` is either an int n (hash-derived candidates) or a wide trial DataFrame of at most MAX_TRIALS rows (trials read from a CSV).
    One row a review travels; what is shuffled are the counters of a task.
    """
    ids, thr = _trial_table(scored.sparkSession, trials, lo, hi)
    parents = np.zeros((dims.N_TOP, dims.N_SUB), np.float32)
    for sub, tops in enumerate(dims.parents_of(taxonomy)):
        parents[list(tops), sub] = 1
    r = scored.select("review_id", F.transform("top", sigmoid).alias("pt"), F.transform("sub", sigmoid).alias("ps")) \
        .join(labels_dense, "review_id", "left").select("pt", "ps", F.coalesce("y", F.array_repeat(F.lit(0), dims.N_SUB)).alias("y"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tp, fired_n = (np.zeros((len(ids), dims.N_SUB), np.int64) for _ in range(2))
        pos = np.zeros(dims.N_SUB, np.int64)
        for b in batches:
            cols = [b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for i in range(3)]
            for i in range(0, len(b), REVIEW_BLOCK):
                pt, ps, y = (c[i:i + REVIEW_BLOCK] for c in cols)
                y = y == 1
                pos += y.sum(axis=0)
                for t in range(0, len(ids), TRIAL_BLOCK):
                    part = thr[t:t + TRIAL_BLOCK]
                    fired = pt[:, None, :] > part[None, :, :dims.N_TOP]
                    allowed = (fired.astype(np.float32) @ parents > 0) | ~fired.any(axis=2)[:, :, None]
                    pred = allowed & (ps[:, None, :] > part[None, :, dims.N_TOP:])
                    fired_n[t:t + TRIAL_BLOCK] += pred.sum(axis=0)
                    tp[t:t + TRIAL_BLOCK] += (pred & y[:, None, :]).sum(axis=0)
        if len(ids):
            yield pa.RecordBatch.from_pydict({
                "trial": pa.array(np.repeat(np.array(ids, np.int64), dims.N_SUB)), "sub_idx": pa.array(np.tile(np.arange(dims.N_SUB, dtype=np.int32), len(ids))),
                "tp": pa.array(tp.ravel()), "fp": pa.array((fired_n - tp).ravel()), "fn": pa.array((pos[None, :] - tp).ravel())})
    counts = r.mapInArrow(count, "trial long, sub_idx int, tp long, fp long, fn long")
    return counts.groupBy("trial", "sub_idx").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def threshold_histogram(cells: DataFrame, grid: list[float], keys: list[str]) -> DataFrame:
    """(keys, sub_idx, t, tp, fp, fn) for every threshold of the ascending ``grid``, from cells (keys, sub_idx, y, allowed, p_sub).

    One pass puts a cell into the histogram slot that counts the thresholds below its score; suffix sums over the len(grid) + 1 slots give
    all counts, so cells are never multiplied by thresholds."""
    g = F.array(*[F.lit(float(t)) for t in grid])
    slot = F.when(F.col("allowed"), F.size(F.filter(g, lambda t: t < F.col("p_sub")))).otherwise(0)
    hist = cells.groupBy(*keys, "sub_idx", slot.alias("slot")).agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") != 1).cast("long")).alias("neg"))
    each = hist.groupBy(*keys, "sub_idx").agg(F.sum("pos").alias("all_pos"), F.collect_list(F.struct("slot", "pos", "neg")).alias("h"))
    above = lambda f: F.aggregate(F.filter("h", lambda x: x["slot"] > F.col("i")), F.lit(0).cast("long"), lambda acc, x: acc + x[f])
    return each.select(*keys, "sub_idx", "all_pos", "h", F.posexplode(g).alias("i", "t")).select(*keys, "sub_idx", "t", above("pos").alias("tp"), above("neg").alias("fp"), (F.col("all_pos") - above("pos")).alias("fn"))


def best_thresholds(cells: DataFrame, grid: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, sub_idx, best_thr, best_f1): the threshold of highest F1 for each class, the lowest of equals."""
    keys = keys or []
    per = threshold_histogram(cells, grid, keys).select(*keys, "sub_idx", "t", prf(F.col("tp"), F.col("fp"), F.col("fn"))[2].alias("f1"))
    return per.groupBy(*keys, "sub_idx").agg(F.max_by("t", F.struct("f1", -F.col("t"))).alias("best_thr"), F.max("f1").alias("best_f1"))


def cross_validated_thresholds(cells: DataFrame, grid: list[float], fold: str) -> DataFrame:
    """J15 with folds: (fold, sub_idx, best_thr, train_f1, test_f1): chosen on all other folds, scored on the fold itself.

    A fold's counts are subtracted from those of all folds, so the cells are read once."""
    h = threshold_histogram(cells, grid, [fold])
    every = h.groupBy("sub_idx", "t").agg(*[F.sum(c).alias(f"all_{c}") for c in ("tp", "fp", "fn")])
    j = h.join(every, ["sub_idx", "t"])
    rest = [F.col(f"all_{c}") - F.col(c) for c in ("tp", "fp", "fn")]
    j = j.select(fold, "sub_idx", "t", prf(*rest)[2].alias("train_f1"), prf(F.col("tp"), F.col("fp"), F.col("fn"))[2].alias("test_f1"))
    best = F.max_by(F.struct("t", "train_f1", "test_f1"), F.struct("train_f1", -F.col("t"))).alias("b")
    return j.groupBy(fold, "sub_idx").agg(best).select(fold, "sub_idx", F.col("b.t").alias("best_thr"), "b.train_f1", "b.test_f1")


def labels_dense(labels: DataFrame) -> DataFrame:
    """(review_id, y array<int>[29]) from long positive labels."""
    g = labels.groupBy("review_id").agg(F.collect_set(F.col("sub_idx").cast("int")).alias("idx"))
    return g.select("review_id", F.transform(F.sequence(F.lit(0), F.lit(dims.N_SUB - 1)),
                                             lambda i: F.array_contains("idx", i).cast("int")).alias("y"))


def trial_scores(counts: DataFrame, min_recall: float = 0.75) -> DataFrame:
    """J11 + J12: macro aspect precision/recall per trial and the penalised objectives."""
    pr, rc, _ = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    m = counts.select("trial", pr.alias("p"), rc.alias("r")).groupBy("trial").agg(
        F.avg("p").alias("aspect_precision"), F.avg("r").alias("aspect_recall"))
    pen = F.col("aspect_recall") < F.lit(min_recall)
    return m.select("trial", "aspect_precision", "aspect_recall",
                    F.when(pen, F.col("aspect_recall") - 1).otherwise(F.col("aspect_precision")).alias("obj_precision"),
                    F.when(pen, F.col("aspect_recall") - 1).otherwise(F.col("aspect_recall")).alias("obj_recall"))


def pareto_front_2d(df: DataFrame, a: str, b: str, key: str = "trial") -> DataFrame:
    """J13 for two maximised objectives: sort-based skyline. The windows run over one row per
    distinct value of ``a`` (bounded by the trial count)."""
    per_a = df.groupBy(a).agg(F.max(b).alias("bmax_at"))
    w = Window.orderBy(F.col(a).desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_a = per_a.withColumn("bmax_better", F.max("bmax_at").over(w))
    j = df.join(per_a, a)
    dominated = (F.coalesce(F.col("bmax_better") >= F.col(b), F.lit(False))) | (F.col("bmax_at") > F.col(b))
    return j.where(~dominated).select(*df.columns)


#: Rows of a block of the skyline.
FRONT_BLOCK = 20_000


def _front(points: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """Which points no other of them (or of ``against``) dominates. Points of a greater sum come first: they alone can dominate."""
    if against is not None:
        alive = np.arange(len(points))
        against = against[np.argsort(-against.sum(axis=1), kind="stable")]   # the strongest first: most points fall to the first few
        for j in range(0, len(against), 256):
            q, left = against[None, j:j + 256], []
            for i in range(0, len(alive), 1024):
                p = points[alive[i:i + 1024], None]
                left.append(alive[i:i + 1024][~((q >= p).all(axis=2) & (q > p).any(axis=2)).any(axis=1)])
            alive = np.concatenate(left) if left else alive
        keep = np.zeros(len(points), bool)
        keep[alive] = True
        return keep
    order, keep = np.argsort(-points.sum(axis=1), kind="stable"), np.zeros(len(points), bool)
    front = np.zeros((0, points.shape[1]))
    for i in range(0, len(order), 256):
        at = order[i:i + 256]
        at = at[_front(points[at], front)] if len(front) else at
        at = at[_front(points[at], points[at])]
        keep[at] = True
        front = np.concatenate([front, points[at]])
    return keep


def pareto_front(df: DataFrame, objectives: list[str], key: str = "trial") -> DataFrame:
    """J13 for d maximised objectives: a skyline by divide and conquer. Rows with a null or NaN objective are left out.

    Distinct vectors are dealt into blocks and each block keeps its own front. The local fronts, which are a small part of the rows, are then
    held against each other, block by block: a vector stays if no block dominates it. No task sees more than two blocks, and nothing is joined
    row by row. Rows that share a vector stay or go together."""
    vector = F.array(*[F.col(c).cast("double") for c in objectives])
    some = df.where(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)))
    distinct = some.select(vector.alias("v")).distinct()

    def points(t: pa.Table) -> np.ndarray:
        return np.array(t["v"].to_pylist(), float).reshape(t.num_rows, len(objectives))

    def local(t: pa.Table) -> pa.Table:
        return t.select(["v"]).filter(pa.array(_front(points(t))))

    def across(t: pa.Table) -> pa.Table:
        mine = np.array(t["mine"].to_pylist(), bool)
        p = points(t)
        own = t.select(["v"]).filter(pa.array(mine))
        return own.append_column("stays", pa.array(_front(p[mine], p[~mine])))
    blocks = max(1, -(-distinct.count() // FRONT_BLOCK))
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)))
    fronts = cut_lineage(dealt.groupBy("block").applyInArrow(local, "v array<double>"))
    if blocks > 1:
        n = max(1, -(-fronts.count() // FRONT_BLOCK))
        chunk = F.pmod(F.xxhash64(F.lit("chunk"), "v"), F.lit(n))
        fronts = fronts.withColumn("c", chunk)
        cells = fronts.select("v", F.col("c").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"), F.lit(True).alias("mine")) \
            .unionByName(fronts.select("v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.col("c").alias("j"), F.lit(False).alias("mine")))
        held = cells.groupBy("i", "j").applyInArrow(across, "v array<double>, stays boolean")
        fronts = held.groupBy("v").agg(F.min("stays").alias("stays")).where("stays").select("v")
    return some.withColumn("_v", vector).join(fronts.withColumnRenamed("v", "_v"), "_v", "left_semi").select(*df.columns)


TRIAL_PARAM_COLS = [f"params_sub_thr_{i}" for i in range(dims.N_SUB)] + [f"params_top_thr_{i}" for i in range(dims.N_TOP)]


def parse_duration(c: Column) -> Column:
    """'0 days 00:00:00.324400' -> seconds (double)."""
    rx = r"^(-?\d+) days (\d+):(\d+):([\d.]+)$"
    return (F.regexp_extract(c, rx, 1).cast("double") * 86400 + F.regexp_extract(c, rx, 2).cast("double") * 3600
            + F.regexp_extract(c, rx, 3).cast("double") * 60 + F.regexp_extract(c, rx, 4).cast("double"))


def typed_trials(raw: DataFrame) -> DataFrame:
    """Trial rows from string columns (CSV with header) to typed columns + thresholds long form."""
    t = raw.select(
        F.col("number").cast("bigint").alias("trial"),
        F.col("aspect_precision").cast("double").alias("aspect_precision"),
        F.col("aspect_recall").cast("double").alias("aspect_recall"),
        F.to_timestamp("datetime_start").alias("datetime_start"),
        F.to_timestamp("datetime_complete").alias("datetime_complete"),
        parse_duration(F.col("duration")).alias("duration_s"),
        "state", *[F.col(c).cast("double").alias(c) for c in TRIAL_PARAM_COLS])
    return t


def trials_long(typed: DataFrame) -> DataFrame:
    """Unpivot the 38 threshold columns to (trial, class_idx, thr); tops are classes 0-8."""
    u = typed.unpivot(["trial"], TRIAL_PARAM_COLS, "param", "thr")
    idx = F.regexp_extract("param", r"_(\d+)$", 1).cast("int")
    cls = F.when(F.col("param").startswith("params_top"), idx).otherwise(idx + dims.N_TOP)
    return u.select("trial", cls.alias("class_idx"), "thr")


def load_trials_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return typed_trials(raw)
