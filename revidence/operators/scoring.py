"""Model scoring as batch operators.

The reference runs two ONNX models (usefulness ranker, hierarchical aspect model) whose
weights are not shipped. Scoring is therefore a pluggable stage with one contract:

    usefulness: text -> DOUBLE
    aspects:    text -> top ARRAY<DOUBLE>[9], sub/comp ARRAY<DOUBLE>[29], sent ARRAY<STRUCT<neg,pos>>[29]

Two implementations:
* ``HashedLinearScorer``: a NumPy linear model on hashed tokens, run with ``mapInPandas`` over
  Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch`` plays the reference's batch
  size of 128); the weight matrix is created once per Python worker from a seed, never shipped
  through the driver. Any object with the same two methods (e.g. an ONNX session wrapper) can
  replace it.
* ``native_scores``: a deterministic stand-in built from ``md5`` in native expressions, so the
  whole pipeline can be checked against SQL.

D3 trains one weighted logistic regression per label with Spark ML.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revidence import dims

TOKEN_RE = re.compile(r"[a-z0-9]+")


class HashedLinearScorer:
    """Hashed bag of words -> linear heads. Deterministic (crc32 hashing, seeded weights)."""

    def __init__(self, n_features: int = 1 << 14, seed: int = 7):
        self.n_features = n_features
        rng = np.random.default_rng(seed)
        self.w_use = rng.normal(0, 0.05, n_features)
        self.w_asp = rng.normal(0, 0.05, (n_features, dims.N_TOP + 2 * dims.N_SUB + 2 * dims.N_SUB))

    def _heads(self, texts, w: np.ndarray) -> np.ndarray:
        """Features of each text times w, a text at a time: only the rows of w that its tokens hash to are read, and no
        len(texts) x n_features matrix is made."""
        z = np.zeros((len(texts), *w.shape[1:]))
        for i, t in enumerate(texts):
            toks = Counter(TOKEN_RE.findall((t or "").lower()))     # whole text, no truncation
            if not toks:
                continue
            idx = np.fromiter((zlib.crc32(tok.encode()) % self.n_features for tok in toks), dtype=np.int64)
            n = np.fromiter(toks.values(), dtype=np.float64)
            z[i] = n @ w[idx] / np.sqrt(n.sum())
        return z

    def usefulness(self, texts) -> np.ndarray:
        z = self._heads(texts, self.w_use)
        return 10.0 / (1.0 + np.exp(-25.0 * z))

    def aspects(self, texts):
        z = self._heads(texts, self.w_asp) * 8.0
        t, s = dims.N_TOP, dims.N_SUB
        return z[:, :t], z[:, t:t + s], z[:, t + s:t + 2 * s], z[:, t + 2 * s:t + 3 * s], z[:, t + 3 * s:]


#: Rows scored at once: a batch is handed on in slices, so that a worker holds the outputs of one slice.
SLICE = 1024


def _slices(batches):
    for pdf in batches:
        for at in range(0, max(len(pdf), 1), SLICE):
            yield pdf.iloc[at:at + SLICE].copy()


_SCORERS: dict = {}


def _scorer(factory):
    key = id(factory)
    if key not in _SCORERS:        # built once per Python worker process
        _SCORERS[key] = factory()
    return _SCORERS[key]


def _kept(df: DataFrame, text_col: str, keep_text: bool) -> list:
    return [f for f in df.schema.fields if keep_text or f.name != text_col]


def score_usefulness(df: DataFrame, text_col: str = "prompt", factory=HashedLinearScorer, keep_text: bool = True) -> DataFrame:
    """Append ``usefulness`` (DOUBLE) using the scorer in Arrow batches. Without ``keep_text`` the workers don't send the texts back."""
    schema = T.StructType([*_kept(df, text_col, keep_text), T.StructField("usefulness", T.DoubleType())])

    def run(batches):
        sc = _scorer(factory)
        for pdf in _slices(batches):
            pdf["usefulness"] = sc.usefulness(pdf[text_col].tolist()) if len(pdf) else []
            yield pdf if keep_text else pdf.drop(columns=text_col)
    return df.mapInPandas(run, schema)


def score_aspects(df: DataFrame, text_col: str = "prompt", factory=HashedLinearScorer, keep_text: bool = True) -> DataFrame:
    """Append the four logit blocks; run it only on gated rows (the gate is written before
    this stage because nothing is pushed through an opaque Python operator)."""
    sent_t = T.ArrayType(T.StructType([T.StructField("neg", T.DoubleType()), T.StructField("pos", T.DoubleType())]))
    schema = T.StructType(_kept(df, text_col, keep_text) + [
        T.StructField("top", T.ArrayType(T.DoubleType())), T.StructField("sub", T.ArrayType(T.DoubleType())),
        T.StructField("comp", T.ArrayType(T.DoubleType())), T.StructField("sent", sent_t)])

    def run(batches):
        sc = _scorer(factory)
        for pdf in _slices(batches):
            if len(pdf):
                top, sub, comp, neg, pos = sc.aspects(pdf[text_col].tolist())
                pdf["top"] = list(top)
                pdf["sub"] = list(sub)
                pdf["comp"] = list(comp)
                pdf["sent"] = [[{"neg": float(a), "pos": float(b)} for a, b in zip(r1, r2)] for r1, r2 in zip(neg, pos)]
            else:
                for c in ("top", "sub", "comp", "sent"):
                    pdf[c] = []
            yield pdf if keep_text else pdf.drop(columns=text_col)
    return df.mapInPandas(run, schema)


# --- deterministic native scorer (SQL-checkable) ------------------------------------------------

def _md5_vals(prompt: Column, tag: str, n: int) -> Column:
    """n values in [-4, 4] from the bytes of md5(prompt || tag || block)."""
    blocks = (n + 15) // 16
    digests = F.concat(*[F.md5(F.concat(prompt, F.lit(f"|{tag}{b}"))) for b in range(blocks)])
    # the digests are bound to a variable: named in the inner lambda, they would be taken of the whole prompt for each value
    return F.transform(F.array(digests), lambda hexes: F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.conv(F.substring(hexes, i * 2 + 1, 2), 16, 10).cast("double") / F.lit(255.0) * 8.0 - 4.0))[0]


def native_scores(prompt: Column) -> list[Column]:
    """usefulness, top, sub, comp, sent from md5 bytes of the prompt (stand-in model)."""
    h = F.md5(prompt)
    use = F.conv(F.substring(h, 1, 6), 16, 10).cast("double") / F.lit(float(16 ** 6)) * 10.0
    neg = _md5_vals(prompt, "n", dims.N_SUB)
    pos = _md5_vals(prompt, "p", dims.N_SUB)
    sent = F.zip_with(neg, pos, lambda a, b: F.struct(a.alias("neg"), b.alias("pos")))
    return [use.alias("usefulness"), _md5_vals(prompt, "t", dims.N_TOP).alias("top"),
            _md5_vals(prompt, "s", dims.N_SUB).alias("sub"), _md5_vals(prompt, "c", dims.N_SUB).alias("comp"),
            sent.alias("sent")]


# --- D3: multi-label training ------------------------------------------------------------------------

def train_multilabel(df: DataFrame, text_col: str, label_cols: list[str], valid_col: str = "is_valid",
                     num_features: int = 1 << 16, max_iter: int = 20):
    """One binary logistic head per label with inverse-frequency positive weight
    ((N - n) / n on positives), trained on the non-holdout rows; returns (models, metrics DataFrame)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    feat = Pipeline(stages=[RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern="[^a-z0-9]+", toLowercase=True),
                            HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
                            IDF(inputCol="_tf", outputCol="features")])
    train = df.where(~F.col(valid_col))
    fm = feat.fit(train)
    ft = fm.transform(df).select("features", valid_col, *label_cols)
    tr = ft.where(~F.col(valid_col))
    va = ft.where(F.col(valid_col))
    models, rows = {}, []
    spark = df.sparkSession
    for lab in label_cols:
        stats = tr.agg(F.count("*").alias("n"), F.sum(F.col(lab)).alias("p")).first()
        n, p = stats["n"], stats["p"] or 0
        pw = float((n - p) / (p + 1e-6))
        t = tr.withColumn("_w", F.when(F.col(lab) == 1, F.lit(pw)).otherwise(F.lit(1.0))) \
              .withColumn("label", F.col(lab).cast("double"))
        m = LogisticRegression(featuresCol="features", labelCol="label", weightCol="_w", maxIter=max_iter).fit(t)
        models[lab] = m
        auc = BinaryClassificationEvaluator(labelCol="label").evaluate(
            m.transform(va.withColumn("label", F.col(lab).cast("double"))))
        rows.append((lab, int(n), int(p), pw, float(auc)))
    metrics = spark.createDataFrame(rows, "label STRING, n_train BIGINT, n_pos BIGINT, pos_weight DOUBLE, valid_auc DOUBLE")
    return (fm, models), metrics
