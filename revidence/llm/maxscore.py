"""Operator 5: exact top-k by inner product with MaxScore.

Every component of a vector is a term, its postings the column of that component. Queries and vectors are dealt to the
cells of a grid (query block x shard), each of bounded size. A cell knows the least and the most that each term can add to a query's
score over its shard; terms are ordered by that spread. A cell scans its vectors in chunks, longest vectors first. A
query's threshold is the k-th score found so far and rises chunk by chunk; with it the query's essential terms are split off anew: the
others, all at their most, stay below the threshold unless an essential term adds more than its least. In a chunk the essential terms'
postings are summed up; a vector with more than the least of them is a candidate, and the other terms are probed for it, group by group,
while its sum plus the bound of the rest competes. Chunks whose own bounds are below the threshold are passed over, and a query is
done with the shard when no term is essential. The bound of the rest is the smaller of the terms' bounds and the product of the norms
of what is left. The shards' best k are merged by a window. Embeddings are dense: nearly every vector is in every posting, so it is
probing and passing over that prune.

Rows: vectors that are null or hold null or non-finite components take no part; vectors of different length are
compared over the components both have; ties go to the smaller id. A row is no candidate of a query with its own id;
rows repeated with one id are candidates each, and queries repeated with one id count once. Null ids take no part. Fewer than
than k candidates: all of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 8192
BLOCK = 1024
CHUNK = 256
GROUP = 8
RESULT = "query_id long, vec_id long, score long"


def quantised(x: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as double; null for vectors that take no part."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    a = column.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    sizes, flat = a.value_lengths().to_numpy(zero_copy_only=False), a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(a), width), np.int64)
    out[np.repeat(np.arange(len(a)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _fits(Q: np.ndarray, X: np.ndarray) -> bool:
    """Whether all sums are exact in doubles."""
    return float(np.abs(Q).max(initial=0)) * float(np.abs(X).max(initial=0)) * max(X.shape[1], 1) < 2**52


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda a: (-scores[a], ids[a]))[:k], dtype=int)
    return np.lexsort((ids, -scores))[:k]


def top_of_cell(ids: np.ndarray, X: np.ndarray, query_ids: np.ndarray, Q: np.ndarray, k: int, *, chunk: int = CHUNK,
                touched: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vector ids, scores) of each query's best k in the shard; the number of postings read for a query is put into ``touched``."""
    X, Q = (X.astype(np.float64), Q.astype(np.float64)) if _fits(Q, X) else (X.astype(object), Q.astype(object))
    n, D = X.shape
    longest = np.argsort(-(X.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    X, ids = X[longest], ids[longest]
    low, high = X.min(axis=0), X.max(axis=0)
    spread = np.abs(Q * high - Q * low).sum(axis=0).astype(np.float64)
    order = np.argsort(-spread, kind="stable")
    X, Q, low, high = X[:, order], Q[:, order], low[order], high[order]
    most, least = np.maximum(Q * low, Q * high), np.minimum(Q * low, Q * high)
    none = np.zeros((len(Q), 1), Q.dtype)
    rest = np.concatenate([np.cumsum(most[:, ::-1], axis=1)[:, ::-1], none], axis=1)  # what terms j.. can add at most
    base = np.concatenate([none, np.cumsum(least, axis=1)], axis=1)                   # what terms before j add at least
    worth = base + rest  # the most of a vector that has the least of all terms before j; falls with j
    left = lambda M: np.concatenate([np.sqrt(np.cumsum((M.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]), np.zeros((len(M), 1))], axis=1)
    x_left, q_left = left(X), left(Q)
    exact = X.dtype != object
    starts = range(0, n, chunk)
    reach = [np.maximum(Q * X[c:c + chunk].min(axis=0), Q * X[c:c + chunk].max(axis=0)).sum(axis=1) for c in starts]
    if exact:
        reach = [np.minimum(r, np.ceil(q_left[:, 0] * x_left[c, 0] + 1e-6)) for r, c in zip(reach, starts)]
    found, scores = [ids[:0]] * len(Q), [X[:0, 0] if D else np.zeros(0, X.dtype)] * len(Q)
    theta, full, read = np.zeros(len(Q), X.dtype), np.zeros(len(Q), bool), np.zeros(len(Q), np.int64)
    for r, c in zip(reach, starts):
        block, names = X[c:c + chunk], ids[c:c + chunk]
        needed = (worth >= theta[:, None]).sum(axis=1)
        live = ~full | ((needed > 0) & (r >= theta))
        essential = np.where(full, np.minimum(D, -(-needed // GROUP) * GROUP), D)  # in whole groups, so that queries share a product
        for e in np.unique(essential[live]):
            rows = np.flatnonzero(live & (essential == e))
            sums = Q[rows, :e] @ block[:, :e].T if e else np.zeros((len(rows), len(block)), X.dtype)
            read[rows] += len(block) * e
            split = full[rows] & (worth[rows, e] < theta[rows])
            candidate = (names != query_ids[rows][:, None]) & (~split[:, None] | (sums > base[rows, e][:, None])).astype(bool)
            i, at = np.nonzero(candidate)
            score, i, j = sums[i, at], rows[i], int(e)
            while j < D and len(i):
                bound = np.minimum(rest[i, j], np.ceil(q_left[i, j] * x_left[c + at, j] + 1e-6)) if exact else rest[i, j]
                keep = (score + bound >= theta[i]).astype(bool)
                i, at, score = i[keep], at[keep], score[keep]
                step = min(D, j + GROUP)
                score = score + (block[at, j:step] * Q[i, j:step]).sum(axis=1)
                np.add.at(read, i, step - j)
                j = step
            keep = (~full[i] | (score >= theta[i])).astype(bool)
            i, at, score = i[keep], at[keep], score[keep]
            ends = np.flatnonzero(np.diff(i)) + 1
            for a, b in zip([0, *ends], [*ends, len(i)]) if len(i) else ():
                q = i[a]
                some, their = np.concatenate([found[q], names[at[a:b]]]), np.concatenate([scores[q], score[a:b]])
                best = _best(some, their, k)
                found[q], scores[q], full[q] = some[best], their[best], len(best) == k
                if full[q]:
                    theta[q] = scores[q][-1]
    if touched is not None:
        touched.extend(read.tolist())
    yield from zip(query_ids, found, scores)


def top_k(vectors: DataFrame, is_query: Column, k: int, *, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score from rows (vec_id long, v array<long>); ``is_query`` marks the queries among them."""
    rows = vectors.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "v")
    n = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("v")).alias("width")).first()
    shards, blocks, width = -(-max(n.n, 1) // shard), -(-max(n.q, 1) // block), n.width or 0
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    place = lambda m, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("vec_id")), F.lit(m))
    left = rows.select("vec_id", "v", place(shards, 1).alias("s"), every(blocks).alias("b")).select((F.col("s") * blocks + F.col("b")).alias("cell"), "vec_id", "v")
    queries = rows.where(is_query).dropDuplicates(["vec_id"])
    right = queries.select("vec_id", "v", place(blocks, 2).alias("b"), every(shards).alias("s")).select((F.col("s") * blocks + F.col("b")).alias("cell"), "vec_id", "v")

    def cell(x: pa.Table, q: pa.Table) -> pa.Table:
        out = [(np.full(len(v), i), v, s) for i, v, s in top_of_cell(
            x["vec_id"].to_numpy(), _matrix(x["v"], width), q["vec_id"].to_numpy(), _matrix(q["v"], width), k)] if len(x) and len(q) else []
        cols = [np.concatenate([o[i] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(cell, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
