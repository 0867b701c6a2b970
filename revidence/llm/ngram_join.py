"""Operator 7: n-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

1. Sets: distinct ``n``-word shingles of every text, hashed to 64 bits. Documents with equal sets form a class; only its member with
   the smallest id goes on.
2. First sieve: a set's smallest hashes, so many that any partner must meet a tenth of the set among them, are counted over all
   documents; a set with fewer keys there that occur twice has no partner.
3. Order: the shingles of the sets left are counted exactly. Rare first, every set is put in the one global order.
4. Adaptive prefixes: a partner shares at least l shingles with the first |x| - ceil(t |x|) + l ones, for every l. Each set
   takes the l whose estimated cost (postings read, candidates / l verified) is least.
5. Candidates: sets that hold one prefix shingle are first compared with one of them only, that with the smallest share of
   shingles of its own; sets that this puts in one component need no further comparison, the other pairs of a list follow. A
   pair is verified when sizes and the numbers of shingles that any other set has allow it and it shares min(l_x, l_y) prefix shingles.
6. Components by alternating large and small stars.

Rows: null, empty and wordless texts have the empty set and link with nothing; texts of fewer than n words are one shingle.
Repeated rows are copies. Null ids take no part (component null). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revidence.llm import blocks as B
from revidence.llm.common import released, released_group, written

LONGEST = 8  # l goes from 1 to this
VERIFY, SCAN = 1.0, 4.0  # cost of a shingle in a verification, of a posting

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = B.mixed(np.arange(1, 257, dtype=np.uint64))
_CODE[65:91] = _CODE[97:123]  # A-Z as a-z
_POWER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each document; document of each) of texts in one buffer."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(data):
        return none
    gap = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], gap[:-1]])
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    if not len(starts):
        return none
    after = np.concatenate([gap[1:], [True]])
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    inside = np.flatnonzero(~gap)
    sizes = ends - starts
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(inside)) - np.repeat(begin, sizes)
    powers = np.ones(int(sizes.max()), np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, _POWER), out=powers[1:]) if len(powers) > 1 else None
    word = B.mixed(np.add.reduceat(_CODE[data[inside]] * powers[place], begin))
    doc = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    K = np.uint64(0xD6E8FEB86659FD93)
    full = np.maximum(count - n + 1, 0)
    at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(first, full)
    h = np.zeros(len(at), np.uint64)
    for i in range(n):
        h = B.mixed(h * K + word[at + i])
    short = np.flatnonzero((count > 0) & (count < n))
    s = np.zeros(len(short), np.uint64)
    for i in range(n - 1):
        more = count[short] > i
        s[more] = B.mixed(s[more] * K + word[first[short[more]] + i])
    h, d = np.concatenate([h, B.mixed(s + np.uint64(1))]), np.concatenate([np.repeat(np.arange(len(full)), full), short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    return h[keep], d[keep]


def _sets(t: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds of each document's run, ids) of a block, rows without an id left out."""
    t = t.filter(t["doc_id"].is_valid()) if t["doc_id"].null_count else t
    data, offsets = B.binary(t["text"])
    h, d = shingle_sets(data, offsets, n)
    return h, np.searchsorted(d, np.arange(len(t) + 1)), t["doc_id"].to_numpy()


def _signature(run: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    with np.errstate(over="ignore"):
        a = B.mixed(run ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        b = B.mixed(run * np.uint64(0x2545F4914F6CDD1D) + np.uint64(len(run))).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _least(size: int, percent: int) -> int:
    """Shingles that a partner shares at least."""
    return (percent * size + 99) // 100


def _sieve(size: int, percent: int) -> tuple[int, int]:
    """(l, prefix length) of the first sieve: a tenth of the set must be met."""
    l = max(1, size // 10)
    return l, min(size, size - _least(size, percent) + l)


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(h, return_counts=True)


SETS = "kind long, doc_id long, size long, hi long, lo long, " + B.KEYS
PREFIXES = "doc_id long, size long, matched long, l long, prefix long, live array<long>, ordered binary"


def class_of(docs: DataFrame, *, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, hi, lo) of every document with an id, and PREFIXES of the classes that may have partners."""
    rows, count = B.blocked(docs)
    buckets = max(8, count // 2)

    def first(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        h, cut, ids = _sets(t, n)
        out, prefixes = [], []
        for i, doc_id in enumerate(ids):
            run = h[cut[i]:cut[i + 1]]
            out.append((0, int(doc_id), len(run), *(_signature(run) if len(run) else (0, 0)), None, None, None, None))
            prefixes.append(run[:_sieve(len(run), percent)[1]])
        keys, counts = _counted(np.concatenate(prefixes)) if prefixes else (h[:0], h[:0])
        return B.table([*out, *((1, None, None, None, None, *r) for r in B.packed(block, keys, counts, buckets))], SETS)
    made = written(rows.groupBy("block").applyInArrow(released_group(first), SETS), "jaccard-sets")
    sets = made.where("kind = 0").select("doc_id", "size", "hi", "lo")
    classes = sets.where("size > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"))
    # a block is told its classes' representatives (kind 2), then totals of prefix keys (kind 0) and of all keys (kind 1)
    told = "block long, kind long, keys binary, counts binary"
    reps = classes.select(B.block_of(F.col("doc_id"), count).alias("block"), "doc_id", "hi").groupBy("block").agg(F.collect_list(F.struct("doc_id", "hi")).alias("r"))
    reps = reps.mapInArrow(released(_pack_reps), told)
    prefix_totals = B.totals(made.where("kind = 1")).select("block", F.lit(0).cast("long").alias("kind"), "keys", "counts")

    def chosen(t: pa.Table, more: pa.Table):
        """Runs of the representatives that share a prefix key."""
        kind = more["kind"].to_numpy()
        pick = more.filter(pa.array(kind == 2))
        reps = {tuple(x) for x in np.frombuffer(b"".join(pick["keys"].to_pylist()), np.int64).reshape(-1, 2).tolist()}
        shared = B.sent(more.filter(pa.array(kind == 0)))[0]
        if not len(shared) or not reps:
            return
        h, cut, ids = _sets(t, n)
        for i, doc_id in enumerate(ids):
            run = h[cut[i]:cut[i + 1]]
            l, size = _sieve(len(run), percent)
            if len(run) and B.look_up(run[:size], shared, np.ones(len(shared), np.uint8), 0).sum(dtype=np.int64) >= l:
                me = (int(doc_id), _signature(run)[0])
                if me in reps:
                    reps.discard(me)
                    yield int(doc_id), run

    def second(t: pa.Table, more: pa.Table) -> pa.Table:
        runs = [r for _, r in chosen(t, more)] if len(t) else []
        return B.table(B.packed(t["block"][0].as_py(), *_counted(np.concatenate(runs)), buckets) if runs else [], B.KEYS)

    def third(t: pa.Table, more: pa.Table) -> pa.Table:
        out = []
        if len(t):
            known, total = B.sent(more.filter(pa.array(more["kind"].to_numpy() == 1)))
            for doc_id, run in chosen(t, more):
                df = B.look_up(run, known, total, 1).astype(np.int64)
                matched = int((df > 1).sum())
                if matched < _least(len(run), percent):
                    continue
                order = np.lexsort((run, df))
                run, df = run[order], df[order]
                l, size = choose(df, percent)
                live = run[:size][df[:size] > 1]
                if len(live):
                    out.append((doc_id, len(run), matched, l, size, live.view(np.int64).tolist(), run.tobytes()))
        return B.table(out, PREFIXES)
    known = written(reps.unionByName(prefix_totals), "jaccard-told")
    together = lambda extra: rows.groupBy("block").cogroup(extra.groupBy("block"))
    all_totals = B.totals(together(known).applyInArrow(released_group(second), B.KEYS)).select("block", F.lit(1).cast("long").alias("kind"), "keys", "counts")
    return sets, written(together(known.unionByName(all_totals)).applyInArrow(released_group(third), PREFIXES), "jaccard-prefixes")


def _pack_reps(batches):
    for b in batches:
        out = [(block, 2, np.array([(x["doc_id"], x["hi"]) for x in r], np.int64).tobytes(), b"") for block, r in zip(b.column("block").to_pylist(), b.column("r").to_pylist())]
        yield from B.table(out, "block long, kind long, keys binary, counts binary").to_batches()


def choose(df: np.ndarray, percent: int) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost for the document frequencies of an ordered set."""
    n = len(df)
    base = n - _least(n, percent)
    postings = np.cumsum(df - 1)
    best = min(range(1, min(LONGEST, n - base) + 1), key=lambda l: (postings[base + l - 1] * (SCAN + VERIFY * n / l), l))
    return best, base + best


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("l").alias(f"l_{x}"), F.col("prefix").alias(f"p_{x}"), F.col("ordered").alias(f"set_{x}"))

    def check(batches):
        for t in batches:
            c = {n: t.column(n) for n in t.schema.names}
            keep = []
            for i in range(len(t)):
                x, y = (np.frombuffer(c[f"set_{s}"][i].as_buffer(), np.uint64) for s in "ab")
                (p, q), l = (c["p_a"][i].as_py(), c["p_b"][i].as_py()), min(c["l_a"][i].as_py(), c["l_b"][i].as_py())
                if len(np.intersect1d(x[:p], y[:q], True)) < l:
                    continue
                both = len(np.intersect1d(x, y, True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield t.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{x}_{s}" for s in "ab" for x in ("l", "p", "set")]).mapInArrow(released(check), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest id that is reachable, for every id in ``links`` (a, b)."""
    edges = links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u > v").distinct()
    before = None
    while True:
        # large star: larger neighbours of u go to the least neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u and u itself go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "jaccard-stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = now


def links_of(prefixes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect every component: compares no two sets that earlier links already connect."""
    def fit(x: str, y: str):
        """Sizes, and shingles that other sets have, allow the similarity."""
        n, m = [F.col(f"{s}size") for s in (x, y)], F.least(F.col(f"{x}matched"), F.col(f"{y}matched"))
        return (F.least(*n) * 100 >= F.greatest(*n) * percent) & (m * 100 >= (n[0] + n[1] - m) * percent)
    posts = prefixes.select("doc_id", "size", "matched", F.explode("live").alias("key"))
    central = F.struct(((F.col("size") - F.col("matched")) / F.col("size")).alias("own"), "doc_id", "size", "matched")
    heads = posts.groupBy("key").agg(F.min(central).alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    first = posts.join(heads, "key").where((F.col("doc_id") != F.col("head.doc_id")) & fit("", "head."))
    links = written(_verify(first.select(F.col("doc_id").alias("a"), F.col("head.doc_id").alias("b")).distinct(), prefixes, percent), "jaccard-links")
    labels = components(links)
    posts = posts.join(labels, "doc_id", "left").select("key", "doc_id", "size", "matched", F.coalesce("component", "doc_id").alias("component"))
    open_ = posts.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    # the head of a list is done; in lists with several components the pairs across them are left, each taken from the first list
    # that holds both, and only if they meet in as many prefix shingles as they must
    left = posts.join(open_, "key").join(heads.select("key", F.col("head.doc_id").alias("head")), "key").where("doc_id != head").drop("head")
    left = written(left.join(prefixes.select("doc_id", "l", "live"), "doc_id"), "jaccard-open")
    other = left.select(*[F.col(c).alias(f"b_{c}") for c in ("key", "doc_id", "size", "matched", "component", "l", "live")])
    met = F.array_intersect("live", "b_live")
    rest = left.join(other, (F.col("key") == F.col("b_key")) & (F.col("doc_id") < F.col("b_doc_id")) & (F.col("component") != F.col("b_component")) & fit("", "b_")
                     & (met[0] == F.col("key")) & (F.size(met) >= F.least("l", "b_l")))
    rest = rest.withColumnRenamed("b_doc_id", "b")
    more = _verify(rest.select(F.col("doc_id").alias("a"), "b").distinct(), prefixes, percent)
    return links.union(written(more, "jaccard-links"))


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: documents link at a Jaccard similarity of ``percent`` or more."""
    sets, prefixes = class_of(docs, n=n, percent=percent)
    labels = components(links_of(prefixes, percent))
    classes = sets.where("size > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    named = classes.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"))
    found = sets.where("size > 0").join(named, ["hi", "lo"]).select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))
    empty = sets.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    nobody = docs.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.union(empty).union(nobody)
