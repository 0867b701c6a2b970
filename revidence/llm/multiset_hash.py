"""Operator 6: homomorphic multiset hash of a document's paragraphs (native).

A paragraph is a maximal piece between line breaks or sentence ends. Each one is hashed to a wide vector and the
document's fingerprint is the lane-wise sum modulo powers of two, so that it does not depend on the order of the
paragraphs and pieces can be inserted (``combine``) or deleted (``remove``) without the rest of the text.

The vector has two parts:

* ``TOTALS`` lanes modulo 2**62, nonzero for every paragraph: two texts agree on them when their multisets agree;
* up to ``DEEPEST`` levels of ``LANES`` lanes modulo 2**32. A paragraph is nonzero in one of them: level by the trailing zeros
  of its hash, so level k holds one paragraph in 2**(k+1), lane by four more bits.  Equal lanes tell how much two texts share;
  the first level that is not crowded decides, whatever the length of the text: a text has less than 2**31 signs, hence at
  most some 16 paragraphs in the last level.

The first ``LEVELS`` levels are always stored, deeper ones up to the last that is not empty (short texts have none), so equal
multisets have equal vectors.

Rows: null and empty texts have the empty multiset (all lanes 0); two of them have likeness 1, one of them and another
text 0. Repeated rows and ids are kept; among equal ids the order is that of the texts. Null ids come last in
descending order. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revidence.functions.columns import computed
from revidence.llm.common import bound, only

LANES, LEVELS, DEEPEST, TOTALS = 16, 7, 28, 2
SIZE = TOTALS + LANES * LEVELS
_WIDE, _LANE = (1 << 62) - 1, (1 << 32) - 1
#: A level with more nonzero lanes than this in both texts is crowded: its lanes mix several paragraphs.
CROWDED = 11
PARAGRAPH_END = r"\n+|(?<=[.!?])[ \t]+"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END, -1), lambda p: F.length(p) > 0)


def _sum(values: Column, mask: int) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: (a + x).bitwiseAND(F.lit(mask)))


def _level(hashes: Column, k: int) -> Column:
    """Hashes whose bits 4.. have k trailing zeros (the last level: k or more). Bits 32.. are the value in the lane."""
    last = k == DEEPEST - 1
    width, want = (1 << k) - 1 if last else (1 << (k + 1)) - 1, 0 if last else 1 << k
    return F.filter(hashes, lambda h: F.shiftright(h, 4).bitwiseAND(F.lit(width)) == want)


def _lanes(hashes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda c: _sum(
        F.transform(F.filter(hashes, lambda h: h.bitwiseAND(F.lit(LANES - 1)) == c), lambda h: F.shiftrightunsigned(h, 32)), _LANE))


def _trimmed(v: Column) -> Column:
    """Without the empty levels at the end, but for the first LEVELS."""
    used = F.aggregate(F.sequence(F.lit(LEVELS), F.lit(DEEPEST - 1)), F.lit(LEVELS), lambda a, k: F.when(
        F.exists(F.slice(v, k * LANES + TOTALS + 1, LANES), lambda x: x != 0), k + 1).otherwise(a))
    return F.when(F.size(v) <= SIZE, v).otherwise(F.slice(v, F.lit(1), used * LANES + TOTALS))


def vector(text: Column) -> Column:
    """array<bigint> of SIZE lanes, or more for long texts."""
    def lanes(p: Column) -> Column:
        total = lambda salt: _sum(F.transform(p, lambda x: F.xxhash64(F.lit(salt), x).bitwiseAND(F.lit(_WIDE))), _WIDE)
        totals = F.array(*[total(salt) for salt in range(TOTALS)])
        levels = lambda h, a, b: F.concat(*[bound(_level(h, k), _lanes) for k in range(a, b)])
        rest = lambda h: F.filter(h, lambda x: F.shiftright(x, 4).bitwiseAND(F.lit((1 << LEVELS) - 1)) == 0)
        deep = lambda h: F.when(F.size(h) > 0, levels(h, LEVELS, DEEPEST)).otherwise(F.array().cast("array<bigint>"))
        cells = bound(F.transform(p, lambda x: F.xxhash64(x)), lambda h: F.concat(levels(h, 0, LEVELS), bound(rest(h), deep)))
        return bound(F.concat(totals, cells), _trimmed)
    return bound(paragraphs(text), lanes)


def _lanewise(a: Column, b: Column, use) -> Column:
    """Lanes that one side does not store are 0."""
    at = F.zip_with(a, b, lambda x, y: use(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))
    return bound(F.transform(at, lambda x, i: x.bitwiseAND(F.when(i < TOTALS, F.lit(_WIDE)).otherwise(F.lit(_LANE)))), _trimmed)


def combine(a: Column, b: Column) -> Column:
    """Vector of the union (with repetition) of two multisets: insertion."""
    return _lanewise(a, b, lambda x, y: x + y)


def remove(a: Column, b: Column) -> Column:
    """Vector of ``a`` without the paragraphs of ``b``: deletion."""
    return _lanewise(a, b, lambda x, y: x - y)


def as_text(v: Column) -> Column:
    """Hexadecimal text of a vector, each lane in a fixed width."""
    return F.concat(F.array_join(F.transform(F.slice(v, 1, TOTALS), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""),
                    F.array_join(F.transform(F.slice(v, F.lit(TOTALS + 1), F.size(v) - TOTALS), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the paragraphs of both texts that are in common (0 to 1), over the levels from the first uncrowded one.

    Paragraphs meet in a lane, so shares are taken of rates and not of lanes: with x paragraphs a lane on average, e^-x of the lanes are
    empty. So the paragraphs of a text are -log of its empty lanes and those in one text only -log of the equal lanes, empty or not.
    The likeness is 1 - (those in one text only) / (those of both).
    """
    rate = lambda empty: -F.log(F.greatest(empty, F.lit(0.5)) / LANES)

    def level(k: Column) -> Column:
        lanes = lambda v: F.slice(v, k * LANES + TOTALS + 1, LANES)
        filled = lambda v: F.size(F.filter(lanes(v), lambda x: x != 0))
        equal = F.zip_with(lanes(a), lanes(b), lambda x, y: bound(F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y")), lambda z: F.when(
            z.x == z.y, F.when(z.x != 0, 2).otherwise(1)).otherwise(0)))
        return F.struct(equal.alias("equal"), filled(a).alias("p"), filled(b).alias("q"))

    def add(s: Column, x: Column) -> Column:
        same, apart = F.size(F.filter(x.equal, lambda z: z == 2)), F.size(F.filter(x.equal, lambda z: z == 0))
        opened = s.opened | (F.greatest(x.p, x.q) <= CROWDED)
        sums = {"same": same.cast("double"), "apart": rate(LANES - apart), "both": rate(LANES - x.p) + rate(LANES - x.q)}
        # the last level that is not empty is kept for texts without any other
        last = F.when(x.p + x.q > 0, F.struct(*[v.alias(n) for n, v in sums.items()])).otherwise(s["last"])
        return F.struct(opened.alias("opened"), *[(s[n] + F.when(opened, v).otherwise(0.0)).alias(n) for n, v in sums.items()], last.alias("last"))
    none = [F.lit(0.0).alias(n) for n in ("same", "apart", "both")]
    start = F.struct(F.lit(False).alias("opened"), *none, F.struct(*none).alias("last"))
    levels = F.sequence(F.lit(0), F.floor((F.greatest(F.size(a), F.size(b)) - TOTALS) / LANES).cast("int") - 1)
    share = lambda n: F.when(n.same > 0, F.greatest(1 - n.apart / n.both, F.lit(0.0))).otherwise(F.lit(0.0))
    total = F.aggregate(F.transform(levels, level), start, add)
    return F.when(a == b, F.lit(1.0)).otherwise(bound(total, lambda n: F.when(n.both > 0, share(n)).otherwise(share(n["last"]))))


def with_next(docs: DataFrame, *, carry: list[str], ids: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Add ``next_<c>`` for every column of ``carry``: its value in the next row in descending (doc_id, text) order.

    The order is cut into ``buckets`` ranges at approximate quantiles of doc_id. A range's last rows are repeated in the
    range above as guests, so one shuffle and a window per range suffice. The driver sees two numbers a range. ``ids`` is the same rows' doc_id where
    that is cheaper to read than ``docs``.
    """
    spark = docs.sparkSession
    ids = (docs if ids is None else ids).select("doc_id")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    found = ids.select(key.alias("k")).agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)] or [0.5], 100 * buckets).alias("q")).first()
    cuts = sorted(set(found.q or []))
    bucket = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < key)) if cuts else F.lit(0)
    tops = {r.b: r.k for r in ids.select(bucket.alias("b"), key.alias("k")).groupBy("b").agg(F.max("k").alias("k")).collect()}
    order = sorted(tops)
    above = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    # a map literal: bucket -> (its largest id, the bucket that gets those rows as guests)
    top = F.create_map(*[x for b in order for x in (F.lit(b), F.struct(F.lit(tops[b]).alias("k"), F.lit(above[b]).alias("b")))]) if order else None
    guest = bound(F.element_at(top, bucket), lambda t: F.when(t.k == key, t.b)) if order else F.lit(None).cast("int")
    seats = F.filter(F.array(F.struct(F.lit(False).alias("guest"), bucket.alias("b")), F.struct(F.lit(True).alias("guest"), guest.alias("b"))), lambda s: s.b.isNotNull())
    rows = docs.select("*", F.explode(seats).alias("__seat"))
    w = Window.partitionBy("__seat.b").orderBy(F.desc("__seat.guest"), F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    out = rows.select("*", *[F.lag(c).over(w).alias(f"next_{c}") for c in carry])
    return out.where(~F.col("__seat.guest")).drop("__seat")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, vector of every row."""
    return computed(only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))), vector=vector(F.col("text")))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness (the contract of op6)."""
    rows = with_next(fingerprints(docs), carry=["text", "vector"], ids=docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "vector", "next_vector",
                       F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = computed(rows, edited_sha256=F.sha2("edited", 256), edited_vector=vector(F.col("edited")))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("vector")).alias("fingerprint"),
                       as_text(F.col("edited_vector")).alias("edited_fingerprint"),
                       likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
                       likeness(F.col("vector"), F.col("next_vector")).alias("near_next"))
