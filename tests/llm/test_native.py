"""Operators 6, 9 and 10: native expressions against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from revidence.llm import mixing, multiset_hash, pii

DOCS = "doc_id long, text string, vector string, lang string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame([tuple(r) + (None,) * (len(schema.split(", ")) - len(r)) for r in rows], schema)


def test_fingerprint_is_order_free_and_incremental(spark):
    v = multiset_hash.vector
    row = spark.range(1).select(
        v(F.lit("a b.\nc d.\ne")).alias("abc"), v(F.lit("e\nc d.\na b.")).alias("cba"), v(F.lit("a b.\ne")).alias("ae"), v(F.lit("c d.")).alias("c"),
        v(F.lit("c d.\nc d.")).alias("cc"), v(F.lit("")).alias("none"), v(F.lit(None).cast("string")).alias("null")).select(
        "*", multiset_hash.combine(F.col("ae"), F.col("c")).alias("inserted"), multiset_hash.remove(F.col("abc"), F.col("c")).alias("removed")).first()
    assert row.abc == row.cba == row.inserted and row.removed == row.ae and row.cc != row.c
    assert row.none == row.null == [0] * multiset_hash.SIZE and max(row.abc) < 1 << 62


@pytest.mark.parametrize("n", [0, 1, 2, 57])
def test_edited_text_and_likeness(spark, n):
    rows = [(i * 7, None if i % 9 == 4 else "" if i % 9 == 5 else "\n".join(f"wörd{i + j} x" for j in range(i % 13)), "clash", "en") for i in range(n)]
    rows += rows[3:5] + ([(None, "no id")] if n > 2 else [])
    got = multiset_hash.edited_likeness(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for i, (k, t) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        h = len(t) // 2
        edited = t[:len(t) - h] + other[:h]
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), edited == t, other == t))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([w[:3] for w in want], key=key) == sorted([(g.doc_id, g.n_chars, g.edited_sha256) for g in got], key=key)
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    assert all((g.near_edited == 1) >= (g.fingerprint == g.edited_fingerprint) for g in got)
    assert len({g.fingerprint for g in got if g.n_chars == 0}) <= 1


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


FOUND = [("4111 1111 1111 1111", "card"), ("378282246310005", "card"), ("1999-02-28", "date"), ("31/12/2001", "date"), ("1.5.2020", "date"), ("219-09-9999", "ssn"),
         ("192.168.0.1", "ip"), ("Bob.Smith9@mail.example.com", "email"), ("(212) 555-1234", "phone"), ("+1 (743) 555-3824", "phone"), ("+49 30 1234567", "phone")]
KEPT = ["4111 1111 1111 1112", "2023-13-01", "31/31/2001", "666-12-1234", "256.1.1.1", "1234567890123456", "version 1.2", "at 10:30", "x@y", "1e5", "no data", "12345"]


def test_pseudonyms_keep_format_validate_and_link(spark):
    rows = [(i, f"see {v}, or {v}!!") for i, (v, _) in enumerate(FOUND)] + [(100 + i, f"a {v} b") for i, v in enumerate(KEPT)] + [(900, None), (901, "")]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, rows, "doc_id long, text string, pii_note string, hits string"), key="k").collect()}
    again = {r.doc_id: r for r in pii.pseudonymise(frame(spark, rows, "doc_id long, text string, pii_note string, hits string"), key="other").collect()}
    for i, (v, kind) in enumerate(FOUND):
        a, b = re.fullmatch(r"see (.*), or (.*)!!", got[i].text).groups()
        assert a == b != v and got[i].pii_kinds == [kind] * 2 and again[i].text != got[i].text, v
        if kind not in ("ip", "date"):
            assert re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", a))) == re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", v)))
        assert kind != "card" or luhn(a)
    for i, v in enumerate(KEPT):
        assert got[100 + i].text == f"a {v} b" and got[100 + i].pii_kinds == []
    assert got[900].text is None and got[901].text == "" and got[900].pii_kinds == []


def test_feistel_is_a_permutation(spark):
    out = spark.range(7 * 11).select(pii.feistel_pair(F.col("id") % 7, 7, F.floor(F.col("id") / 7), 11, key="k", tweak="t").alias("p")).collect()
    assert {(r.p.a, r.p.b) for r in out} == {(a, b) for a in range(7) for b in range(11)}
    texts = spark.range(1000).select(pii.feistel_text(F.lpad(F.col("id").cast("string"), 3, "0"), key="k", tweak="t").alias("s")).collect()
    assert len({r.s for r in texts}) == 1000 and all(re.fullmatch(r"\d{3}", r.s) for r in texts)


def notation(value):
    return re.sub(r"\d", "0", value)


def test_dates_are_permuted_one_to_one_in_their_notation(spark):
    """Every string that slashes, dots and dashes can write for the years 1900 to 2099, one-digit forms too."""
    import datetime as dt
    strings = set()
    for n in range((dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days):
        x = dt.date(1900, 1, 1) + dt.timedelta(n)
        strings |= {f"{x.year}-{x.month:02}-{x.day:02}"}
        for d in {f"{x.day}", f"{x.day:02}"}:
            for m in {f"{x.month}", f"{x.month:02}"}:
                strings |= {f"{d}.{m}.{x.year}", f"{d}/{m}/{x.year}", f"{m}/{d}/{x.year}"}
    table = spark.createDataFrame([(x,) for x in sorted(strings)], "s string").repartition(8)
    got = table.select("s", pii.date(F.col("s"), "k").alias("p")).toPandas()
    assert set(got.p) == strings and len(got) == len(strings)
    assert (got.s.map(notation) == got.p.map(notation)).all() and (got.s == got.p).mean() < 0.001
    odd = ["29/2/1900", "29.02.2001", "2001-02-30", "0/1/2000", "1.13.2000", "01/01/0050", "29/02/2400", "1999-00-10"]
    out = spark.createDataFrame([(x,) for x in odd], "s string").select("s", pii.date(F.col("s"), "k").alias("p")).collect()
    assert [r.s for r in out if r.p is not None] == ["29/02/2400"]


def test_counts_of_a_block_are_whole(spark):
    import numpy as np

    from revidence.llm import blocks
    counts = np.array([1, 254, 255, 256, 70_000, 3], np.int64)
    assert blocks.full(blocks.short(counts), len(counts)).tolist() == counts.tolist()
    keys = np.sort(np.array([5, 7 << 40, 9 << 50, 11 << 55, 3 << 60, 13 << 59], np.uint64))
    rows = [r for b in range(3) for r in blocks.packed(b, keys[b:], counts[b:], 4)]
    got = {}
    for r in blocks.totals(spark.createDataFrame(rows, blocks.KEYS), 1).collect():
        for k, n in zip(np.frombuffer(r.keys, np.uint64), np.frombuffer(r.counts, np.uint32)):
            assert got.setdefault(int(k), int(n)) == n
    assert got == {int(k): int(n) * min(i + 1, 3) for i, (k, n) in enumerate(zip(keys, counts))}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert pii.pseudonymise(none, key="k").count() == 0
    assert mixing.mix(none, none.select("text", F.col("lang").alias("domain")), {"en": 1, "de": 1}).count() == 0


def mixture(spark):
    words = {"en": "the of and", "de": "der und die"}
    rows = [(i, " ".join([words["en" if i % 4 else "de"]] * (1 + i % 5)), None, "en" if i % 4 else "de") for i in range(80)]
    return frame(spark, rows + rows[:2] + [(200, None), (201, ""), (None, "the of")])


def test_rates_meet_the_targets(spark):
    docs = mixture(spark)
    labelled = docs.where("lang is not null").select("text", F.col("lang").alias("domain"))
    got = mixing.mix(docs, labelled, {"en": 1, "de": 1}).toPandas()
    totals = [sum(r.rate * r.tokens * r.p[d] for r in got.itertuples()) for d in ("en", "de")]
    assert len(got) == docs.count() and got.rate.min() >= 0 and abs(totals[0] / sum(totals) - 0.5) < 0.01
    assert abs(sum(totals) / got.tokens.sum() - 1) < 0.01 and set(got[got.tokens == 0].rate) == {1.0}
    kept = mixing.mix(docs, labelled, {"en": 1, "de": 1}, floor=1.0, grow=True, keep=["doc_id", "text"]).toPandas()
    assert kept.copies.min() >= 1 and "text" in kept and kept.rate.min() >= 1
    same = mixing.mix(docs, labelled.limit(0), {"en": 3, "de": 1}).toPandas()
    assert abs(same.p[0]["en"] - 0.75) < 1e-6
