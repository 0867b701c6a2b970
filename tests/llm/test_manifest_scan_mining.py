"""Merkle manifest, licence scan and collocations against brute force, with the odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from revidence.llm import collocations, licenses, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_tree(nodes):
    """(root, list of sibling lists of each leaf with their left sizes)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k in range(len(nodes)):
            i = at[k]
            r = i - i % 3
            paths[k].append((level[r:i], level[i + 1:r + 3]))
            at[k] = i // 3
        level = [h("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def climb(node, path):
    for left, right in path:
        node = h("".join(left) + node + "".join(right))
    return node


def brute_manifest(rows):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in rows:
        leaf = lambda text: h("".join(map(f, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
        groups[r["source"]].append((r["doc_id"], leaf(r["text"]), leaf(r["text"].replace("\n", "")) if bad else leaf(r["text"])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    low = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        low[s] = brute_tree([x[1] for x in groups[s]])
    root, tops = brute_tree([low[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (doc, leaf, changed), path in zip(groups[s], low[s][1]):
            folded = climb(climb(changed, path), top)
            out.append((doc, leaf, low[s][0], root, h("".join("".join(a + b) for a, b in path + top)), folded, folded == root))
    return sorted(map(str, out))


def test_manifest_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [dict(doc_id=i, text=rng.choice(["a\nb", "plain", "", None, "é\n\nü" * 3]), lang=rng.choice(["en", None]), source="hot" if i % 3 else rng.choice(["b", "Ü", None, "", "hot"]), n_chars=rng.choice([None, i])) for i in range(1100)]
    rows += [dict(doc_id=None, text="x", lang=None, source="b", n_chars=1), dict(doc_id=7, text="again", lang=None, source="hot", n_chars=1), *[dict(doc_id=9, text="same\n", lang="en", source="hot", n_chars=5)] * 3]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], DOCS).selectExpr("*", "1 as node", "2 as pos", "'x' as root", "3 as grp").repartition(7)
    assert sorted(str(tuple(r)) for r in merkle.verified_manifest(df).collect()) == brute_manifest(rows)


def test_manifest_of_few_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.verified_manifest(empty).collect() == []
    one = [dict(doc_id=1, text="a\n", lang=None, source=None, n_chars=None)]
    got = merkle.verified_manifest(spark.createDataFrame([tuple(one[0].values())], DOCS)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_manifest(one) and got[0].root == got[0].leaf and got[0].proof_sha256 == h("")


def test_proofs_are_of_logarithmic_size(spark):
    rows = spark.range(800).selectExpr("id as doc_id", "'s' as source", "sha2(cast(id as string), 256) as leaf")
    out = merkle.manifest(merkle.written(rows, "t"), "source", ["doc_id"], ["doc_id"]).selectExpr("size(path) n", "root", "leaf", "path").collect()
    assert {r.n for r in out} == {7}                                     # 3^6 < 800 <= 3^7; the one group's root is the root
    assert all(climb(r.leaf, [([s.left], [s.right]) for s in r.path]) == r.root for r in out)


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def brute_base(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(WORDS, lowered)
    places = [(i, label) for label, p in BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def _scan(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as words", "2 as places", "3 as n_words").repartition(3)
    return {r.doc_id: r for r in licenses.summary(licenses.scan(df)).collect()}


def test_licence_notices_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["MIT", "License", "license,", "apache", "General", "public", "the", "mit-license", "é", "İ", "2.0", "\x7f", "_", "general_public"]
    texts = [None, "", " .,\n", "mit license mit license", "MIT\n\nLicense", "mitlicense"] + [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))) for _ in range(300)]
    texts += ["mit license " * 50_000, "x " * 300_000 + "apache license"]  # a hot notice and a very long text
    got = _scan(spark, texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t and t[:80]
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.n_base == 0 or r.score == 1)


def test_licence_texts_are_found_at_their_places(spark):
    by = {(t.label, i): t for i, t in enumerate(licenses.TEXTS)}
    noise = "some words before the text of it and of any software "
    texts = [noise + t.text.upper() + " " + noise for t in by.values()]
    def shifted(t):
        w = [x.decode() for x in t.words]
        inside = {p + i for p, k in t.keys for i in range(1, len(k))}
        at = max(i for i in range(len(w) + 1) if i not in inside and i <= 0.8 * len(w))
        return noise + " ".join([*w[:at], "two", "more", *w[at:]])
    broken = [shifted(t) for t in by.values()]
    words_only = [" ".join(sorted(t.text.split())) for t in by.values()]  # the same words, out of place
    got = _scan(spark, texts)
    for i, (label, _) in enumerate(by):
        assert label in got[i].labels.split(","), label
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        mine = [p for p in r.places if not p.notice and p.accepted and p.label == list(by)[r.doc_id][0]]
        assert any(p.start == len(licenses.words_of(noise)) and p.coverage == 1 for p in mine)
    assert all(not {p.label for p in r.places if p.accepted and not p.notice} for r in licenses.scan(spark.createDataFrame(list(enumerate(words_only)), "doc_id long, text string")).collect())
    for i, r in _scan(spark, broken).items():
        assert list(by)[i][0] in r.labels.split(","), broken[i]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_word_frequent_in_the_corpus_is_not_what_a_file_looks_up(spark):
    t = licenses.Template("t", "alpha the beta the gamma", ("alpha the beta",))
    df = spark.createDataFrame([(i, "the the") for i in range(20)] + [(99, "so alpha the beta the gamma end")], "doc_id long, text string")
    idf = licenses.word_idf(df, [t])
    assert idf[b"alpha"] == idf[b"beta"] > idf[b"the"] and licenses.Index([t], idf).rare(t.places)[-1] == b"the"
    assert [tuple(p) for r in licenses.scan(df, [t]).where("doc_id = 99").collect() for p in r.places] == [("t", False, 1, 6, 1.0, True)]


def brute_collocations(rows, top, at_least):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = lang or "und" if lang is not None else "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", p)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= at_least}
        inside = defaultdict(int)
        for p, a in many.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        scored = []
        for p, a in many.items():
            if inside[p] >= a:
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(map(str, out))


def _texts(rng, n):
    words = [f"w{i}" for i in range(30)] + ["É", "straße", "日本", "a-b", "\xa0x"]
    phrases = [" ".join(rng.choices(words, k=5)) for _ in range(6)]
    piece = lambda: " ".join(rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words).upper() for _ in range(rng.randrange(1, 8)))
    return ["".join(piece() + rng.choice([". ", ",", "\n", "\r\n", "\t", "  ", "!?"]) for _ in range(rng.randrange(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("bits, size", [(32, 600), (32, 4 << 20), (4, 900)])
def test_collocations_equal_brute_force(spark, bits, size):
    """Many small blocks; one block; keys of 4 bits, where all phrases collide."""
    rng = random.Random(size)
    rows = [(t, rng.choice(["en", "en", "de", None, "und"])) for t in _texts(rng, 300)] + [(None, "en"), ("", "fr"), ("a a a a a a a a a a a a", "en"), ("a a a a a a a a a a a a", "en")]
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as doc_id", "2 as f", "3 as phrase", "4 as words").repartition(5)
    got = collocations.collocations(df, top=40, at_least=6, size=size, bits=bits)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_collocations(rows, 40, 6)


def test_collocation_scores_pass_64_bits(spark):
    rows = spark.createDataFrame([(3_000_000_000, 4_000_000_000_000_000_000, 3_100_000_000, 3_200_000_000)], "a long, n long, l long, r long")
    big = lambda c: f"cast({c} as decimal(19, 0))"
    got = rows.selectExpr(f"cast({big('a')} * {big('n')} as decimal(35, 0)) * cast(1000 as decimal(4, 0)) div ({big('l')} * {big('r')}) as s").first().s
    assert got == 1000 * 3_000_000_000 * 4_000_000_000_000_000_000 // (3_100_000_000 * 3_200_000_000)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), (" . ", None)], "text string, lang string"), at_least=1).collect() == []


def test_a_very_long_text_is_one_block(spark):
    text = ("all of these words " * 60_000).strip()
    got = collocations.collocations(spark.createDataFrame([(text, None)], "text string, lang string"), size=1 << 16)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_collocations([(text, None)], 2000, 100)


def test_licence_query_equals_sql_in_its_base_columns(spark):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    rows = con.execute(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()
    got = {r.doc_id: r for r in queries.op12_license_scan(spark, sf).collect()}
    for i, t in rows:
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == brute_base(t)
