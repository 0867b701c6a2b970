"""Operators 1 to 5, 7 and 8 against plain Python."""

import base64
import hashlib
import io
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revidence.llm import bpe_tree, maxscore, ngram_join, quality_fm, repeats, toxicity, warc
from revidence.llm.common import held_out, labelled_sample

TEXTS = "doc_id long, text string, block long, keys string"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], TEXTS)


# 1 ---------------------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("min_bytes", [0, 5])
def test_archives_come_back(spark, min_bytes):
    html = ["<p>é</p>" * 50, "", None, "a\r\n\r\nWARC/1.1\r\n", "a", "abcdef"]
    rows = [(i, None if i % 5 == 0 else f"http://x/\r\n{i}", html[i % 6], "clash") for i in range(40)] + [(99, "u", "x" * 3_000_000, "c"), (None, "u", "abcdef", "c")]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3), min_bytes=min_bytes).collect()
    top = defaultdict(lambda: -1)
    for i, _, h, _ in rows:
        top[h or ""] = max(top[h or ""], -1 if i is None else i)
    want = {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        response = top[h or ""] == i or len(b) < min_bytes
        want[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else top[h or ""])
    assert len(got) == len(rows) and {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want


def test_members_stand_alone_and_index_points_at_them(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").coalesce(2)
    warc.write_monolithic(pages, raw)
    index = warc.normalise(spark, raw, out).collect()
    assert len(index) == 20
    for r in index:
        data = open(r.archive.removeprefix("file:"), "rb").read()[r.offset:r.offset + r.length]
        assert zlib.decompress(data, 31).startswith(b"WARC/1.1\r\n") and r.record_id.encode() in zlib.decompress(data, 31)
    none = warc.archived(pages.limit(0))
    assert none.count() == 0


def test_inflate_reads_many_members_and_rejects_torn_records():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    z = lambda b: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + c.flush()
    assert len(list(warc.split_records(warc.inflate(io.BytesIO(z(record) + z(record * 2)))))) == 3
    with pytest.raises(ValueError):
        list(warc.split_records(iter([record[:-5]])))


# 2, 4 ------------------------------------------------------------------------------------------------------------------------------
def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    size = quality_fm.BUCKETS + quality_fm.STATISTICS * quality_fm.LEVELS
    m = quality_fm.Model(0.3, rng.normal(size=size), rng.normal(size=(size, 3)))
    x, v = quality_fm.features("The cat sat on the mat. The end!")
    pairs = sum(m.v[x[i]] @ m.v[x[j]] * v[i] * v[j] for i in range(len(x)) for j in range(i))
    assert abs(m.margin(x, v) - (0.3 + m.w[x] @ v + pairs)) < 1e-9


def corpus(spark, bad):
    random.seed(1)
    vocabulary = ["river", "house", "letter", "garden", "winter", "number", "people", "market", "school", "friend"]
    rows = []
    for i in range(300):
        label = i % 3 == 0
        words = random.choices(vocabulary, k=20)
        rows.append((i, bad(words) if label else " ".join(words), int(label)))
    docs = texts(spark, [(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1001, "")])
    return docs, spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(5, None, None)], "doc_id long, quality int, toxic int"), {i: y for i, _, y in rows}


def accuracy(scored, truth, at):
    p = [r for r in scored.where(held_out(F.col("doc_id"))).collect() if r.doc_id in truth]
    return sum((r.score >= at) == truth[r.doc_id] for r in p) / len(p)


def test_quality_generalises_and_scores_every_row(spark):
    docs, labels, truth = corpus(spark, lambda w: " ".join(x + "###" for x in w))
    sample = labelled_sample(docs, labels, "quality", 200)
    assert sample.where(held_out(F.col("doc_id"))).count() == 0 and sample.count() <= 200
    out = quality_fm.score(docs, quality_fm.train(sample))
    assert out.count() == 303 and out.where("score is null or score < 0 or score > 1").count() == 0 and accuracy(out, truth, 0.5) > 0.95
    assert quality_fm.score(docs, quality_fm.train(sample.limit(0))).select("score").distinct().collect()[0].score == 0.5
    assert quality_fm.score(docs.limit(0), quality_fm.train(sample)).count() == 0


def test_toxicity_restores_disguised_words(spark):
    docs, labels, truth = corpus(spark, lambda w: " ".join([*w[:10], "stupid", "worthless", *w[10:]]))
    model = toxicity.train(docs, labelled_sample(docs, labels, "toxic", 1000))
    out = toxicity.score(docs, model)
    assert out.count() == 303 and out.where("score is null").count() == 0 and accuracy(out, truth, 0.7) > 0.95
    restore = toxicity.Restorer(model.speller).restored
    assert [restore(x) for x in ("$tup1d", "s t u p i d", "w0rthl3ss", "river", "House.")] == ["stupid", "stupid", "worthless", "river", "House."]
    hidden = texts(spark, [(1, "the river $tup1d and w0rthl3ss"), (2, "the river s t u p i d w.o.r.t.h.l.e.s.s"), (3, "river ### house!!! 4 winter 2024 garden")])
    scores = {r.doc_id: r.score for r in toxicity.score(hidden, model, keep=["doc_id", "block"]).collect()}
    assert scores[1] > 0.7 and scores[2] > 0.7 and scores[3] < 0.5
    assert toxicity.score(docs, toxicity.train(docs, labelled_sample(docs, labels.limit(0), "toxic", 10))).where("score < 0.7").count() == 303
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_viterbi_finds_the_best_of_all_readings():
    rng = np.random.default_rng(3)
    speller = toxicity.Speller(rng.random((toxicity.SYMBOLS,) * 3).astype(np.float32))

    def cost(reading):
        ids = [0, 0, *(toxicity._ID.get(c, 0) for c in reading), 0]
        return sum(speller.rows[a][b][c] for a, b, c in zip(ids, ids[1:], ids[2:]))
    signs = list("abot10@$!*lé") + ["oo", "ttt", "с", "у"]
    for k in range(60):
        token = "".join(rng.choice(signs, 6))
        for places, got in ((speller.lattice(token), speller.decode(token)),
                            (speller.spelled_lattice(" ".join(token[:5])), speller.decode_spelled(" ".join(token[:5])))):
            readings = [("".join(x for x, _ in p), sum(c for _, c in p)) for p in itertools.product(*places)]
            best = min(cost(r) + c for r, c in readings)
            assert any(r == got and abs(cost(r) + c - best) < 1e-6 for r, c in readings), token


def test_toxicity_of_spelled_out_and_long_tokens(spark):
    docs, labels, truth = corpus(spark, lambda w: " ".join([*w[:10], "stupid", "worthless", *w[10:]]))
    model = toxicity.train(docs, labelled_sample(docs, labels, "toxic", 1000))
    bad = ["such a s t u p i d river", "r i v e r s t u p i d h o u s e", "the " + "s" * 45 + "tupid house", "s\u200btupid w0rthless", "stуpid", "w0" + "r" * 50 + "thless",
           "y o u s t u p i d", "w-o-r-t-h-l-e-s-s"]
    clean = ["r i v e r h o u s e", "the " + "r" * 45 + "iver", "a1b2" * 5000, "a b c d e f g", "1 2 3 4 5 6", "- - - -", "река дом река", "= = x =", "river"]
    both = texts(spark, list(enumerate(bad + clean)))
    got = {r.doc_id: r.score for r in toxicity.score(both, model).collect()}
    plain = toxicity.score(texts(spark, [(0, "stupid")]), model).first().score
    assert {i for i, s in got.items() if s >= plain - 1e-6} == set(range(len(bad))), (plain, got)
    restore = toxicity.Restorer(model.speller).restored
    assert [restore(x) for x in ("s" * 45 + "tupid", "st\u200bupid", "stуpid", "1 2 3 4 5")] == ["stupid", "stupid", "stupid", "1 2 3 4 5"]


def test_language_model_counts_all_documents(spark):
    docs = texts(spark, [(1, "abc"), (2, "abc abc"), (3, None)])
    assert toxicity.trigram_counts(docs).agg(F.sum("n")).first()[0] == 3 + 7


# 3 ---------------------------------------------------------------------------------------------------------------------------------
def brute_repeats(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - n + 1) if i is not None else ():
            first[b[j:j + n]] = min(first.get(b[j:j + n], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1) if i is not None else ():
            if first[b[j:j + n]] < i:
                gone[j:j + n] = b"\1" * n
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(b), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def repeat_rows(seed, alphabet="abcdefgh "):
    r = random.Random(seed)
    word = lambda n: "".join(r.choices(alphabet, k=n))
    shared = [word(n) for n in (49, 50, 51, 80, 200, 700)]
    rows = []
    for i in range(60):
        parts = [word(r.randint(0, 90))]
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a = r.randint(0, max(0, len(s) - 55))
            parts += [s[a:] if r.random() < 0.5 else s, word(r.randint(0, 40))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[7][1]), (101, rows[7][1]), (101, rows[7][1]), (102, "a" * 400), (103, "b" + "a" * 120 + "é" * 30), (104, "ab" * 90), (105, "x" + "ab" * 60), (106, None), (107, ""),
             (108, "\0" * 70), (109, "y" + "\0" * 60), (None, rows[3][1]), (-5, "é" * 40 + rows[9][1])]
    return rows


@pytest.mark.parametrize(("seed", "hot", "size"), [(1, 1 << 16, 2000), (2, 1 << 16, 1 << 20), (3, 2, 2000), (4, 0, 3000)])
def test_repeats_equal_brute_force(spark, seed, hot, size):
    rows = repeat_rows(seed, "ab" if seed == 2 else "abcdefgh ")
    got = repeats.without_repeats(texts(spark, rows), hot=hot, block_bytes=size).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, r.n_bytes, list(zip(r.starts, r.ends)), bytes(r.kept)) for r in got], key=key) == sorted(brute_repeats(rows), key=key)


def test_repeats_of_an_empty_table(spark):
    assert repeats.without_repeats(texts(spark, []).limit(0)).count() == 0


@given(st.lists(st.text("ab", min_size=1, max_size=8), min_size=2, max_size=12, unique=True))
@settings(max_examples=60, deadline=None)
def test_intervals_are_the_groups_of_common_prefixes(words):
    words.sort()
    lcp = [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(words, words[1:])]
    want = set()
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            depth = min(lcp[i:j])
            a, b = i, j
            while a > 0 and lcp[a - 1] >= depth:
                a -= 1
            while b < len(words) - 1 and lcp[b] >= depth:
                b += 1
            want.add((a, b, depth))
    assert set(repeats.intervals(lcp)) == want


# 5 ---------------------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("scale", "shard", "block"), [(1, 16, 3), (1, 1000, 1000), (10**6, 16, 4)])
def test_top_k_equals_brute_force(spark, scale, shard, block):
    r = np.random.default_rng(scale)
    rows = [(int(i), (np.round(r.normal(size=9), 1) * scale).tolist()) for i in range(120)]
    rows += [(200, rows[3][1]), (201, None), (202, [1.0, None]), (203, [float("nan")]), (204, [float("inf")]), (220, [0.5, 0.5]), (None, [1.0]), (240, [])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = maxscore.top_k(df.select("vec_id", maxscore.quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 20 == 0, 7, shard=shard, block=block).collect()
    ok = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ok if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q)[:7]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("scale", [1, 1 << 40])
def test_thresholds_rise_and_spare_postings(scale):
    rng = np.random.default_rng(5)
    n, D, k = 3000, 32, 5
    X = (rng.normal(0, 12, (n, D)) * np.linspace(3, 0.2, D) * rng.uniform(0.1, 1, (n, 1))).astype(np.int64) * scale
    X[100:140] = X[7]  # ties
    ids, at = rng.permutation(n), np.arange(0, n, 150 if scale > 1 else 20)
    scores = X.astype(object) @ X[at].astype(object).T
    read = {}
    for chunk in (n, 100):
        read[chunk] = []
        for q, (qid, got, s) in enumerate(maxscore.top_of_cell(ids, X, ids[at], X[at], k, chunk=chunk, touched=read[chunk])):
            want = sorted((-scores[j, q], ids[j]) for j in range(n) if j != at[q])[:k]
            assert qid == ids[at[q]] and [(-int(b), a) for a, b in zip(got, s)] == want
    assert sum(read[n]) == n * D * len(at) and sum(read[100]) < 0.5 * sum(read[n])


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, v array<long>")
    assert maxscore.top_k(empty, F.col("vec_id") % 20 == 0, 5).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------------------------
def brute_components(rows, n, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= percent * len(x | y):
                a_, b_ = find(i), find(j)
                parent[max(a_, b_)] = min(a_, b_)
    return sorted((i, len(x), find(i)) for i, x in sets)


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 60, 3)])
def test_components_equal_brute_force(spark, n, percent, seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 4000)}"
    common = [word() for _ in range(60)]
    rows = []
    for base in range(6):
        text = [word() for _ in range(r.randint(20, 90))]
        for k in range(12):
            t = list(text)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = word()
            rows.append((len(rows) * 3, " ".join(t + common[:r.choice([0, 0, 60])])))
    rows += [(1000 + i, " ".join(common[:55 + i])) for i in range(5)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "A b"), (2004, "a\x0bB"), (2005, "a b c"), (2006, rows[4][1].upper()), (2006, rows[4][1].upper()), (None, "a b")]
    got = ngram_join.near_duplicates(texts(spark, rows), n=n, percent=percent).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(x) for x in got if x.doc_id is not None) == brute_components(rows, n, percent)


def test_components_of_a_chain_and_of_nothing(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    out = dict(map(tuple, ngram_join.components(links).collect()))
    assert out == {**dict.fromkeys(range(1, 41), 1), 90: 90, 95: 90, 100: 90}
    assert ngram_join.near_duplicates(texts(spark, []).limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------------------------
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return bpe_tree.Tokenizer(PATH, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.lists(st.one_of(st.sampled_from(["the", "ing", " ", "  ", "\n", "a", "!", "0", "'s", "\x1c", "\x85", " ", "é", "日", "😀"]), st.text(max_size=8)), max_size=30), st.integers(1, 40))
@settings(max_examples=150, deadline=None, suppress_health_check=[])
def test_tokens_equal_the_plain_encoder(pair, parts, times):
    mine, other = pair
    for text in ("".join(parts), "".join(parts[:2]) * times):
        ids = np.frombuffer(mine.encode(text), "<u4")
        assert ids.tolist() == other.encode_ordinary(text) and mine.decode(ids) == text.encode()


def test_join_equals_encoding_the_whole(pair):
    mine, _ = pair
    r = random.Random(3)
    for _ in range(300):
        data = bytes(r.choices(b"aaaabct!!-e ", k=r.randint(2, 70)))
        cut = r.randrange(1, len(data))
        assert list(mine.join(tuple(mine.merge(data[:cut])), tuple(mine.merge(data[cut:])))) == mine.merge(data)


def test_encode_and_decode_rows(spark):
    rows = [(1, None), (2, ""), (3, "Hello wörld  \n"), (3, "Hello wörld  \n"), (4, "x" * 200_000), (None, "a")]
    files = {"path": PATH, "pattern": public_tokenizers.PATTERN}
    got = bpe_tree.decode(bpe_tree.encode(texts(spark, rows), **files), **files).collect()
    assert sorted(((r.doc_id or 0), bytes(r.decoded)) for r in got) == sorted(((i or 0), (t or "").encode()) for i, t in rows)
    assert all(len(r.ids) == 4 * r.n_tokens for r in got) and bpe_tree.encode(texts(spark, []).limit(0), **files).count() == 0
