"""Registered queries and the pipeline on the small tables."""

import hashlib
import re

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from revidence.llm import queries
from tests.llm.test_free import brute_components, brute_repeats

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels")


def test_one_query_a_number_and_the_pipeline():
    names = list(E.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(queries.SQL[name])
    columns = [d[0] for d in rel.description]
    want = sorted(map(str, rel.fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, SF).select(*columns).collect()) == want


def test_repeats_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(i, n, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()) for i, n, runs, kept in brute_repeats(rows)}
    assert {tuple(r) for r in queries.op3_repeated_passages(spark, SF).collect()} == want


def test_tokens_query_equals_tiktoken(spark):
    """The digests of ids and decoded bytes, against the library itself."""
    import base64

    import numpy as np
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(queries.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    reference = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(-1, None), (-2, ""), (-3, "a" * 70_000 + " é" * 9), (-3, "<|endoftext|> x"), (None, "null id")]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens").repartition(3)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.bpe_digests(docs).collect())
    files = {"path": public_tokenizers.path(queries.RANKS), "pattern": public_tokenizers.PATTERN}
    apart = queries.bpe_tree.decode(queries.bpe_tree.encode(docs, **files), **files).collect()
    assert sorted(str((r.doc_id, r.n_tokens, sha(r.ids), sha(r.decoded))) for r in apart) == sorted(map(str, want))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "pii", "mixing", "bpe"]
    before = {r.doc_id: r.asDict() for r in docs.collect()}
    out, ids = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, out, SF).collect()
        if name != "bpe":
            assert [f for f in rows[0].asDict()] == corpus_pipeline.COLUMNS
            ids[name] = {r.doc_id for r in rows}
            out = spark.createDataFrame(rows, docs.schema).repartition(2)
        if name == "toxicity":
            scored = {r.doc_id: r.predicted for r in queries.op4_toxicity(spark, SF).collect()}
            assert ids[name] == {i for i, p in scored.items() if not p}
        elif name == "near_duplicates":
            want = brute_components([(i, before[i]["text"]) for i in ids["toxicity"]], 5, 80)
            assert ids[name] == {c for _, _, c in want} and len(rows) == len(ids[name])
        elif name == "pii":
            assert ids[name] == ids["near_duplicates"] and not any(re.search(r"\d{16}", x) and x in before[r.doc_id]["text"] for r in rows for x in re.findall(r"4\d{15}", r.text))
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "mixing":
            assert ids[name] == ids["pii"] and len(rows) >= len(ids["pii"])
    assert {r.doc_id for r in rows} == ids["mixing"] and all(r.n_tokens >= 0 for r in rows)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, rows))


def test_stages_survive_an_empty_table(spark):
    out = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        assert out.count() == 0
