"""Cross-engine parity: Spark column functions vs their DuckDB twins on random strings."""

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revidence.functions import text as T
from revidence.plans import oracle_sql as O

PIECES = [" ", "  ", "\t", "\n", "\\n", " ", "　", " ", "\x85", "'", '"', "/", "\\/", ",", " , ,, ",
          "https://x.example/a?b=1", "www.y.example", "\U0001F600", "日本", "é", "abc", "The", "12", "pro", "zz",
          "!!", "-", "_"]
texts = st.lists(st.sampled_from(PIECES), min_size=0, max_size=25).map("".join)


@settings(max_examples=40, deadline=None)
@given(st.lists(texts, min_size=1, max_size=8))
def test_cleaner_and_keys_match_duckdb(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i INT, x STRING")
    got = [(r.c, r.w, r.n) for r in df.orderBy("i").select(
        T.clean_text(F.col("x")).alias("c"), T.word_count(T.clean_text(F.col("x"))).alias("w"),
        T.normalize_key(F.col("x")).alias("n")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT * FROM (SELECT unnest($1) AS x, generate_subscripts($1, 1) AS i)", [xs])
    exp = con.execute(f"SELECT {O.clean_text('x')}, {O.word_count(O.clean_text('x'))}, {O.normalize_key('x')} "
                      "FROM t ORDER BY i").fetchall()
    assert got == [tuple(e) for e in exp]


names = st.lists(st.sampled_from(["the", "and", "pro", "12", "7a", "galaxy", "x", "of", "que"]), min_size=0, max_size=4).map(" ".join)
bodies = st.lists(st.sampled_from(["the", "and", "pro", "12", "7a", "galaxy", "x", "of", "que", "bathe", "andy", "progalaxy"]),
                  min_size=0, max_size=12).map(" ".join)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(bodies, names), min_size=1, max_size=8))
def test_match_score_matches_duckdb(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, t STRING, n STRING")
    got = [r.s for r in df.orderBy("i").select(T.match_score(F.col("t"), F.col("n")).alias("s")).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE p AS SELECT * FROM (SELECT unnest($1) AS t, unnest($2) AS n, generate_subscripts($1, 1) AS i)",
                [[a for a, _ in pairs], [b for _, b in pairs]])
    exp = [r[0] for r in con.execute(
        f"SELECT {O.match_score_norm(O.normalize_key('t'), O.normalize_key('n'))} FROM p ORDER BY i").fetchall()]
    assert got == exp


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(texts, names), min_size=1, max_size=6))
def test_sql_functions_equal_column_functions(spark, rows):
    from revidence.functions.sql import register_sql_functions
    register_sql_functions(spark)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i INT, x STRING, n STRING")
    df.createOrReplaceTempView("parity_rows")
    via_sql = spark.sql("SELECT i, clean_text(x) AS c, clean_text_strict(x) AS cs, word_count(x) AS w, "
                        "normalize_key(x) AS k, compact_key(x) AS ck, match_score(x, n) AS m FROM parity_rows ORDER BY i").collect()
    via_col = df.orderBy("i").select(
        "i", T.clean_text(F.col("x")).alias("c"), T.clean_text(F.col("x"), True).alias("cs"), T.word_count(F.col("x")).alias("w"),
        T.normalize_key(F.col("x")).alias("k"), T.compact_key(F.col("x")).alias("ck"),
        T.match_score(F.col("x"), F.col("n")).alias("m")).collect()
    assert [tuple(r) for r in via_sql] == [tuple(r) for r in via_col]


HARD = PIECES + ["İ", "K", "\\", "\\n", "n", "\\/n", "\\'n", "É", "ß", "ﬁ", "1", "a", " \t", "​", "Ⓜ", "©"]
hard_texts = st.lists(st.sampled_from(HARD), min_size=0, max_size=30).map("".join)


@settings(max_examples=120, deadline=None)
@given(st.lists(hard_texts, min_size=1, max_size=10))
def test_relevance_form_equals_normalized_clean(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i INT, x STRING")
    rows = df.select(T.normalize_key(T.clean_text(F.col("x"))).alias("a"), T.relevance_form(F.col("x")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
