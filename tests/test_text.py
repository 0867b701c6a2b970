"""Golden rows for the cleaner, keys and relevance (hand-computed from the reference's rules)."""

import pytest
from pyspark.sql import functions as F

from revidence.functions import text as T


def one(spark, expr, *vals):
    cols = [f"c{i}" for i in range(len(vals))]
    df = spark.createDataFrame([tuple(vals)], ", ".join(f"{c} string" for c in cols))
    return df.select(expr(*[F.col(c) for c in cols]).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,expected", [
    ("see https://x.y/z?q=1 now", "see now"),
    ("go www.site.com ok", "go ok"),
    ("\U0001F600 great phone", "great phone"),
    ("it's \"fine\"", "its fine"),
    ("a/b \\/ c", "a, b, c"),
    ("one\ntwo\\n\\nthree", "one, two, three"),
    ("x , ,, , y", "x, , y"),
    ("日本 text here", "text here"),
    ("  ... Hello   world ", "Hello world"),
    ("!!!", ""),
    ("", ""),
])
def test_clean_text_rules(spark, raw, expected):
    assert one(spark, T.clean_text, raw) == expected


def test_clean_text_strict_keeps_cjk(spark):
    assert one(spark, lambda c: T.clean_text(c, strict_emoji=True), "ok 日本") == "ok 日本"


def test_word_count_boundary(spark):
    fifteen = " ".join(["w"] * 15)
    assert one(spark, T.word_count, fifteen) == 15
    assert one(spark, T.word_count, fifteen + " x") == 16
    assert one(spark, T.word_count, "   ") == 0


@pytest.mark.parametrize("text,name,score", [
    ("I love the iPhone 15 Pro!", "iPhone 15 Pro", 1.0),
    ("bathe andy", "the and", 1.0),                  # substring mid-word
    ("pro phone 15 iphone", "iPhone 15 Pro", 0.9),   # full coverage, not contiguous
    ("iphone pro", "iPhone 15 Pro", 0.9),            # 2.0 / 2.1 >= 0.75
    ("iphone 15", "iPhone 15 Pro", 0.7),             # 1.1 / 2.1 >= 0.5
    ("pro", "iPhone 15 Pro Max", 0.45),              # 1.0 / 3.1 >= 0.3
    ("15 only", "iPhone 15 Pro", 0.2),
    ("nothing here", "iPhone 15 Pro", 0.0),
    ("the zzz", "the the zzz", 0.7),                 # repeated token counts twice in total
    ("", "x", 0.0),
    ("abc", "", 0.0),
])
def test_match_score(spark, text, name, score):
    assert one(spark, T.match_score, text, name) == pytest.approx(score)


def test_keys(spark):
    assert one(spark, T.normalize_key, "  Galaxy-S24  Ultra!! ") == "galaxy s24 ultra"
    assert one(spark, T.compact_key, "Galaxy S_24 Ultra") == "galaxys24ultra"
    assert one(spark, T.slug_id, "Galaxy S24 Ultra") == "galaxy_s24_ultra"
    import hashlib
    assert one(spark, T.product_oid, "Pixel 9") == hashlib.md5(b"pixel 9").hexdigest()[:24]
    assert one(spark, T.url_quote, 'a b/"c"~*') == "a%20b/%22c%22~%2A"


def test_match_score_normalises_the_text_once(spark):
    from pyspark.sql import functions as F

    from revidence.functions import text as T
    rows = [("a great phone 15 pro", "Phone 15 Pro", 1.0), ("pro phone", "Phone 15 Pro", 0.9), ("procure a phones", "Pro Phone", 0.0), ("my galaxy s", "Galaxy S24 Ultra", 0.45),
            ("", "A", 0.0), ("x", "", 0.0), (None, "Phone", 0.0)]
    df = spark.createDataFrame(rows, "t STRING, n STRING, want DOUBLE").repartition(2)
    out = df.select("t", "n", "want", T.match_score(F.col("t"), F.col("n")).alias("got"))
    assert [(r.t, r.n) for r in out.collect() if r.got != r.want] == []
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(t") == 1
