"""Goldens for parsers, projections and listings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from revidence.operators import catalog as cat
from revidence.operators import specs
from revidence.sources import ingest as ing
from revidence.sources.jsonscan import json_objects


def test_spec_html_parser_drops_untitled_rows(spark):
    html = ('<table><tr><th>Battery</th><td class="ttl">Type</td><td class="nfo"> Li-Ion <br> 5000 mAh </td></tr>'
            '<tr><td class="ttl"></td><td class="nfo">continued</td></tr>'
            '<tr><td class="ttl">Charging</td><td class="nfo">45W</td></tr></table>'
            '<table><tr><th>Main Camera</th><td class="xttlx">Single</td><td class="nfo">50 MP</td></tr></table>')
    df = spark.createDataFrame([(1, html)], "page_id BIGINT, html STRING")
    rows = [(r.section, r.title, r.value) for r in ing.spec_html_parse(df).orderBy("section_ord", "sub_ord").collect()]
    assert rows == [("Battery", "Type", "Li-Ion 5000 mAh"), ("Battery", "Charging", "45W"), ("Main Camera", "Single", "50 MP")]
    flat = {r.spec_key: r.spec_value for r in ing.html_specs_flat(ing.spec_html_parse(df)).collect()}
    assert flat["Main_Camera_Single"] == "50 MP"


def test_dense_index_over_many_partitions(spark):
    df = spark.range(60_000).select(((F.col("id") * 7919) % 60_000).alias("k"), F.repeat(F.lit("x"), 300).alias("wide")).repartition(24)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            out = ing.dense_index(df, ["k"]).select("k", "corpus_idx").collect()
            assert sorted(r.corpus_idx for r in out) == list(range(60_000)) and all(r.k == r.corpus_idx for r in out)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _odd_value(rng, depth=0):
    """Random JSON with braces, quotes and backslashes in its strings."""
    signs = ["{", "}", "[", "]", '"', "\\", ",", ":", "a", "é", "\n", " "]
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 2:
        return "".join(rng.choices(signs, k=rng.randrange(12)))
    if kind < 4:
        return rng.choice([None, True, 1, -2.5, 10**12])
    if kind == 4:
        return [_odd_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choices(signs, k=3)) + str(i): _odd_value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("split", [64, 1000, 1 << 27])
def test_json_objects_over_any_splits(spark, tmp_path, split):
    """Files read in splits of a few bytes: what a JSON parser finds, in order."""
    rng, want = random.Random(split), {}
    for f in range(6):
        values = [_odd_value(rng, 4) if rng.random() < 0.3 else {"n": i, "v": _odd_value(rng)} for i in range(rng.randrange(1, 40))]
        if f == 0:                                                       # objects one after the other
            values = [v for v in values if isinstance(v, dict)] or [{}]
            text = "\n".join(json.dumps(v) for v in values)
        elif f == 1:                                                     # two arrays in a file, pretty-printed
            text = json.dumps(values[:5], indent=2) + "\n" + json.dumps(values[5:], indent=1, ensure_ascii=False) + "\n"
        else:
            text = json.dumps(values, ensure_ascii=bool(f % 2))
        (tmp_path / f"f{f}.json").write_text(text)
        want[f"f{f}.json"] = [v for v in values if isinstance(v, dict)]
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text("[]\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = json_objects(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.record)):
        assert r.record == len(got.setdefault(r.file.rsplit("/", 1)[1], []))
        got[r.file.rsplit("/", 1)[1]].append(json.loads(r.json))
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("text", ['[{"a": 1}, {"b"', '[{"a": 1}', '{"a": {"b": 2}', '[{"a": "x}]'])
def test_a_file_that_is_cut_off_raises(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="not whole JSON"):
        json_objects(spark, str(tmp_path)).collect()


def test_a_large_file_is_read_by_many_tasks_and_loses_nothing(spark, tmp_path):
    bundle = lambda i: {"product": {"$oid": f"p{i}"}, "name": f"n{i}", "comments": [{"body": "x" * 200, "ups": j} for j in range(300)], "review_texts": []}
    (tmp_path / "big.json").write_text(json.dumps([bundle(i) for i in range(300)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() >= 15
        got = ing.load_bundles(spark, str(tmp_path)).selectExpr("bundle_ord", "product_oid", "size(comments) n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.bundle_ord, r.product_oid, r.n) for r in got) == [(i, f"p{i}", 300) for i in range(300)]


def test_a_bundle_beyond_one_variant_raises(spark, tmp_path):
    """Two bundles, one with 30 million small comments: an error, not an empty row."""
    with open(tmp_path / "two.json", "w") as f:
        f.write('[{"product": "p_1", "name": "a", "comments": [], "review_texts": []}, {"product": "p_2", "name": "b", "comments": [')
        f.write(",".join(["1"] * 30_000_000) + '], "review_texts": []}]')
    assert json_objects(spark, str(tmp_path)).selectExpr("record", "substring(json, 1, 16) j").collect() == [(0, '{"product": "p_1'), (1, '{"product": "p_2')]
    with pytest.raises(Exception):
        ing.load_bundles(spark, str(tmp_path)).select("product_oid").collect()


def test_listings(spark):
    data = lambda *xs: {"kind": "Listing", "data": {"children": [{"kind": "t", "data": x} for x in xs]}}
    search = [data({"id": "a", "title": "T1", "selftext": "s", "num_comments": 2, "permalink": "/a"}, {"id": "b", "num_comments": 0, "permalink": "/b"}, {"id": "c", "title": None, "num_comments": 4}), {"error": 404}]
    pages = spark.createDataFrame([(7, json.dumps(s)) for s in search] + [(7, "<html>"), (7, None)], "product_id BIGINT, json STRING")
    posts = ing.post_listings(pages)
    assert sorted(tuple(r) for r in posts.select("pos", "post_id", "title", "selftext", "num_comments", "permalink").fillna("-").collect()) == [
        (0, "a", "T1", "s", 2, "/a"), (1, "b", "", "", 0, "/b"), (2, "c", "", "", 4, "-")]
    replies = [("/a", json.dumps([data(), data({"body": "first", "ups": 3}, {"body": None}, {"ups": 1}, {"body": "last", "ups": "x"})])), ("/b", json.dumps([data(), data({"body": "unused"})])),
               ("/a2", json.dumps(data({"body": "no array"}))), ("/a3", json.dumps([data()]))]
    comments = ing.comment_listings(spark.createDataFrame(replies, "permalink STRING, json STRING"))
    got = ing.listed_comments(posts, comments).orderBy("c_pos").collect()
    assert [(r.post_id, r.title, r.c_pos, r.body, r.ups) for r in got] == [("a", "T1", 0, "first", 3), ("a", "T1", 1, None, None), ("a", "T1", 2, None, 1), ("a", "T1", 3, "last", None)]
    assert [r.body for r in ing.post_comments(ing.listed_comments(posts, comments), k=20, min_len=3).orderBy("c_pos").collect()] == ["T1. first", "T1. last"]


def test_flatten_specs_cases(spark):
    doc = {"_id": {"$oid": "a1"}, "key": "k", "name": "n", "specification": {"more_specification": [
        {"title": "Body", "data": [{"title": "Weight", "data": [" 200 g "]}]},
        {"title": "Misc", "data": []},
        {"title": "Launch", "data": "2024"},
        {"title": "Our Tests", "data": [{"title": "Battery", "data": [{"title": "Life", "data": ["10h", "x"]}]}]},
        {"title": "Body", "data": [{"title": "Weight", "data": ["201 g"]}]},
    ]}}
    df = spark.createDataFrame([(json.dumps(doc),)], "json STRING")
    flat = {r.spec_key: r.spec_value for r in specs.flatten_specs(specs.parse_spec_docs(df)).collect()}
    assert flat == {"Body_Weight": "201 g", "Launch": "2024", "Our_Tests_Battery_Life": "10h x"}


def test_comment_projection_fallbacks(spark):
    b = {"product": "k_1", "name": "x", "comments": [
        {"body": "b1", "ups": 3}, {"text": "t2", "upvotes": 4}, {"body": "", "text": "t3", "ups": True},
        {"body": "b4", "ups": None, "upvotes": "7"}, {"body": "b5", "post_title": "T"}], "review_texts": []}
    df = spark.createDataFrame([(0, json.dumps(b))], "bundle_ord BIGINT, json STRING")
    p = ing.parse_bundles(df.select("bundle_ord", F.parse_json("json").alias("v")), "v")
    rows = [(r.body, r.ups, r.post_title) for r in ing.bundle_comments(p, key="bundle_ord").orderBy("pos").collect()]
    assert rows == [("b1", 3, None), ("t2", 4, None), ("t3", 0, None), ("b4", 0, None), ("b5", 0, "T")]
    assert p.first().product_oid == "k_1" and p.first().product_is_str


def test_comment_limit_modes(spark):
    long, short = "x" * 40, "y" * 10
    rows = [(1, 1, i, body, 1, "T") for i, body in enumerate([short, long, short, long, long])]
    df = spark.createDataFrame(rows, "post_id BIGINT, product_id BIGINT, c_pos INT, body STRING, ups BIGINT, title STRING")
    public = [r.c_pos for r in ing.post_comments(df, k=3, min_len=30).collect()]
    api = [r.c_pos for r in ing.post_comments(df, k=3, min_len=30, count_kept_only=True).collect()]
    assert sorted(public) == [1] and sorted(api) == [1, 3, 4]


def test_post_cap_and_texts(spark):
    rows = [(i % 2, i, i, f"title {i}", "s" * (31 if i % 3 else 30)) for i in range(120)]
    df = spark.createDataFrame(rows, "product_id BIGINT, post_id BIGINT, pos BIGINT, title STRING, selftext STRING")
    capped = ing.post_cap(df, 50)
    assert ing.post_cap(df).count() == df.count()  # no cap unless asked for
    assert capped.count() == 100
    t = {r.post_id: r.review_text for r in ing.post_texts(df).collect()}
    assert t[1] == "title 1. " + "s" * 31 and t[3] == "title 3"


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7 % 1000).alias("k"))
    out = ing.dense_index(df, ["k"]).collect()
    assert sorted((r.k, r.corpus_idx) for r in out) == [(i, i) for i in range(1000)]


def test_alias_golden_compat(spark):
    df = spark.createDataFrame([("Apple iPhone 17 Pro Max", "apple_iphone_17_pro_max-13964")], "name STRING, key STRING")
    got = df.select(cat.generate_aliases(F.col("name"), F.col("key"), compat=True).alias("a")).first().a
    assert got == ["17 pro max", "17pm", "apple  17 pro max", "apple iphone 17 pro max", "apple iphone 17 pro max 13964",
                   "iphone 17 pro max", "pro max 17"]
    got2 = df.select(cat.generate_aliases(F.col("name"), F.col("key")).alias("a")).first().a
    assert "apple 17 pro max" in got2


def test_galaxy_pixel_aliases(spark):
    df = spark.createDataFrame([("Samsung Galaxy S24",), ("Google Pixel 9a",)], "name STRING")
    got = [r.a for r in df.select(cat.generate_aliases(F.col("name")).alias("a")).collect()]
    assert got == [["galaxy s24", "samsung galaxy s24"], ["google pixel 9a", "pixel 9a"]]


def test_contains_join_exact(spark):
    needles = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "zzz"), (4, "c")], "qid INT, needle STRING")
    hay = spark.createDataFrame([(10, "xabcx"), (11, "ab"), (12, "cc")], "hid INT, hay STRING")
    got = {(r.qid, r.hid) for r in cat.contains_join(needles, hay).collect()}
    brute = {(q, h) for q, n in [(1, "ab"), (2, "abc"), (3, "zzz"), (4, "c")]
             for h, s in [(10, "xabcx"), (11, "ab"), (12, "cc")] if n in s}
    assert got == brute


def test_load_bundles_from_json_files(spark, tmp_path):
    docs = [{"product": {"$oid": "abc"}, "name": "Pixel 9", "comments": [{"body": "great phone " * 10, "ups": 2}],
             "review_texts": ["solid battery life " * 6]},
            {"product": "k_2", "product_name": "Galaxy S24", "comments": [], "review_texts": []}]
    (tmp_path / "a.json").write_text(json.dumps(docs))
    (tmp_path / "b.json").write_text(json.dumps({"product": "k_3", "name": "Solo", "comments": [], "review_texts": []}))
    b = ing.load_bundles(spark, str(tmp_path))
    got = sorted((r.product_oid, r.product_is_str, r.product_name) for r in b.collect())
    assert got == [("abc", False, "Pixel 9"), ("k_2", True, "Galaxy S24"), ("k_3", True, "Solo")]
    reviews = ing.assemble_bundle_reviews(b.withColumn("bundle_ord", F.lit(0)), key="product_oid").collect()
    assert sorted((r.origin_ord, r.likes) for r in reviews) == [(0, 2), (1, None)]


def test_flatten_keeps_documents_deeper_than_the_cap(spark):
    node = {"title": "L9", "data": ["deep value"]}
    for i in range(8, 0, -1):
        node = {"title": f"L{i}", "data": [node]}
    doc = {"_id": {"$oid": "d"}, "specification": {"more_specification": [node, {"title": "Top", "data": ["x"]}]}}
    df = spark.createDataFrame([(json.dumps(doc),)], "json STRING")
    flat = {r.spec_key: r.spec_value for r in specs.flatten_specs(specs.parse_spec_docs(df), max_depth=4).collect()}
    assert flat["Top"] == "x"
    deep = [k for k in flat if k.startswith("L1_L2_L3_L4")]
    assert len(deep) == 1 and "deep value" in flat[deep[0]]
    full = {r.spec_key: r.spec_value for r in specs.flatten_specs(specs.parse_spec_docs(df), max_depth=10).collect()}
    assert full["L1_L2_L3_L4_L5_L6_L7_L8_L9"] == "deep value"


def test_flatten_specs_has_no_depth_limit(spark):
    node = {"title": 'quote " and {brace', "data": ["x"]}
    for i in range(11, 0, -1):
        node = {"title": f"L{i}", "data": [node]}
    docs = [{"_id": "deep", "specification": {"more_specification": [node, {"title": "Flat } \\", "data": ["y"]}]}},
            {"_id": "none", "specification": {"more_specification": []}}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "json STRING")
    flat = {r.spec_key: r.spec_value for r in specs.flatten_specs(specs.parse_spec_docs(df)).collect()}
    assert flat == {"_".join(f"L{i}" for i in range(1, 12)) + '_quote_"_and_{brace': "x", "Flat_}_\\": "y"}


def test_flatten_of_deep_documents(spark):
    """A worklist: the plan does not grow with the data. Levels with leaves beside the next section."""
    node = {"title": "L40", "data": ["bottom"]}
    for i in range(39, 0, -1):
        node = {"title": f"L{i}", "data": [{"title": f"S{i}", "data": [f"v{i}"]}, node] if i % 10 == 0 else [node]}
    df = spark.createDataFrame([(json.dumps({"_id": "deep", "specification": {"more_specification": [node]}}),), (json.dumps({"_id": "flat", "specification": {"more_specification": [{"title": "A", "data": "1"}]}}),)], "json STRING")
    flat = {(r.product_id, r.spec_key): r.spec_value for r in specs.flatten_specs(specs.parse_spec_docs(df)).collect()}
    assert flat[("flat", "A")] == "1" and len(flat) == 5
    assert flat[("deep", "_".join(f"L{i}" for i in range(1, 41)))] == "bottom"
    assert flat[("deep", "_".join(f"L{i}" for i in range(1, 31)) + "_S30")] == "v30"
