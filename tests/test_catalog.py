"""Hand goldens for lookups and spec resolution."""

from pyspark.sql import functions as F

from revidence.operators import catalog as cat
from revidence.operators import specs
from revidence.sources import ingest


def test_lookup_product_exact_then_fuzzy(spark):
    corpus = spark.createDataFrame(
        [(0, "k_0", "Apple iPhone 15 Pro", "k_0"), (1, "k_1", "Samsung Galaxy S24", "k_1"),
         (2, "k_2", "Galaxy S24 Ultra", "k_2"), (3, "pixel_9a", "", "")],
        "corpus_idx BIGINT, id STRING, name STRING, key STRING")
    index = cat.alias_index(cat.alias_rows(corpus))
    queries = spark.createDataFrame(
        [(1, "galaxy s24"), (2, "S24 Ultra!"), (3, "iphone 15"), (4, "nothing here"), (5, ""), (6, "pixel 9a"),
         (7, "apple iphone 15 pro max 256gb"), (8, "15 Pro")], "qid INT, query STRING")
    got = {r.qid: (r.corpus_idx, r.how) for r in cat.lookup_product(queries, index, corpus).collect()}
    assert got[1] == (1, "exact")            # alias of product 1 (brand stripped); first wins over product 2
    assert got[2] == (2, "fuzzy")            # substring of product 2's name
    assert got[3] == (0, "fuzzy")            # not an alias: substring of product 0's name
    assert got[8] == (0, "exact")            # iPhone shorthand alias "15 pro"
    assert got[4] == (None, None) and got[5] == (None, None)
    assert got[6] == (3, "fuzzy")            # found through the id; the empty name matches nothing
    assert got[7] == (0, "fuzzy")            # the name is contained in the query


def test_spec_lookup_directions(spark):
    docs = spark.createDataFrame([(0, "Galaxy S24", "galaxy_s24"), (1, "Pixel 9", "google_pixel_9")],
                                 "corpus_idx BIGINT, name STRING, key STRING")
    q = spark.createDataFrame([(1, "galaxy s24"), (2, "my new Pixel 9 phone"), (3, "google pixel"), (4, "")],
                              "qid INT, query STRING")
    got = {r.qid: r.doc_id for r in specs.spec_lookup(q, docs).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: None}


def test_resolve_specs_priority(spark):
    spec_rows = [("a1", "k_a", "Phone A", 0, 0), ("a2", "k_b", "Phone B", 1, 1), ("a3", "k_c", "Phone B", 2, 2)]
    specs_df = spark.createDataFrame(spec_rows, "oid STRING, key STRING, name STRING, spec_ord BIGINT, spec_doc_id BIGINT")
    items = spark.createDataFrame(
        [(0, "a1", False, "whatever"), (1, "zz", False, "phone b"), (2, "k_a", True, "unknown"),
         (3, "k_a", False, "unknown"), (4, None, False, None)],
        "bundle_ord BIGINT, oid STRING, product_is_str BOOLEAN, product_name STRING")
    got = {r.bundle_ord: r.spec_doc_id for r in cat.resolve_specs(items, specs_df).collect()}
    assert got == {0: 0, 1: 2, 2: 0, 3: None, 4: None}   # by oid; by name (last wins); by key only for strings


def test_corpus_payload_write_read_append(spark, tmp_path):
    raw = [(0, '{"product": "k_a", "name": "Phone A", "comments": [{"body": "", "text": "t", "ups": "7", "upvotes": 3, "post_title": "x"}, 5, {"body": "b", "ups": 2}], "review_texts": ["r"]}'),
           (1, '{"product": {"$oid": "zz"}, "comments": [], "review_texts": []}')]
    b = ingest.parse_bundles(spark.createDataFrame(raw, "bundle_ord BIGINT, json STRING").select("bundle_ord", F.parse_json("json").alias("v")))
    specs_df = spark.createDataFrame([("a1", "k_a", "Spec A", 0, 7)], "oid STRING, key STRING, name STRING, spec_ord BIGINT, spec_doc_id BIGINT")
    items = b.select("bundle_ord", F.col("product_oid").alias("oid"), "product_is_str", "product_name")
    entries = cat.corpus_entries(ingest.dense_index(cat.resolve_specs(items, specs_df), ["bundle_ord"]), specs_df)
    texts = spark.createDataFrame([(7, '{"key": "k_a"}')], "spec_doc_id BIGINT, specifications STRING")
    c = cat.with_payload(entries, ingest.bundle_payload(b), texts)
    ingest.write_corpus(c, cat.alias_index(cat.alias_rows(c)), str(tmp_path / "c"), fmt="json")
    back, index = ingest.read_corpus(spark, str(tmp_path / "c"), fmt="json")
    got = {r.corpus_idx: r for r in back.collect()}
    assert [tuple(x) for x in got[0].reviews.comments] == [("t", 0, "x"), ("b", 2, None)] and got[0].reviews.review_texts == ["r"]
    assert (got[0].id, got[0].name, got[0].specifications) == ("k_a", "Spec A", '{"key": "k_a"}')
    assert (got[1].id, got[1].name, got[1].specifications) == ("zz", "Product_zz", None) and got[1].reviews.comments == []
    assert {"spec a", "k a"} <= {r.alias for r in index.where("corpus_idx = 0").collect()}
    new = b.where("product_name = 'Phone A'").join(ingest.bundle_payload(b, appended=True), "bundle_ord").select(F.lit("New One").alias("name"), (F.col("bundle_ord") + 3).alias("new_ord"), "reviews")
    add = {r.corpus_idx: r for r in cat.corpus_append(back, new).collect()}
    assert (add[2].id, add[2].key) == ("new_one", "") and [tuple(x) for x in add[2].reviews.comments] == [("t", 3, None), ("b", 2, None)]
    assert add[0].reviews == got[0].reviews and cat.corpus_append(back.limit(0), new).first().corpus_idx == 0
    plan = cat.corpus_append(back, new)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stale_index_positions_fall_through(spark):
    corpus = spark.createDataFrame([(0, "k_0", "Phone Alpha", "k_0"), (1, "k_1", "Phone Beta", "k_1")], "corpus_idx BIGINT, id STRING, name STRING, key STRING")
    index = spark.createDataFrame([("phone alpha", 9), ("phone beta", 1), ("gamma", 12)], "alias STRING, corpus_idx BIGINT")
    q = spark.createDataFrame([(1, "Phone Alpha"), (2, "phone beta"), (3, "Gamma")], "qid INT, query STRING")
    got = {r.qid: (r.corpus_idx, r.how) for r in cat.lookup_product(q, index, corpus).collect()}
    assert got == {1: (0, "fuzzy"), 2: (1, "exact"), 3: (None, None)}


def test_corpus_steps_broadcast_no_specs(spark):
    from pyspark.sql import functions as F
    items = spark.createDataFrame([(0, "1", False, "A"), (1, "k_2", True, ""), (2, None, False, "C")], "bundle_ord INT, oid STRING, product_is_str BOOLEAN, product_name STRING")
    specs_df = spark.createDataFrame([("1", "k_1", "A", 1, 1), ("2", "k_2", "B", 2, 2)], "oid STRING, key STRING, name STRING, spec_ord INT, spec_doc_id INT")
    res = cat.resolve_specs(items, specs_df).withColumn("corpus_idx", F.col("bundle_ord"))
    texts = specs_df.select("spec_doc_id", F.col("name").alias("specifications"))
    payload = items.select("bundle_ord", F.col("oid").alias("reviews"))
    full = cat.with_payload(cat.corpus_entries(res, specs_df), payload, texts)
    assert "Broadcast" not in full._jdf.queryExecution().toString()
    assert sorted((r.corpus_idx, r.name, r.reviews, r.specifications) for r in full.collect()) == [(0, "A", "1", "A"), (1, "B", "k_2", "B"), (2, "C", None, None)]
