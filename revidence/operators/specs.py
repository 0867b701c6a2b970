"""Specification documents (H1-H5): VARIANT flattening, key drop, fuzzy lookup, pivot.

A spec document is ``{_id:{$oid}, key, name, specification:{key, more_specification:[{title, data}]}}``
where ``data`` is a list of strings (leaf), a list of ``{title, data}`` objects (a section; an
empty list is a section with nothing in it), or a scalar (leaf). Flattening walks the tree
level by level with ``explode`` (no Python) from a worklist of open sections, carries the position path,
and resolves duplicate keys with ``max_by(value, path)`` = last in document order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revidence import dims
from revidence.functions import text as T
from revidence.functions.columns import computed
from revidence.session import ensure_checkpoint_dir


def parse_spec_docs(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """(product_id, key, name, entries ARRAY<VARIANT>) from JSON text documents."""
    v = computed(raw.select(json_col), v=F.parse_json(F.col(json_col)))   # parsed once, also under filters
    return v.select(
        F.coalesce(F.try_variant_get("v", "$._id['$oid']", "string"),
                   F.try_variant_get("v", "$._id", "string")).alias("product_id"),
        F.try_variant_get("v", "$.key", "string").alias("key"),
        F.try_variant_get("v", "$.name", "string").alias("name"),
        F.coalesce(F.try_variant_get("v", "$.specification.more_specification", "array<variant>"),
                   F.array().cast("array<variant>")).alias("entries"),
    )


#: Levels that one pass over the nodes resolves.
LEVELS = 4


def flatten_specs(docs: DataFrame, id_col: str = "product_id", max_depth: int | None = None) -> DataFrame:
    """(id, spec_key, spec_value): title path joined by '_', spaces -> '_'; list leaves joined by
    a space (items stripped); scalar leaves kept; last duplicate wins; outer '_' stripped.

    A worklist: a pass explodes section nodes into their children for LEVELS levels, hands leaves on as they are, and is written; only nodes that are
    still sections go into the next pass, until none is left. Documents are read once, and no plan is longer than one pass, however
    deep they are (the JSON parser takes 1,000 levels of brackets, two a section). ``max_depth`` stops there and keeps what lies deeper as JSON text.
    """
    spark = docs.sparkSession
    nodes = docs.select(id_col, F.posexplode("entries").alias("p", "e")) \
        .select(id_col, F.array("p").alias("path"), F.lit("").alias("parent"), "e")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/spec-nodes-{uuid.uuid4().hex}"
    done, paths = 0, []
    while True:
        levels = LEVELS if max_depth is None else min(LEVELS, max_depth - done)
        rows = _resolve(nodes, id_col, levels)
        done += levels
        paths.append(f"{folder}/{done}")
        rows.write.parquet(paths[-1])
        read = spark.read.schema(rows.schema)
        open_ = read.parquet(paths[-1]).where(F.col("k").isNull())
        if done == max_depth or not open_.limit(1).count():
            break
        nodes = open_.select(id_col, "path", "parent", F.parse_json("rest").alias("e"))
    out = read.parquet(*paths).where(F.col("k").isNotNull()).select(id_col, "path", "k", "spec_value")
    if done == max_depth:
        e = F.parse_json("rest")
        out = out.unionByName(open_.select(id_col, "path", F.concat_ws("_", "parent", _title(e)).alias("k"), F.to_json(F.try_variant_get(e, "$.data", "variant")).alias("spec_value")))
    key = F.regexp_replace("k", "^_+|_+$", "")
    return out.groupBy(id_col, key.alias("spec_key")).agg(F.max_by("spec_value", "path").alias("spec_value"))


def _title(e: Column) -> Column:
    return F.replace(T.ws_trim(F.coalesce(F.try_variant_get(e, "$.title", "string"), F.lit(""))), F.lit(" "), F.lit("_"))


def _resolve(nodes: DataFrame, id_col: str, levels: int) -> DataFrame:
    """(id, path, parent, k, spec_value, rest): leaves with their key k, open sections with k null and themselves as JSON text in rest."""
    node_t = "struct<path:array<int>,parent:string,e:variant,k:string,spec_value:string>"
    rows = nodes.select(id_col, F.struct("path", "parent", "e", F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("spec_value")).alias("n"))
    for _ in range(levels):
        e = F.col("n.e")
        title = _title(e)
        data = F.try_variant_get(e, "$.data", "variant")
        arr = F.try_variant_get(data, "$", "array<variant>")
        is_section = arr.isNotNull() & F.forall(arr, lambda x: (
            F.schema_of_variant(x).startswith("OBJECT")
            & F.try_variant_get(x, "$.title", "variant").isNotNull()
            & F.try_variant_get(x, "$.data", "variant").isNotNull()))
        parent = F.col("n.parent")
        leaf = F.struct(
            F.col("n.path").alias("path"), parent.alias("parent"), F.lit(None).cast("variant").alias("e"),
            F.when(parent != "", F.concat_ws("_", parent, title)).otherwise(title).alias("k"),
            F.when(arr.isNotNull(), F.array_join(F.transform(arr, lambda x: T.ws_trim(x.cast("string"))), " "))
            .otherwise(F.try_variant_get(data, "$", "string")).alias("spec_value"))
        children = F.transform(arr, lambda x, i: F.struct(
            F.concat(F.col("n.path"), F.array(i)).alias("path"), F.concat_ws("_", parent, title).alias("parent"),
            x.alias("e"), F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("spec_value")))
        nxt = (F.when(F.col("n.k").isNotNull(), F.array(F.col("n")))
               .when(is_section, children)
               .otherwise(F.array(leaf))).cast(f"array<{node_t}>")
        rows = rows.select(id_col, F.explode(nxt).alias("n"))
    return rows.select(id_col, "n.path", "n.parent", "n.k", "n.spec_value", F.to_json("n.e").alias("rest"))


def drop_spec_keys(flat: DataFrame, keys=None) -> DataFrame:
    """H2: remove listed keys (anti join with a broadcast list of fixed size)."""
    spark = flat.sparkSession
    drop = spark.createDataFrame([(k,) for k in (dims.DROP_SPEC_KEYS if keys is None else keys)], "spec_key STRING")
    return flat.join(F.broadcast(drop), "spec_key", "left_anti")


def product_specs(flat: DataFrame, drop_columns=None) -> DataFrame:
    """H3: flatten + drop. ``drop_columns=None`` keeps every key (the reference returns nothing then)."""
    return flat if drop_columns is None else drop_spec_keys(flat, drop_columns)


def specs_wide(flat: DataFrame, id_col: str = "product_id", keys=None) -> DataFrame:
    """H5: one column per spec key, fixed key list (no data-driven pivot discovery)."""
    keys = keys if keys is not None else sorted({k for ks in dims.TOP_TO_SPECS.values() for k in ks})
    return flat.groupBy(id_col).pivot("spec_key", keys).agg(F.first("spec_value"))


def spec_lookup(queries: DataFrame, docs: DataFrame, q_col: str = "query") -> DataFrame:
    """H4: first doc (lowest ``corpus_idx``) whose compact name contains the compact query or is
    contained in it, or whose compact key contains the query; no match -> null (the
    reference's empty doc). Uses the exact trigram-blocked containment join, no theta join."""
    from revidence.operators.catalog import contains_join
    q = queries.select("qid", T.compact_key(F.col(q_col)).alias("cq")).where(F.col("cq") != "")
    qd = q.select("cq").distinct()
    d = docs.select("corpus_idx", T.compact_key(F.col("name")).alias("cn"), T.compact_key(F.col("key")).alias("ck"))
    names = d.where(F.col("cn") != "").groupBy("cn").agg(F.min("corpus_idx").alias("ci"))
    keys = d.where(F.col("ck") != "").groupBy("ck").agg(F.min("corpus_idx").alias("ci"))
    a = contains_join(qd, names, "cq", "cn").select("cq", "ci")
    b = contains_join(names, qd, "cn", "cq").select("cq", "ci")
    c = contains_join(qd, keys, "cq", "ck").select("cq", "ci")
    best = a.unionByName(b).unionByName(c).groupBy("cq").agg(F.min("ci").alias("doc_id"))
    return queries.select("qid").join(q.join(best, "cq").select("qid", "doc_id"), "qid", "left")


def spec_fusion(flat: DataFrame, id_col: str = "product_id") -> DataFrame:
    """Per (product, top aspect) the listed spec keys the product has, in list order."""
    ds = dims.dim_spec(flat.sparkSession)
    return flat.join(F.broadcast(ds), "spec_key").select(id_col, "top_idx", "ord", "spec_key", "spec_value")
