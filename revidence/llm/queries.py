"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revidence.llm import (bpe_tree, collocations, licenses, maxscore, merkle, mixing, multiset_hash, ngram_join, pii, quality_fm, repeats,
                           toxicity, warc)
from revidence.llm.common import held_out, labelled_sample

QUERIES, SQL = {}, {}
#: Rows of the labelled table that the domain classifier is trained on at most.
DOMAIN_SAMPLE = 20_000
#: Target token shares of the domains (languages) in op9 and in the pipeline.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
PII_KEY = "revidence-demo-key"
TOXIC = 0.7
RANKS = "byte_bpe_50k.tiktoken"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, domain) of at most DOMAIN_SAMPLE rows of the labelled table; the domain of a document is its language."""
    ids = labels.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64(F.lit("domain"), "doc_id"), "doc_id").limit(DOMAIN_SAMPLE).distinct()
    return docs.select("doc_id", "text", F.col("lang").alias("domain")).join(F.broadcast(ids), "doc_id", "left_semi").select("text", "domain")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.train(docs, labelled_sample(docs, labels, "toxic", toxicity.SAMPLE))


def bpe_digests(docs: DataFrame) -> DataFrame:
    return bpe_tree.digests(docs, path=public_tokenizers.path(RANKS), pattern=public_tokenizers.PATTERN)


@query
def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_fm.train(labelled_sample(docs, _table(spark, sf_dir, "labels"), "quality", quality_fm.SAMPLE))
    scored = quality_fm.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(_table(spark, sf_dir, "documents"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "n_bytes", (total("ends") - total("starts")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


@query
def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", maxscore.quantised(F.col("embedding")).alias("v"))
    return maxscore.top_k(vectors, F.col("vec_id") % 20 == 0, 20).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query
def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edited_likeness(_table(spark, sf_dir, "documents"))


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), n=4, percent=85)


@query
def op8_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


@query
def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = mixing.mix(docs, domain_rows(docs, _table(spark, sf_dir, "labels")), TARGETS)
    return out.select("doc_id", "tokens", *[F.col("p")[d].alias(f"p_{d}") for d in sorted(TARGETS)], "rate", "copies")


@query
def op10_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(_table(spark, sf_dir, "documents"))


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(_table(spark, sf_dir, "documents")))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), top=2000, longest=5, at_least=100)


_BASE32 = " || ".join(f"lpad(to_base(('0x' || substr(h, {10 * i + 1}, 10))::BIGINT, 32), 8, '0')" for i in range(4))
SQL["op1_warc_normaliser"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes,
  translate({_BASE32.replace('substr(h,', 'substr(p.h,')}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN p.page_id = t.top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> t.top THEN t.top END AS refers_to
FROM p JOIN t USING (h)"""

SQL["op5_maxscore"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

SQL["op7_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.r)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(r) FROM c WHERE c.doc_id = w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
#: Crc32 of the decimal id, bit by bit; only its lowest bit counts.
_EVEN = """(list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda i:
  ((ascii(c) >> i::INT) & 1)::UBIGINT))), lambda a, b: xor(a >> 1, ((xor(a & 1, b))::UBIGINT * 3988292384)::UBIGINT)) & 1) = 1"""
_UP = """{0}(grp, lvl, pos, node, n) AS (SELECT grp, 0, pos, node, n FROM {1}
  UNION ALL SELECT grp, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 2) // 3 FROM {0} WHERE n > 1 GROUP BY grp, lvl, pos // 3),
{0}runs AS (SELECT grp, lvl, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM {0} WHERE n > 1 GROUP BY ALL),
{0}walk(grp, leafpos, lvl, pos, folded, siblings) AS (SELECT grp, pos, 0, pos, {2}, '' FROM {1} UNION ALL
  SELECT w.grp, w.leafpos, w.lvl + 1, w.pos // 3, sha256(array_to_string(r.nodes[1:w.pos % 3], '') || w.folded || array_to_string(r.nodes[w.pos % 3 + 2:], '')),
    w.siblings || array_to_string(r.nodes[1:w.pos % 3], '') || array_to_string(r.nodes[w.pos % 3 + 2:], '')
  FROM {0}walk w JOIN {0}runs r ON r.grp = w.grp AND r.lvl = w.lvl AND r.run = w.pos // 3),
{0}ends AS (SELECT grp, leafpos, max_by(folded, lvl) AS folded, max_by(siblings, lvl) AS siblings FROM {0}walk GROUP BY grp, leafpos)"""

SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || source, '') AS grp, {_LEAF("text")} AS node,
  CASE WHEN {_EVEN} THEN {_LEAF("replace(text, chr(10), '')")} ELSE {_LEAF("text")} END AS changed FROM documents),
low AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
{_UP.format("a", "low", "changed")},
tops AS (SELECT grp AS name, node FROM a WHERE n = 1),
high AS (SELECT 'all' AS grp, name, node, row_number() OVER (ORDER BY name) - 1 AS pos, count(*) OVER () AS n FROM tops),
{_UP.format("b", "high", "node")},
-- the way from a subroot to the root, for the changed subroots too
folds AS (SELECT h.name, e.leafpos, e.folded, e.siblings, h.pos AS top FROM aends e JOIN high h ON h.name = e.grp),
walk(name, leafpos, lvl, pos, folded) AS (SELECT name, leafpos, 0, top, folded FROM folds UNION ALL
  SELECT w.name, w.leafpos, w.lvl + 1, w.pos // 3, sha256(array_to_string(r.nodes[1:w.pos % 3], '') || w.folded || array_to_string(r.nodes[w.pos % 3 + 2:], ''))
  FROM walk w JOIN bruns r ON r.lvl = w.lvl AND r.run = w.pos // 3),
folded AS (SELECT name, leafpos, max_by(folded, lvl) AS folded FROM walk GROUP BY name, leafpos),
root AS (SELECT node AS root FROM b WHERE n = 1)
SELECT l.doc_id, l.node AS leaf, h.node AS subroot, root, sha256(f.siblings || e.siblings) AS proof_sha256, x.folded AS folded_root, x.folded = root AS verified
FROM low l JOIN high h ON h.name = l.grp JOIN bends e ON e.leafpos = h.pos JOIN folds f ON f.name = l.grp AND f.leafpos = l.pos
JOIN folded x ON x.name = l.grp AND x.leafpos = l.pos, root"""

SQL["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (SELECT DISTINCT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM c, range(2, 5) x(m), range(1, 5) y(i) WHERE m < k AND i <= k - m + 1),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.f)),
cuts AS (SELECT kept.lang, kept.phrase, kept.f AS a, cut, x.f AS l, y.f AS r, n.n, 1000::HUGEINT * kept.f * n.n // (x.f::HUGEINT * y.f) AS score
  FROM kept JOIN range(1, 5) t(cut) ON cut < k JOIN n USING (lang)
  JOIN f x ON x.lang = kept.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = kept.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM r WHERE rank <= 2000"""
