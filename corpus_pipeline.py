"""Training-data pipeline over documents: five stages, each the full input of the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. ``ORACLE_SQL`` is None: the toxicity
model, the pseudonyms and the fitted rates can't be written in SQL; the tests hold every stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revidence.llm import mixing, ngram_join, pii, queries, toxicity
from revidence.llm.common import written

ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores TOXIC or more go."""
    model = queries.toxicity_model(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < queries.TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked at 5-word shingles and a similarity of 0.8 the smallest id stays; of rows repeated with one
    id the one with the smallest text stays (then lang, source, n_chars; null first). Rows without an id stay."""
    found = ngram_join.near_duplicates(docs, n=5, percent=80)
    kept = found.where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    first = F.min(F.struct(*COLUMNS[1:])).alias("first")
    named = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("doc_id", "first.*")
    return named.unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced inside the text; n_chars follows."""
    out = pii.pseudonymise(docs.select(*COLUMNS), key=queries.PII_KEY)
    return out.withColumn("n_chars", F.when(F.size("pii_kinds") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains short of their target share are repeated by their fitted rates; every document stays at least once."""
    out = mixing.mix(docs, queries.domain_rows(docs, _labels(spark, sf_dir)), queries.TARGETS, floor=1.0, grow=True, keep=COLUMNS)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1))))).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return queries.bpe_digests(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", pseudonymise), ("mixing", mix), ("bpe", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
