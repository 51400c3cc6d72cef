"""From raw documents to token ids: stages applied one after the other, each written and read again.

Every stage works on all that the one before has kept, and its decisions take effect: rejected documents,
copies and documents that hold benchmark items go, secrets are blotted out of the texts. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import byte_bpe, decontaminate, quality, queries, secret_scan, simhash
from sievework.llm.common import table
from sievework.session import materialize, scratch_path

#: A document stays if its score is at least this.
ACCEPT = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is fitted on the labelled documents among ``docs``."""
    trees = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return quality.with_scores(docs, trees, name).where(F.col(name) >= ACCEPT).drop(name)


def _free(name: str, docs: DataFrame) -> str:
    """The name, or with underscores before it if ``docs`` has such a column."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _text_key() -> Column:
    """Names a row by what the stages decide on; rows may share an id, or have none."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, once if its row is repeated.

    A null id comes after all others. Rows with one id or none are documents of their own if their texts differ.
    """
    key = _free("_key", docs)
    keyed = docs.withColumn(key, _text_key())
    # The least key of a group is the group's name, whatever ids it has.
    groups = simhash.near_duplicates(keyed, id_col=key).select(F.col("doc_id").alias("k"), F.col("component_id").alias("g"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("k"))
    least = keyed.groupBy(F.col(key).alias("k")).agg(F.min(rank).alias("least"))
    # Texts with equal hashes have one row here, as they have among the groups.
    first = groups.groupBy("k").agg(F.min("g").alias("g")).join(least, "k").groupBy("g").agg(F.min("least").alias("least"))
    kept = materialize(first.select(F.col("least.id").alias("_kept"), F.col("least.k").alias("_kept_key")), "kept")
    same = keyed["doc_id"].eqNullSafe(kept["_kept"]) & (keyed[key] == kept["_kept_key"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).drop(key)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each told by its own text."""
    key = _free("_key", docs)
    keyed = docs.withColumn(key, _text_key())
    found = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    held = materialize(found.select(F.col("doc_id").alias("_held")).distinct(), "leaks")
    return keyed.join(held, keyed[key] == held["_held"], "left_anti").drop(key)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and ``n_chars`` that of the new text."""
    clean = secret_scan.redact_column(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every document that is left."""
    return byte_bpe.encode(docs, queries.BYTE_RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("simhash", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("secrets", blot_secrets),
    ("encoding", encode),
]

#: The stages train a model, hash shingles and merge bytes by rank, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on ``documents``; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
