"""A corpus pipeline of the package's operators: what is toxic goes, one document of each group of near copies stays, secrets
are masked, sources are mixed to their weights, and what is left is encoded.

Each stage works on all rows its predecessor stored. Null texts pass the filters with empty text's result; a missing table of
labels is an error, as nothing could be learned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.llm import pieces, queries, secret_scan, toxicity, weighted_minhash
from watchframe.llm.texts import table, tokenizer_path
from watchframe.session import work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the model, learned from those that are labelled, does not reject."""
    scored = toxicity.score(docs, queries.toxicity_model(spark, docs, sf_dir), carry=COLUMNS)
    return scored.where(F.col("predicted") == 0).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near copies."""
    return weighted_minhash.one_of_each(docs, work_dir(spark, "near-duplicates")).select(COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace what the scan finds; the number of characters follows."""
    found = secret_scan.scan(docs, carry=["lang", "source", "n_chars", F.col("text").isNull().alias("__null")])
    masked = found.withColumn("masked", secret_scan.redact(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    return masked.select("doc_id", F.when(~F.col("__null"), F.col("masked")).alias("text"), "lang", "source",
                         F.when(changed, F.length("masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as come in, mixed to the target weights; a document comes out as often as it is taken."""
    return queries.mixing.repeated(queries.mix_documents(spark, docs, work_dir(spark, "mix")), COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with digests of them and of what they decode to."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources),
          ("sentencepiece", encode)]
ORACLE_SQL = None  # near-duplicate classes and library tokens are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to the stored rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
