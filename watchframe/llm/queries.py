"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.llm import alignment, byte_pairs, langmask, mixing, multi_index, packing, periods, pieces, records, repetition, secret_scan, toxicity, weighted_minhash
from watchframe.llm.oracle import mix_sql
from watchframe.llm.texts import held_out, table, tokenizer_path
from watchframe.session import work_dir


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "records")
    files = records.write(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return records.digests(records.read(files, folder))


def op2_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"), work_dir(spark, "multi-index"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


# Target weights, relative to siblings; nodes that are not listed weigh 1.
MIX_WEIGHTS = [("0/en", 5), ("1/en", 5), ("2/en", 5), ("3/en", 5), ("0/de", 2), ("1/de", 2), ("2/de", 2), ("3/de", 2), ("0", 3), ("1", 2)]
MIX_SEED, MIX_EPOCHS = 17, 2


def mix_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """As many tokens as there are, mixed anew; a source's domain is one of four, by the MD5 of its name."""
    levels = {"domain": F.conv(F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 2), 16, 10).cast("int") % 4, "lang": F.col("lang"), "source": F.col("source")}
    weights = spark.createDataFrame(MIX_WEIGHTS, "path string, weight long")
    return mixing.mix(docs, folder, levels, weights=weights, most_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(spark, table(spark, sf_dir, "documents"), work_dir(spark, "mix"))
    return mixed.select("doc_id", "lang", "source", "copies", "mix_tokens", "mix_budget")


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.near_duplicates(table(spark, sf_dir, "documents"), work_dir(spark, "near-duplicates")).drop("text_key")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from the rows whose id is not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).withColumn("held_out", held_out(F.col("doc_id"), 5, 0))


def op10_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = langmask.train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return langmask.identify(docs, filters).withColumn("held_out", held_out(F.col("doc_id"), 4, 2))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), work_dir(spark, "packing"), tokenizer_path("byte_bpe_50k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # A third step, so that the words of a document are made once and not anew for each of them.
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.withColumn("words", F.when(h % 10 == 0, words))
    text = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(periods.planted(F.col("doc_id"), F.col("words")), " "))
    return periods.digests(periods.runs(docs, text=text))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    found = alignment.aligned_counts(table(spark, sf_dir, "documents"), work_dir(spark, "alignment"), *paths, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


REGISTRY = {f.__name__: f for f in (
    op1_token_records, op2_secret_trigrams, op3_suffix_repetition, op4_multi_index, op5_token_counts, op6_sentencepiece, op7_source_mix, op8_weighted_minhash, op9_toxicity,
    op10_language_masks, op11_best_fit_packing, op12_periodic_runs, op13_token_alignment)}
ORACLE: dict[str, str] = {"op7_source_mix": mix_sql(MIX_WEIGHTS, MIX_SEED, MIX_EPOCHS)}
