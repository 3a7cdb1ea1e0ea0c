"""One query per operator over the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, chat, decontaminate, jaccard, language, licenses, lines, merkle, negatives, quality, revisits, secrets, substrings
from tidepanel.llm.frames import documents, materialise
from tidepanel.llm.oracles import ORACLES

RANKS = "byte_bpe_50k.tiktoken"


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find(documents(spark, sf_dir).select("doc_id", "text"), items, ["doc_id"])
    df = found.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return df.withColumn("contaminated", decontaminate.contaminated())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc.doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("cleaned", F.lit("")), 256).alias("cleaned_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", F.coalesce(part == 0, F.lit(False)).alias("held_out"))
    model = language.train(docs.where(part != 0))
    return language.predict(docs, model, ["doc_id", "held_out"])


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.evaluate(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        F.round("lost", 6).alias("lost"), F.sha2("cleaned", 256).alias("cleaned_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    return bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN, ["doc_id"], with_ids=False)


def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    entries = F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("record_id", "url", "target_id", "outcome", "matched_by", F.array_join(entries, ";").alias("headers"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = documents(spark, sf_dir).select("doc_id", "text")
    ledger = materialise(secrets.update(versions, secrets.empty_ledger(spark)))
    found = secrets.by_path(versions, ledger, ["doc_id"])
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.joined("found", first=len(secrets.BASE)), 256).alias("base_sha256"), secrets.joined("found").alias("spans"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").alias("vector"))
    return negatives.mine(rows)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = merkle.digest([(F.col(c).cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in fields])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(docs, fields, "lang", "doc_id", {"doc_id": F.col("doc_id"), "tampered": F.when(tampered, changed)})
    out = found.select(
        "row.doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("row.tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*extra.columns).unionByName(extra)
    # Written once: the ranges of the running sums are sampled from it.
    made = chat.windows(materialise(chat.tokens(turns, ranks, public_tokenizers.PATTERN)))
    return chat.digests(chat.read_back(made))


QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_line_dedup, op3_language_id, op4_license_scans, op5_quality_rules, op6_byte_bpe, op7_revisit_resolution,
    op8_ngram_jaccard_join, op9_secret_scans, op10_substring_dedup, op11_hard_negatives, op12_merkle_manifest, op13_chat_formatting)}

__all__ = ["ORACLES", "QUERIES"]
