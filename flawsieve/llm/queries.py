"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (bpe, conversation_trie, exact_dedup, jaccard_join,
               language_id, lexical_search, packing, quality_model, quality_rules,
               secret_scan, suffix_dedup, token_files, unit_dedup)
from .common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark, sf_dir):
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    base = secret_scan.written(F.col("base_spans"))
    return found.select(
        "doc_id", *[secret_scan.count_of(F.col("base_spans"), k).alias(f"n_{k}")
                    for k in ("assign", "access", "hex")],
        F.sha2(base, 256).alias("base_sha256"),
        secret_scan.written(F.col("secret_spans")).alias("spans"))


def op2_packing(spark, sf_dir):
    rows = packing.pack_documents(documents(spark, sf_dir), BYTE_BPE)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                       "doc_tokens", "sequence_id", "offset", "loss_tokens", "sequence_tokens")


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.decisions(documents(spark, sf_dir)).withColumnRenamed(
        "digest", "text_sha256")


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.classes(documents(spark, sf_dir))


def op5_unit_dedup(spark, sf_dir):
    rows = unit_dedup.deduplicated(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["stop"])),
                     ",").alias("removed"), F.sha2("cleaned", 256).alias("cleaned_sha256"))


def op6_quality_model(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality_model.train(docs, labels.filter(
        ~quality_model.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label")))
    return quality_model.scored(docs, weights).select(
        "doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_token_files(spark, sf_dir):
    docs = documents(spark, sf_dir)
    files = token_files.TokenFiles.write(docs, BYTE_BPE)
    return files.read(docs.select("doc_id")).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.verdicts(documents(spark, sf_dir)).drop("cleaned")


def op9_suffix_dedup(spark, sf_dir):
    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["stop"])),
                            ",").alias(spans)

    def total(spans):
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])

    return suffix_dedup.repeated_passages(documents(spark, sf_dir)).select(
        "doc_id", "n_words", total("spans").alias("n_repeated_words"), written("spans"),
        total("later").alias("n_later_words"), written("later"))


def op10_bpe(spark, sf_dir):
    rows = bpe.decode_documents(bpe.encode_documents(documents(spark, sf_dir), BYTE_BPE), BYTE_BPE)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_conversation_trie(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_trie.trie(
        conversation_trie.rebuilt(conversation_trie.conversations_of(turns)))


def op12_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    trees = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    return language_id.predicted(docs, trees).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search(documents(spark, sf_dir),
                                 spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_packing, op3_exact_dedup, op4_jaccard_join, op5_unit_dedup,
    op6_quality_model, op7_token_files, op8_quality_rules, op9_suffix_dedup, op10_bpe,
    op11_conversation_trie, op12_language_id, op13_lexical_search)}
# The others are beyond SQL; tests hold them to brute force, the library or held-out accuracy.
ORACLES: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE_SQL, "op5_unit_dedup": unit_dedup.ORACLE_SQL,
    "op8_quality_rules": quality_rules.ORACLE_SQL,
    "op11_conversation_trie": conversation_trie.ORACLE_SQL,
    "op13_lexical_search": lexical_search.ORACLE_SQL}
