"""Queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidgraph.llm import conversations, decontam, langid, minhash, mixing, quality_classifier, quality_rules, secrets, sentencepiece_codec, spelling, toxicity, url_filter, warc
from bidgraph.llm.text_stats import COUNTS, small_batches, text_stats
from bidgraph.plans.storage import materialize
from bidgraph.plans.tables import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = secrets.scan_documents(docs, RANKS, PATTERN).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *[secrets.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    coded = docs.select("doc_id", sentencepiece_codec.encode_decode(F.col("text"), PIECES).alias("c")).select("doc_id", "c.*")
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = warc.write_archives(pages)
    return warc.read_archives(spark, manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    rows = materialize(docs.select("doc_id", text_stats(F.col("text")).alias("quality_rules")), "text_stats")
    judged = quality_rules.judge_statistics(rows, labels).select("doc_id", "quality_rules.*")
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels, ~quality_classifier.held_out(F.col("id"), 4, 2))
    scored = quality_classifier.score_documents(docs, model)
    good = F.col("quality_score") >= quality_classifier.GOOD_FROM
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("quality_score").alias("score"), good.cast("int").alias("predicted"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), width=2, percent=80)


def _fold(doc_id: Column) -> Column:
    return quality_classifier.held_out(doc_id, 5, 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~_fold(F.col("doc_id"))))
    found = langid.identify_documents(docs.select("doc_id", "text"), model)
    return found.select("doc_id", _fold(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels")
    return toxicity.judge_documents(docs, toxicity.fit(docs, labels)).select("doc_id", "toxicity.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    matched = decontam.match_documents(docs, items).select("doc_id", "benchmark_items")
    return matched.select(
        "doc_id",
        (F.size("benchmark_items") > 0).alias("contaminated"),
        F.col("benchmark_items.item_id").alias("item_ids"),
        F.col("benchmark_items.distance").alias("distances"),
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    first = F.array_min(F.col("mix.copies.position"))
    return mixed.orderBy(first.asc_nulls_last(), "mix_order").select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    said = table(spark, sf_dir, "conversations")
    return conversations.repair_report(said, conversations.damaged(said))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return spelling.spelling_variants(spelling.counted_words(docs))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_secrets": op2_secrets,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_minhash": op7_minhash,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_mixing": op11_mixing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL: dict[str, str] = {"op1_url_filter": url_filter.ORACLE, "op4_warc": warc.ORACLE, "op7_minhash": minhash.ORACLE, "op11_mixing": mixing.ORACLE}
