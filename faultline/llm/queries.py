"""Queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import fim, fingerprint, lattice, licenses, mixing, ngram_join, packing, pii, quality_classifier, quality_rules, secrets, trie, warc
from faultline.llm.shared import Workspace, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.train_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Workspace(spark, "warc").path
    warc.write(table(spark, sf_dir, "pages"), folder)
    found = warc.read(spark, folder)
    return found.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Shares of tokens by language that the mixture aims at; the corpus has about .61, .15, .15 and .09, so all but English is to be used more.
LANGUAGE_TARGETS = {"en": 0.5, "de": 0.18, "fr": 0.17, "es": 0.15}


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain, the language, of the documents that the labels table covers."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains are languages, known for the rows that the labels table covers and predicted for all."""
    docs = table(spark, sf_dir, "documents")
    mix = mixing.fit(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), LANGUAGE_TARGETS)
    mixed = mixing.apply(docs.select("doc_id", "text"), mix)
    return mixed.select("doc_id", "n_tokens", "domain", *[F.col("posteriors")[i].alias(f"p_{d}") for i, d in enumerate(mix.domains)], "rate")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.of_documents(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.of_conversations(table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_license_scan": op4_license_scan,
    "op5_secret_scan": op5_secret_scan,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op4_license_scan": licenses.ORACLE,
    "op6_ngram_jaccard_join": ngram_join.ORACLE,
    "op7_embedding_near_dedup": lattice.ORACLE,
    "op9_warc": warc.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
