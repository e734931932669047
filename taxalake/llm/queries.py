"""The registered queries of this subpackage: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxalake.session import scratch_path

from . import chat, common, decontaminate, jaccard, langid, merkle, mixing, prefix_trie, pseudonyms, quality, simhash, templates, token_files, toxicity


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    held_out = common.fold(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, labels.where(~held_out))
    return quality.score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies of every document."""
    return jaccard.join(common.read(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near."""
    return simhash.compare(common.read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, budget, start, end of every benchmark item found in a document."""
    return decontaminate.find(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken of every document."""
    return mixing.mix(common.read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    held_out = common.fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without the lines of recurring templates and passages of two documents, n_lines, n_dropped of every document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return templates.dedup(docs, long_docs=2)


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, kinds (comma separated, in order) and n_found of every document."""
    found = pseudonyms.apply(common.read(spark, sf_dir, "documents"), key="public")
    return found.withColumn("kinds", F.array_join("kinds", ","))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of every document."""
    docs = common.read(spark, sf_dir, "documents")
    held_out = common.fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every speaker's view of every conversation; spans as text."""
    found = chat.views(common.read(spark, sf_dir, "conversations"))
    return found.withColumn("spans", chat.span_text(F.col("spans")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    return merkle.prove(common.read(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files by its key."""
    import public_tokenizers

    docs = common.read(spark, sf_dir, "documents")
    files = token_files.write(docs, scratch_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    found = files.read(token_files.keys_of(docs))
    return found.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    return prefix_trie.trie(common.read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_jaccard": op2_jaccard,
    "op3_fingerprints": op3_fingerprints,
    "op4_decontamination": op4_decontamination,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_lines": op7_lines,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_language": op9_language,
    "op10_chat": op10_chat,
    "op11_merkle": op11_merkle,
    "op12_token_files": op12_token_files,
    "op13_prefix_trie": op13_prefix_trie,
}
