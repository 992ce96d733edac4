"""Registered queries of the training-data operators: whole tables, whole texts."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterpanel.functions.session import shared_dir
from counterpanel.llm import conversation_trie, decontaminate, embedding_dedup, html_text, jaccard, line_dedup, merkle, mixing, packing
from counterpanel.llm import personal_data, token_counts, token_output, toxicity


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/counterpanel/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document by the mix; copies summed by row."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixing.taken_words(mixed)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_tokens(spark, path, with_ids=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document that loses lines: how many, and their numbers."""
    gone = line_dedup.repeated_lines(read(spark, sf_dir, "documents"))
    return gone.groupBy("doc_id").agg(
        F.count("*").alias("n_removed"), F.array_join(F.sort_array(F.collect_list("line")), ",").alias("removed")
    )


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(read(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.sequences(read(spark, sf_dir, "conversations"))
    return conversation_trie.build_trie(conversation_trie.rebuilt(turns))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    manifest = merkle.build_manifest(docs, kept={"claimed": merkle.tampered(docs)})
    return merkle.verify(manifest).withColumnRenamed("id", "doc_id")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "stream")
    packing.write_stream(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pieces(spark, path)


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_output": op4_token_output,
    "op5_line_dedup": op5_line_dedup,
    "op6_personal_data": op6_personal_data,
    "op7_html_text": op7_html_text,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_counts": op9_token_counts,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_packing": op13_packing,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
