"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import binary, bpe, embeddings, langid, licenses, minhash, oracles, packing, quality, sharding, suffix

N_SHARDS = 40


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neardup(spark, sf_dir):
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op2_quality_rules(spark, sf_dir):
    out = quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)


def op4_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return langid.evaluate(_table(spark, sf_dir, "documents"))


def op6_hyperminhash(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_jump_sharding(spark, sf_dir):
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), N_SHARDS)


def op8_packed_tokens(spark, sf_dir):
    folder, files = binary.write(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return binary.read(folder, files)


def op9_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


QUERIES = {f.__name__: f for f in (op1_embedding_neardup, op2_quality_rules, op3_byte_bpe, op4_license_scan, op5_language_id, op6_hyperminhash, op7_jump_sharding, op8_packed_tokens, op9_suffix_dedup, op10_packing)}
ORACLE_SQL = {
    "op1_embedding_neardup": oracles.embedding_neardup(0.98),
    "op2_quality_rules": oracles.quality_rules(),
    "op4_license_scan": licenses.oracle(),
    "op6_hyperminhash": oracles.shingle_neardup(k=4, percent=80),
    "op7_jump_sharding": oracles.jump_shards(N_SHARDS),
    "op9_suffix_dedup": oracles.repeated_bytes(200),
}
