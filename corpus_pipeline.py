"""From documents to packed training sequences: language, quality, near-duplicates, repeated passages, packing.

STAGES are applied in order; each result is written as Parquet into the shared folder and read again. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import common, langid, minhash, packing, quality, suffix
from tidebar.llm.queries import tokenizer_path

#: Documents whose language is less certain than this are rejected.
MIN_LANGUAGE_SCORE = 0.5


def _put_by(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with its columns of these names put by, so that a stage's own columns don't replace them."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in names})


def _taken_back(df: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``docs`` out of what a stage made of _put_by(docs, names)."""
    return df.select(*(F.col(f"__own_{c}").alias(c) if c in names else F.col(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; ``und`` and uncertain ones go: null texts, and texts without a letter. lang takes
    the prediction where it was null. Repeated rows stay each; a table without labels recognises nothing and keeps no row."""
    names = ["lang_pred", "score"]
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.predict(_put_by(docs, names), model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return _taken_back(out.withColumn("lang", F.coalesce("lang", "lang_pred")), docs, names)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the certified rules of their language keep. Null and short texts go; a null lang is a
    stratum of its own; repeated rows are judged each, and without labels only the base rule works."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "rules_hit", "kept"]
    out = quality.score(_put_by(docs, names), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
    return _taken_back(out, docs, names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): the one of the least doc_id,
    null ids last, one row if rows repeat. Rows without words or text stay."""
    return minhash.keep_one(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 200 bytes that occur elsewhere too; n_chars follows, and texts of which nothing is left go,
    null and blank ones too. Repeated rows are copies of each other, so long ones lose everything."""
    names = ["th", "spots", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    own = _put_by(docs, names)
    kept = suffix.remove_repeats(own, with_text=True, carry=[c for c in own.columns if c not in ("text", "n_chars")])
    kept = kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long"))
    return _taken_back(kept.where(F.trim("text") != ""), docs, names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; a null text is one piece with the end id alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [("language ID", language), ("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("packing", pack)]
#: SQL can't express the trained, sketched and tokenised stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
