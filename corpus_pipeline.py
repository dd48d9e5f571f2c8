"""The production pipeline for training text: language, exact copies, near copies, mixture, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from tidemark.llm.common import table
from tidemark.session import cut_lineage

#: A document whose words the learned languages explain for less than this share is in none of them.
LEAST_SCORE = 0.2
#: Words in a block of the mixture; most documents fit into one or two.
MIX_BLOCK_WORDS = 512


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; ``lang`` is what was recognised.

    Learnt from all documents with a language; if none has one, only documents without a letter are rejected.
    """
    model = language_id.learn(docs)
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    marked = language_id.predict(whole, model, keep=("doc",))
    if model[0]:
        explained = F.col("score") / F.array_max(F.map_values("languages"))  # the score is the largest proportion times this share
        kept = marked.filter((F.col("lang_pred") != language_id.UNKNOWN) & (explained >= LEAST_SCORE))
    else:
        kept = marked.filter(F.coalesce(F.col("doc.text"), F.lit("")).rlike(r"\p{L}"))
    return kept.select(*[F.col("lang_pred" if c == "lang" and model[0] else f"doc.`{c}`").alias(c) for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the least id."""
    return near_dedup.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the target mixture of sources: a row per document and epoch, with the words the mix takes."""
    return mixing.mixed(docs, MIX_BLOCK_WORDS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` (little-endian 32-bit) and the SHA-256 of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    n_tokens = (F.length("ids") / 4).cast("long").alias("n_tokens")
    return bpe.decode(encoded, path).select("doc_id", "lang", "source", n_tokens, "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("source_mix", mixture), ("bpe_tokens", tokens)]
#: SQL cannot state the language model, the sketches or the tokenizer; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES):
            docs = cut_lineage(docs)
    return docs
