"""One thin query per operator for training text, beside its SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, class_model, collocations, exact_dedup, html_text, language_id, licenses, mixing, near_dedup, quality, substring_dedup, token_alignment, vector_search
from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


@query("op2_heavy_hitter_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)
""")
def op2(spark, folder):
    return exact_dedup.mark_copies(table(spark, folder, "documents"))


@query("op3_block_mixing", mixing.SQL)
def op3(spark, folder):
    return mixing.words_taken(table(spark, folder, "documents"))


@query("op5_matrix_bpe")
def op5(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, path)
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_language_mixture")
def op4(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language_id.learn(docs.filter(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op1_bradley_terry_quality")
def op1(spark, folder):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scores = quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query("op9_super_kmer_dedup")
def op9(spark, folder):
    return substring_dedup.removal_report(table(spark, folder, "documents"))


@query("op7_order_minhash")
def op7(spark, folder):
    return near_dedup.mark_near_copies(table(spark, folder, "documents"))


@query("op10_kd_tree_search", """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""")
def op10(spark, folder):
    return vector_search.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_host_suffix_html")
def op8(spark, folder):
    texts = html_text.main_text(table(spark, folder, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op6_license_scan", licenses.sql())
def op6(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query("op11_token_alignment")
def op11(spark, folder):
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align_documents(table(spark, folder, "documents"), token_alignment.Sources.read(*files))


@query("op12_trie_collocations", collocations.SQL)
def op12(spark, folder):
    return collocations.best(table(spark, folder, "documents"))


@query("op13_class_model")
def op13(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = class_model.train(docs.filter(~held_out))
    found = class_model.scores(docs, model, (F.col("doc_id"), held_out.alias("held_out")))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
