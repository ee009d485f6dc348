"""Registered queries: each applies its operator to the whole table.

``QUERIES`` maps a name to ``f(spark, sf_dir) -> DataFrame``. The operators keep
their own general interfaces; the digest columns are derived here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import held_out, table


def vocab_path(name: str) -> str:
    """Place of a public tokenizer file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.katz import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("train", ~held_out("doc_id", 7, 2)))


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.shingle_join import join

    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.token_counts import with_token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, vocab_path("byte_bpe_50k.json")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import language_id as m

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", held_out("doc_id", 5, 0))
    model = m.fit(docs.where(~F.col("held_out")))
    return m.with_language(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import toxicity as m

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 0))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)).select("doc_id", "toxic")
    lexicon = m.fit(docs, labels)
    return m.with_toxicity(docs, lexicon).select("doc_id", "held_out", "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab_path("word_bpe_49k.json"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.vector_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.vector_search import search

    return search(table(spark, sf_dir, "embeddings"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.html_text import with_main_text

    return with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.exact_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.lexical_search import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_vector_dedup": op2_vector_dedup,
    "op7_vector_search": op7_vector_search,
    "op8_html_text": op8_html_text,
    "op9_packing": op9_packing,
    "op4_toxicity": op4_toxicity,
    "op3_katz": op3_katz,
    "op5_shingle_join": op5_shingle_join,
    "op6_token_counts": op6_token_counts,
    "op10_language_id": op10_language_id,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_whitening": op13_whitening,
}
