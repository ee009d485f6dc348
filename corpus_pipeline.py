"""Corpus pipeline: raw documents to packed training sequences.

Stages, in order; each works on all its predecessor kept:

1. ``language``   keeps the documents whose language is recognised: a document
                  without a letter goes, and one for which all languages are
                  exactly equally likely. The score is a best share of k, so at
                  least 1/k; there is no threshold that unsure texts would miss;
2. ``toxicity``   drops the documents that the lexicon, learned from ``labels``,
                  predicts to be toxic;
3. ``near_duplicates`` keeps one row of each group of similar texts, the one with
                  the smallest doc_id;
4. ``mixing``     takes each document as often as the mix of the sources says (zero,
                  one or more times, so rows may repeat);
5. ``packing``    cuts and packs the documents' token ids into sequences.

All but the last return the columns of ``documents``. ``run`` writes each stage's
result as Parquet to the shared folder and reads it again as the next one's input.
The models of the first two stages are learned from the stage's own rows.

Edge cases: every stage passes an empty table through. Null texts go in the first
stage. The third stage judges every row by its own text: rows that repeat a doc_id
with texts that are not similar are all kept, and rows without a doc_id come last in
their group. Of equal rows one is kept there.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm import language_id, mixing, packing, shingle_join, toxicity
from glossa.llm.common import held_out, stage, table
from glossa.llm.queries import vocab_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    model = language_id.fit(docs.where(~held_out("doc_id", 5, 0)))
    out = language_id.with_language(docs.select(*COLUMNS), model)
    chance = 1.0 / max(1, len(model.langs))
    return out.where((F.col("lang_pred") != language_id.UNKNOWN) & ((F.col("score") > chance) | F.lit(chance == 1.0))
                     ).select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)).select("doc_id", "toxic")
    lexicon = toxicity.fit(docs, labels)
    return toxicity.with_toxicity(docs.select(*COLUMNS), lexicon).where("predicted = 0").select(*COLUMNS)


def row_keys(docs: DataFrame) -> Column:
    """A 64-bit key that equal rows share and different rows never do: the seed is
    changed until no key stands for two contents."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")),
                        F.lit("-")) for c in COLUMNS]
    content = F.xxhash64(F.sha2(F.concat(*parts), 256))
    for seed in count():
        key = F.xxhash64(F.lit(seed), *COLUMNS, *[F.col(c).isNull() for c in COLUMNS])
        found = docs.select(key.alias("k"), content.alias("c")).groupBy("k").agg(F.min("c").alias("a"), F.max("c").alias("b"))
        if found.where("a <> b").isEmpty():
            return key


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts."""
    keyed = docs.select(*COLUMNS, row_keys(docs).alias("row_key"))
    groups = shingle_join.join(keyed.select("row_key", "text"), key="row_key").select("row_key", "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    leaders = (keyed.select("row_key", "doc_id").distinct().join(groups, "row_key")
               .groupBy("component_id").agg(F.min(order)["row_key"].alias("row_key")))
    return keyed.join(leaders, "row_key", "left_semi").select(*COLUMNS).distinct()


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    key = ["doc_id", "source", "size"]
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORDS)), F.lit(0)).cast("long")
    rows = docs.select(*COLUMNS).withColumn("size", size).withColumn("k", F.xxhash64(*key))
    plan = (mixing.mix(docs.select("doc_id", "text", "source")).groupBy(*key)
            .agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("m")).where("n > 0")
            .withColumn("k", F.xxhash64(*key)))
    same = F.expr(" AND ".join(f"l.{c} <=> r.{c}" for c in key))
    both = rows.alias("l").join(plan.alias("r"), (F.col("l.k") == F.col("r.k")) & same).select("l.*", "r.n", "r.m")
    # rows that agree in key, source and size share their copies evenly
    nth = F.row_number().over(Window.partitionBy("k", *key).orderBy(F.xxhash64("text")))
    copies = F.floor(F.col("n") / F.col("m")) + (nth <= F.col("n") % F.col("m")).cast("long")
    picked = both.withColumn("copies", copies).where("copies > 0")
    return picked.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_")).drop("_")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in the sequences."""
    return packing.pack(docs.select("doc_id", "text"), vocab_path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", toxicity_filter), ("near_duplicates", near_duplicates),
          ("mixing", mixing_stage), ("packing", packing_stage)]

# Learned language and lexicon models and hashed draws have no SQL form; the tests
# hold every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
