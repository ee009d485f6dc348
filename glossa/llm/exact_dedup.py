"""Exact duplicates by skew-safe combining (operator 11).

Texts are equal when their bytes are. Of equal texts the row with the largest key
stays. Only DataFrame functions are used.

* Digests. One scan writes a narrow table: key, SHA-256 of the text. A digest that
  occurs once proves its text unique, so only rows with a repeated digest go on; a
  bit map of fixed size (8 MB) keeps the other texts out of every shuffle.
  A slot that two digests share only costs a text more.
* Combining, each time by digest *and* full text, so a clash of digests can never
  merge two texts: (1) every task deduplicates its own rows (the map side of the
  aggregation), (2) the local winners are merged per (digest, salt, text), the salt
  being the task they come from modulo the number of salts, (3) the winners of all
  salts are combined per (digest, text). A text that a third of all rows share thus
  reaches step 2 as one row per task, dealt over the salts, and step 3 as one row per
  salt. The number of salts is the square root of the shuffle partitions.
* Naming. Winners go back to the narrow rows by digest; the join has only small
  columns, and its hot keys are split by the adaptive skew join. Digests that stand for
  several texts (none, with all 32 bytes of SHA-256; ``digest_bytes`` shortens the digest in
  tests) are joined by their text as well.

Edge cases: null text counts as empty. Rows that repeat key and text are one group
like any other and exactly one of them stays. Rows without a key lose to rows with
one; a group without any key has a null ``keep_id`` and one row stays. Empty
table: empty result. Other columns of the input are not returned and may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import maybe_in, partitions, stage


def combine(texts: DataFrame, salts: int) -> DataFrame:
    """(digest, content, keep, n) of ``texts`` (digest, content, id): local, salted, global."""
    salted = texts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "content").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    return merged.groupBy("digest", "content").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))


def _named(rows: DataFrame, winners: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (row, id, sha, *by) with their group's keep and n, and whether they stay."""
    # among rows that repeat key and text the first stays
    first = (rows.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("m"), F.min("row").alias("first")).where("m > 1")
             .select(*[F.col(c).alias(f"f_{c}") for c in by], F.col("id").alias("f_id"), "first"))
    both = rows.join(winners, by)
    same = F.col("id").eqNullSafe(F.col("f_id"))
    for c in by:
        same = (F.col(c) == F.col(f"f_{c}")) & same
    both = both.join(first, same, "left")
    return both.select("id", "sha", "keep", "n", (F.col("id").eqNullSafe(F.col("keep")) & (
        F.col("first").isNull() | (F.col("first") == F.col("row")))).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256."""
    salts = math.isqrt(partitions(docs.sparkSession) - 1) + 1
    content = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    hashed = content.withColumn("sha", F.unhex(F.sha2("content", 256)))
    hashed = hashed.withColumn("digest", F.substring("sha", 1, digest_bytes))
    rows = stage(hashed.select(F.monotonically_increasing_id().alias("row"), "id", "sha"), "exact-digests")
    rows = rows.withColumn("digest", F.substring("sha", 1, digest_bytes))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    repeated = stage(sizes.where("n > 1").select("digest"), "exact-repeated")

    texts = maybe_in(hashed, repeated, "digest").select("digest", "content", "id")
    # the texts end here: what follows needs the digest, and how many texts stand behind it
    winners = stage(combine(texts, salts).groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep").alias("keep"), F.sum("n").alias("n")), "exact-winners")
    several = winners.where("texts > 1").select("digest")
    plain = _named(rows.join(repeated, "digest", "left_semi"),
                   winners.where("texts = 1").select("digest", "keep", "n"), ["digest"])
    alone = rows.join(repeated, "digest", "left_anti").select(
        "id", "sha", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"))
    out = alone.union(plain)
    if not several.isEmpty():
        clash = maybe_in(hashed, several, "digest").join(several, "digest", "left_semi").select(
            F.monotonically_increasing_id().alias("row"), "id", "sha", "digest", "content")
        clash = stage(clash, "exact-clashes")
        out = out.union(_named(clash, combine(clash.select("digest", "content", "id"), salts), ["digest", "content"]))
    return out.select(F.col("id").alias(key), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept",
                      F.lower(F.hex("sha")).alias("text_sha256"))
