"""Fixed-length model inputs: truncate, right-pad, attention mask.

The token source is pluggable; the default splits on ASCII whitespace. Ids
come from ``xxhash64`` of the token or from a vocabulary table (``vocab_ids``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

PAD = "<pad>"
WS = r"[ \t\n\r]+"


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda t: t != "")


def pad_tokens(tokens: Column, max_length: int, pad: str = PAD) -> Column:
    cut = F.slice(tokens, 1, max_length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(max_length) - F.size(cut)))


def attention_mask(tokens: Column, max_length: int) -> Column:
    n = F.least(F.size(tokens), F.lit(max_length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))


def token_ids(padded: Column, pad: str = PAD) -> Column:
    """Stable ids: 0 for padding, else a non-negative 63-bit hash of the token."""
    return F.transform(padded, lambda t: F.when(t == pad, F.lit(0).cast("long"))
                       .otherwise(F.abs(F.xxhash64(t) % F.lit(9223372036854775807))))


def pad_encode(text: Column, max_length: int, pad: str = PAD) -> Column:
    """``struct(tokens, input_ids, attention_mask)`` of exactly ``max_length`` entries."""
    toks = whitespace_tokens(text)
    padded = pad_tokens(toks, max_length, pad)
    return F.struct(padded.alias("tokens"), token_ids(padded, pad).alias("input_ids"),
                    attention_mask(toks, max_length).alias("attention_mask"))


MAP_BYTES = 64 << 20     # a vocabulary up to this size is a dictionary in every worker
GROUP_ROWS = 4096


def vocab_ids(df: DataFrame, tokens_col: str, vocab: DataFrame, key: str, out: str = "input_ids",
              pad: str = PAD, pad_id: int = 0, unk_id: int = 1, map_bytes: int = MAP_BYTES) -> DataFrame:
    """Token ids from a vocabulary table (``token string``, unique, ``id long``).

    A row's tokens stay in the row. The vocabulary's size is measured first: up to ``map_bytes`` it is
    broadcast as a dictionary and rows are not shuffled at all. A larger one never becomes a
    broadcast: rows are dealt into groups of about ``GROUP_ROWS`` by their key, each group's distinct
    tokens are joined with the vocabulary, and the group looks its tokens up in what it got. Padding
    gets ``pad_id``, unknown tokens ``unk_id``; null tokens of a row count as unknown, a null array
    stays null. ``key`` only deals the rows and may repeat.
    """
    n, size = vocab.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("token") + 100), F.lit(0))).first()
    rows = vocab.select("token", F.col("id").cast("long").alias("id"))
    if size <= map_bytes:
        known = {r.token: r.id for r in rows.toLocalIterator()}
        shared = df.sparkSession.sparkContext.broadcast({**known, pad: pad_id})

        @F.pandas_udf("array<long>")
        def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            ids = shared.value.get
            for s in batches:
                yield pd.Series([None if ts is None else [ids(t, unk_id) for t in ts] for ts in s], dtype=object)

        return df.withColumn(out, look_up(tokens_col))

    groups = max(1, -(-df.count() // GROUP_ROWS))
    dealt = df.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)))
    wanted = dealt.select("_group", F.explode(F.array_distinct(tokens_col)).alias("token")).distinct()
    found = wanted.join(rows, "token").select(F.col("_group").alias("_words_of"), "token", "id")
    fields = [f for f in df.schema.fields if f.name != out]
    schema = StructType([*fields, StructField(out, ArrayType(LongType()))])
    names = [f.name for f in schema.fields]

    def per_group(rows: pa.Table, words: pa.Table) -> pa.Table:
        ids = dict(zip(words["token"].to_pylist(), words["id"].to_pylist()))
        ids[pad] = pad_id
        got = [None if ts is None else [ids.get(t, unk_id) for t in ts] for ts in rows[tokens_col].to_pylist()]
        return rows.select(names[:-1]).append_column(out, pa.array(got, pa.list_(pa.int64())))

    return dealt.groupBy("_group").cogroup(found.groupBy("_words_of")).applyInArrow(per_group, schema)
