"""Nearest neighbours by randomly rotated one-bit codes (operator 7).

Index: every vector is scaled to unit length, turned by one seeded random
rotation, and kept as its packed sign bits with a correction scalar (the inner
product of the rotated vector with its sign code). Search: query blocks meet
index blocks; for every pair the inner product is estimated from the bits and
the scalar, with an error bound of ``EPSILON`` standard deviations. Within a
block, vectors whose upper bound reaches the k-th best lower bound are reranked
by cosine in double precision on the original vectors; the k best of each block
then meet in a ranking per query. The index covers all rows; blocks have a
bounded size whatever the input is.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without an id. Vectors of different length are never compared. Rows
that repeat id and vector count once. Ties go to the smaller id. Fewer than k
candidates: all are returned. Empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import prepare, stage

EPSILON = 4.0          # standard deviations of the estimate's error
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024
SEED = 7


def usable(vector: str) -> Column:
    """Vectors with a direction: no null or non-finite component, not all zero."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(v.isNotNull() & good & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A seeded random rotation (orthonormal rows)."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)      # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector: id, dim, vector (doubles), code (packed sign bits), scale."""
    prepare(vectors.sparkSession)
    rows = (vectors.where(F.col(key).isNotNull() & usable(vector))
            .select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).distinct())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(dim=b["vector"].str.len())
            for dim, g in b.groupby("dim"):
                y = units(np.stack(g["vector"].to_numpy())) @ rotation(int(dim)).T
                code = np.packbits(y > 0, axis=1)
                scale = np.abs(y).sum(1) / math.sqrt(dim)
                yield pd.DataFrame({"id": g["id"], "dim": g["dim"].astype("int32"), "vector": g["vector"],
                                    "code": [c.tobytes() for c in code], "scale": scale})

    return rows.mapInPandas(encode, "id long, dim int, vector array<double>, code binary, scale double")


def _block(queries: pd.DataFrame, index: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of every query among one block's vectors."""
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
        {"query_id": "int64", "vec_id": "int64", "score": "float64"})
    if queries.empty or index.empty:
        return none
    dim = int(index["dim"].iat[0])
    ids = index["id"].to_numpy()
    x = np.stack(index["vector"].to_numpy())
    top = np.abs(x).max(1)
    bits = np.unpackbits(np.frombuffer(b"".join(index["code"]), np.uint8).reshape(len(ids), -1), axis=1, count=dim)
    signs = (bits.astype(np.float32) * 2 - 1) / math.sqrt(dim)
    scale = index["scale"].to_numpy()
    error = EPSILON * np.sqrt(np.maximum(0.0, 1 - scale**2)) / scale / math.sqrt(max(1, dim - 1))
    qx = np.stack(queries["vector"].to_numpy())
    turned = (units(qx) @ rotation(dim).T).astype(np.float32)
    out = []
    for at in range(0, len(qx), 256):
        estimate = (turned[at:at + 256] @ signs.T) / scale
        for i in range(len(estimate)):
            own = int(queries["id"].iat[at + i])
            low = estimate[i] - error
            low[ids == own] = -np.inf
            floor = np.partition(low, -k)[-k] if len(low) > k else -np.inf
            near = np.flatnonzero((estimate[i] + error >= floor) & (ids != own))
            if not len(near):
                continue
            # cosine in double precision, summed row by row so that copies score alike
            q, v = qx[at + i], x[near]
            if np.abs(q).max() > 1e150 or top[near].max() > 1e150 or np.abs(q).max() < 1e-150 or top[near].min() < 1e-150:
                q, v = q / np.abs(q).max(), v / top[near][:, None]
            score = (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * math.sqrt((q * q).sum()))
            best = np.lexsort((ids[near], -score))[:k]
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids[near][best], "score": score[best]}))
    return pd.concat(out) if out else none


def nearest(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query (id, dim, vector)."""
    n, m = index.count(), queries.count()
    ib, qb = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // BLOCK_QUERIES))
    # every index block meets every block of the stated query set
    left = (queries.select("id", "dim", "vector", F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(qb)).alias("qb"),
                           F.explode(F.sequence(F.lit(0), F.lit(ib - 1))).alias("ib")))
    right = (index.select("id", "dim", "vector", "code", "scale",
                          F.pmod(F.xxhash64(F.lit("i"), "id"), F.lit(ib)).cast("int").alias("ib"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long"))).alias("qb")))
    found = left.groupBy("dim", "qb", "ib").cogroup(right.groupBy("dim", "qb", "ib")).applyInPandas(
        lambda a, b: _block(a, b, k), "query_id long, vec_id long, score double")
    # an id that occurs with several vectors counts with its nearest
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of every row whose id is divisible by ``every``, among all other rows."""
    index = stage(build_index(vectors, key, vector), "vector-index")
    return nearest(index, index.where(F.col("id") % every == 0).select("id", "dim", "vector"), k)
