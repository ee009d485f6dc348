"""Near-duplicate vectors by collision-counting projections (operator 2).

Vectors of one label are linked when their cosine reaches ``threshold``. Unit
vectors that close are at most ``delta = sqrt(2 - 2 threshold)`` apart, so on a
random line their projections differ by a normal variable of at most that
spread. The method uses this twice:

* Blocks. A first set of lines cuts each label's vectors at their mean; a vector
  within ``HALO * delta`` of a cut goes to both sides, so a close pair is parted
  only if its projections differ by twice the halo. The number of cuts grows
  with the logarithm of the label's size; nothing is gathered per label. A block
  that stays too large (a dense cluster) is dealt into tiles, and every pair of
  tiles is one task, so no task holds more than two tiles.
* Counting. Within a block, ``LINES`` further projections are sorted; for every
  vector the window of ``WINDOW * delta`` around it collects the collisions per
  pair. Pairs with at least ``count_needed()`` collisions (calibrated on the
  binomial tail so that a pair just at the threshold is missed with probability
  below ``MISS``) are verified by cosine in double precision.

Exact copies are one class before the search and count with their number. Pairs
are not written: a block returns, per vector, how many vectors it links to and
one link to the smallest of its group in the block; components follow from these.

Null labels, and vectors that are null, zero or hold null or non-finite
components, link with nothing (n_links 0, own component). Different lengths are
never compared. Repeated rows are rows of their own. Empty table: empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import connected_components, prepare, stage
from glossa.llm.vector_search import units, usable

THRESHOLD = 0.98
LINES = 24
WINDOW = 2.0
HALO = 2.0
MISS = 1e-7
BLOCK = 1024
SHRINK = 0.6         # bits a cut takes off a block's size, halo copies included
SEED = 11


def spread(threshold: float) -> float:
    return math.sqrt(2 - 2 * threshold)


def count_needed(lines: int = LINES, window: float = WINDOW, miss: float = MISS) -> int:
    """Largest count that a pair at the threshold reaches with probability >= 1 - miss."""
    p = math.erf(window / math.sqrt(2))
    tail, need = 0.0, 0
    for c in range(lines + 1):
        tail += math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
        if tail > miss:
            break
        need = c + 1
    return need


def lines(dim: int, n: int, use: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, use]).standard_normal((n, dim))


def _label_means(classes: DataFrame) -> DataFrame:
    """label, dim, classes, mean unit vector: partial sums per batch, then per label."""
    schema = "label long, dim int, n long, total array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(label, dim, len(g), units(np.stack(g["vector"].to_numpy())).sum(0))
                    for (label, dim), g in b.groupby(["label", b["vector"].str.len()])]
            yield pd.DataFrame(rows, columns=["label", "dim", "n", "total"])

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        n = int(g["n"].sum())
        mean = np.sum(np.stack(g["total"].to_numpy()), 0) / n
        return pd.DataFrame({"label": g["label"].iloc[:1], "dim": g["dim"].iloc[:1], "n": n, "total": [mean]})

    return (classes.select("label", "vector").mapInPandas(partial, schema).groupBy("label", "dim")
            .applyInPandas(whole, schema).withColumnRenamed("total", "mean"))


def _blocks(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """Class copies per block: label, dim, leaf, twice, cid, weight, vector. ``twice``
    has a bit for each cut at which this copy is the second one, so a pair that
    meets in several blocks is counted in one: where no bit is set for both."""
    means = _label_means(classes)
    rows = classes.withColumn("dim", F.size("vector")).join(means, ["label", "dim"])
    halo = HALO * spread(threshold)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (_, dim), g in b.groupby(["label", "dim"]):
                cuts = max(0, math.ceil(math.log2(max(1, g["n"].iat[0] / block)) / SHRINK))
                cuts = min(cuts, 60)
                x = units(np.stack(g["vector"].to_numpy()))
                p = (x - np.array(g["mean"].iat[0])) @ lines(int(dim), cuts, 0).T if cuts else np.zeros((len(g), 0))
                at = np.arange(len(g))
                leaf, twice = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
                for t in range(cuts):
                    v = p[at, t]
                    side = (v > 0).astype(np.int64)
                    near = np.abs(v) <= halo
                    first = np.where(near, 0, side)
                    at = np.concatenate([at, at[near]])
                    leaf = np.concatenate([leaf | first << t, leaf[near] | np.int64(1) << t])
                    twice = np.concatenate([twice, twice[near] | np.int64(1) << t])
                out = g[["label", "dim", "cid", "weight", "vector"]].iloc[at]
                yield out.assign(leaf=leaf, twice=twice)[["label", "dim", "leaf", "twice", "cid", "weight", "vector"]]

    return rows.mapInPandas(deal, "label long, dim int, leaf long, twice long, cid long, weight long, vector array<double>")


def _links(a: pd.DataFrame, b: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """Links between two tiles (or inside one): per class its linked weight and
    the smallest class of its group."""
    both = a if b is None else pd.concat([a, b], ignore_index=True)
    x = np.stack(both["vector"].to_numpy())
    scaled = x / np.abs(x).max(1, keepdims=True)
    norm = np.sqrt((scaled * scaled).sum(1))
    p = (scaled / norm[:, None]) @ lines(x.shape[1], LINES, 1).T
    twice, weight, cid = (both[c].to_numpy() for c in ("twice", "weight", "cid"))
    first = np.arange(len(a))
    second = first if b is None else np.arange(len(a), len(both))
    need, reach = count_needed(), WINDOW * spread(threshold)
    order = [np.argsort(p[second, m], kind="stable") for m in range(LINES)]
    pairs_i, pairs_j = [], []
    for at in range(0, len(first), 256):
        q = first[at:at + 256]
        counts = np.zeros((len(q), len(second)), np.int8)
        rows = np.arange(len(q))
        for m in range(LINES):
            s = p[second, m][order[m]]
            marks = np.zeros((len(q), len(second) + 1), np.int8)
            marks[rows, np.searchsorted(s, p[q, m] - reach, "left")] = 1
            np.subtract.at(marks, (rows, np.searchsorted(s, p[q, m] + reach, "right")), 1)
            counts[:, order[m]] += np.cumsum(marks[:, :-1], axis=1, dtype=np.int8)
        i, j = np.nonzero(counts >= need)
        i, j = q[i], second[j]
        ok = (twice[i] & twice[j]) == 0
        if b is None:
            ok &= i < j
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 200_000):
            u, v = i[k:k + 200_000], j[k:k + 200_000]
            cos = (scaled[u] * scaled[v]).sum(1) / (norm[u] * norm[v])
            hit = cos >= threshold
            pairs_i.append(u[hit])
            pairs_j.append(v[hit])
    i, j = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (pairs_i, pairs_j))
    n = np.bincount(i, weight[j], len(both)) + np.bincount(j, weight[i], len(both)) if len(i) else np.zeros(len(both))
    group = cid.copy()
    while len(i):
        low = np.minimum(group[i], group[j])
        before = group.copy()
        np.minimum.at(group, i, low)
        np.minimum.at(group, j, low)
        if (before == group).all():
            break
    has = n > 0
    return pd.DataFrame({"cid": cid[has], "links": n[has].astype(np.int64), "low": group[has]})


def link_classes(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(cid, links, low) partial results per block; classes: cid, label, vector, weight."""
    dealt = stage(_blocks(classes, threshold, block), "vector-blocks")
    size = dealt.groupBy("label", "dim", "leaf").agg(F.count(F.lit(1)).alias("_n"))
    tiles = F.ceil(F.col("_n") / F.lit(2.0 * block)).cast("int")
    tiled = (dealt.join(size, ["label", "dim", "leaf"]).withColumn("_t", F.pmod(F.xxhash64("cid"), tiles).cast("int"))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), tiles - 1)))
             .select("label", "dim", "leaf", F.least("_t", "_o").alias("lo"), F.greatest("_t", "_o").alias("hi"),
                     F.col("_t").alias("tile"), "twice", "cid", "weight", "vector"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        lo, hi = g["lo"].iat[0], g["hi"].iat[0]
        g = g.sort_values("cid")
        a = g[g["tile"] == lo]
        b = None if lo == hi else g[g["tile"] == hi]
        if a.empty or (b is not None and b.empty):
            return pd.DataFrame({"cid": [], "links": [], "low": []}).astype("int64")
        return _links(a, b, threshold)

    return tiled.groupBy("label", "dim", "leaf", "lo", "hi").applyInPandas(run, "cid long, links long, low long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding",
                    label: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per vector: ``key``, n_links, component_id, kept."""
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("id"), F.col(label).cast("long").alias("label"),
                          F.col(vector).cast("array<double>").alias("vector"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector")
    # staged: the class numbers must stay the same for every reader
    classes = stage(rows.where(good).groupBy("label", "vector")
                    .agg(F.min("id").alias("low_id"), F.count(F.lit(1)).alias("weight"))
                    .withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    found = stage(link_classes(classes, threshold, block), "vector-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("cid").alias("a"), F.col("low").alias("b")), "vector-cc")
    own = (classes.select("cid", "label", "vector", "low_id", "weight").join(links, "cid", "left")
           .join(comp.withColumnRenamed("node", "cid"), "cid", "left")
           .withColumn("component", F.coalesce("component", "cid")))
    lowest = own.groupBy("component").agg(F.min("low_id").alias("component_id"))
    known = own.join(lowest, "component").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    # rows that link with nothing need no class
    linked = rows.where(good).join(known, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
