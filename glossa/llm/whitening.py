"""Embedding whitening from a bit-sliced scatter matrix (operator 13).

Entries become integers x = floor(256 c); the model is fitted to the distinct x
vectors (an aggregation, so copies cost nothing extra). Three passes over them:

* per dimension: number, sum, least and largest value;
* scatter: a dimension's values, shifted to start at 0, are cut into bit planes,
  and each plane is packed across the rows of a slice into 64-bit words. The cross-product
  of dimensions i and j is the sum over their planes b, c of 2^(b+c) times the popcount of
  the words' AND: exact integers. A task adds its slices up and returns one row
  per pair of dimensions; Spark sums them as decimals;
* after the fit: the covariance of the whitened values, for ``identity_error``.

The scatter is centred as integers, n * sum(y_i y_j) - sum(y_i) sum(y_j), and only then
divided by n^2, so nothing cancels in floating point; ``numpy.linalg.eigh`` gives
the components. The model is of fixed size (dimension squared) and is sent to the tasks
that transform every row. Tasks hold a slice of ``ROWS`` vectors at a time.

Edge cases: vectors that are null or hold null or non-finite entries are dropped;
an empty vector has no component and gives no row. Vectors of different lengths are
whitened apart, each length with a model of its own. Components whose variance is
0 (below ``TINY`` of the trace; one vector, constant or dependent dimensions) are left
out, as nothing can be scaled to variance 1. ``deviation`` is null where it exceeds 64
bits. Entries beyond 2^38 in size count as that size. Repeated rows are rows of their
own; equal eigenvalues come in the order eigh gives. Empty table: empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import prepare, stage

SCALE = 256
COMPONENTS = 4
ROWS = 1 << 14
LARGEST = 1 << 46        # of x
TINY = 1e-13


def integers(vector: str) -> Column:
    """x of a vector column; null where an entry is null or not finite."""
    c = F.col(vector)
    finite = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    x = F.transform(c, lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(
        F.greatest(F.lit(-2.0 * LARGEST), F.least(F.lit(2.0 * LARGEST), v.cast("double") * SCALE))))).cast("long"))
    return F.when(finite & (F.size(c) > 0), x)


def planes(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of the columns of ``y`` (rows x dims, not negative): for each dimension
    its ``bits`` planes, each packed across the rows into 64-bit words."""
    words = -(-len(y) // 64)
    dim = np.repeat(np.arange(y.shape[1]), bits)
    bit = np.arange(bits.sum()) - np.repeat(np.cumsum(bits) - bits, bits)
    out = np.zeros((len(dim), words * 8), np.uint8)
    for p, (d, b) in enumerate(zip(dim.tolist(), bit.tolist())):
        packed = np.packbits((y[:, d] >> b & 1).astype(np.uint8))
        out[p, :len(packed)] = packed
    return out.view(np.uint64)


def cross_products(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Exact sums of y_i y_j over the rows, as Python integers (dims x dims)."""
    p = planes(y, bits)
    counts = np.zeros((len(p), len(p)), np.int64)
    for k in range(len(p)):
        counts[k, k:] = np.bitwise_count(p[k] & p[k:]).sum(1, dtype=np.int64)
    counts = np.maximum(counts, counts.T)        # symmetric: the lower half is still 0
    dims = y.shape[1]
    dim = np.repeat(np.arange(dims), bits)
    bit = np.arange(bits.sum()) - np.repeat(np.cumsum(bits) - bits, bits)
    wide = 2 * int(bits.max(initial=0)) + len(y).bit_length() > 62
    weight = np.array([1 << b for b in bit.tolist()], object if wide else np.int64)
    start = np.flatnonzero(np.concatenate([[True], dim[1:] != dim[:-1]])) if len(dim) else np.zeros(0, np.int64)
    out = np.zeros((dims, dims), object)
    if len(dim):
        weighted = (counts.astype(object) if wide else counts) * weight[:, None] * weight[None, :]
        part = np.add.reduceat(np.add.reduceat(weighted, start, axis=0), start, axis=1)
        out[np.ix_(dim[start], dim[start])] = part.astype(object)
    return out


@dataclass
class Model:
    """Fitted whitening of vectors of one length."""

    n: int
    total: np.ndarray            # S, int64
    axes: np.ndarray             # dims x components
    values: np.ndarray           # eigenvalues of the components
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S; Python integers where 64 bits might not do."""
        most = max(1, int(np.abs(x).max(initial=0)))
        wide = self.n * most + int(np.abs(self.total).max(initial=0)) >= 1 << 62
        x = x.astype(object) if wide else x
        return x * self.n - (self.total.astype(object) if wide else self.total)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) / self.n @ self.axes / np.sqrt(self.values)

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        """Sum of squares per row; null beyond 64 bits."""
        most = int(np.abs(centred).max(initial=0))
        if most * most * max(1, centred.shape[1]) < 1 << 63:
            return (centred.astype(np.int64) ** 2).sum(1).tolist()
        sums = [sum(v * v for v in row) for row in centred.astype(object).tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def _stacks(b: pd.DataFrame, column: str = "x") -> Iterator[tuple[int, np.ndarray, pd.DataFrame]]:
    """(length, matrix, its rows) for each vector length of a batch, in slices of ROWS."""
    for dims, g in b.groupby(b[column].str.len()):
        for at in range(0, len(g), ROWS):
            part = g.iloc[at:at + ROWS]
            yield int(dims), np.stack(part[column].to_numpy()).astype(np.int64), part


def _totals(fit: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """n, S, least and largest value per dimension, for each vector length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, x, _ in _stacks(b):
                total = x.astype(object).sum(0) if len(x) * LARGEST >= 1 << 62 and np.abs(x).max() >= 1 << 40 else x.sum(0)
                yield pd.DataFrame({"dims": dims, "d": np.arange(dims), "n": len(x), "total": [Decimal(int(t)) for t in total],
                                    "low": x.min(0), "high": x.max(0)})

    got = (fit.mapInPandas(run, "dims int, d int, n long, total decimal(38,0), low long, high long").groupBy("dims", "d")
           .agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
           .toPandas().sort_values(["dims", "d"]))
    return {int(dims): (int(g["n"].iat[0]), np.array([int(t) for t in g["total"]], object),
                        g["low"].to_numpy(np.int64), g["high"].to_numpy(np.int64)) for dims, g in got.groupby("dims")}


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """Models by vector length; ``vectors``: distinct x."""
    known = _totals(vectors)
    shape = {dims: (low, np.array([int(h - lo).bit_length() for lo, h in zip(low.tolist(), high.tolist())], np.int64))
             for dims, (_, _, low, high) in known.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for dims, x, _ in _stacks(b):
                low, bits = shape[dims]
                sums[dims] = sums.get(dims, 0) + cross_products(x - low, bits)
        for dims, m in sums.items():
            i, j = np.triu_indices(dims)
            yield pd.DataFrame({"dims": dims, "i": i, "j": j, "product": [Decimal(int(v)) for v in m[i, j]]})

    rows = (vectors.mapInPandas(run, "dims int, i int, j int, product decimal(38,0)").groupBy("dims", "i", "j")
            .agg(F.sum("product").alias("product")).toPandas())
    models = {}
    for dims, g in rows.groupby("dims"):
        n, total, low, _ = known[int(dims)]
        shifted = [t - n * lo for t, lo in zip(total.tolist(), low.tolist())]
        cov = np.zeros((dims, dims))
        for i, j, product in zip(g["i"].tolist(), g["j"].tolist(), g["product"]):
            cov[i, j] = cov[j, i] = (n * int(product) - shifted[i] * shifted[j]) / (n * n)
        values, axes = np.linalg.eigh(cov)
        trace = float(np.trace(cov))
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > TINY * trace]
        sums = total.astype(np.int64) if max(map(abs, total.tolist()), default=0) < 1 << 63 else total
        models[int(dims)] = Model(n, sums, axes[:, order], values[order], values[order] / trace if trace else values[order])
    return models


def identity_error(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest entry of the whitened covariance minus the identity, per vector length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, x, _ in _stacks(b):
                m = models[dims]
                z = m.whitened(m.centred(x))
                i, j = np.triu_indices(z.shape[1])
                yield pd.DataFrame({"dims": dims, "i": i, "j": j, "zz": (z.T @ z)[i, j]})
                yield pd.DataFrame({"dims": dims, "i": np.arange(z.shape[1]), "j": -1, "zz": z.sum(0)})

    got = vectors.mapInPandas(run, "dims int, i int, j int, zz double").groupBy("dims", "i", "j").agg(F.sum("zz").alias("zz"))
    out = {}
    for dims, g in got.toPandas().groupby("dims"):
        k, n = models[int(dims)].axes.shape[1], models[int(dims)].n
        mean = g[g.j < 0].set_index("i")["zz"].reindex(range(k)).to_numpy() / n
        cov = np.zeros((k, k))
        for i, j, v in g.loc[g.j >= 0, ["i", "j", "zz"]].itertuples(index=False):
            cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
        out[int(dims)] = float(np.abs(cov - np.eye(k)).max(initial=0.0))
    return out


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``key``, component, n, deviation, whitened,
    explained, identity_error."""
    spark = rows.sparkSession
    prepare(spark)
    ready = rows.select(F.col(key).alias("id"), integers(vector).alias("x")).where("x is not null")
    distinct = stage(ready.select("x").distinct(), "whitening-fit")
    models = fit(distinct, components)
    errors = identity_error(distinct, models)

    @F.pandas_udf("n long, deviation long, z array<double>, explained array<double>, error double")
    def transform(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            b = pd.DataFrame({"x": s.to_numpy()})
            out = []
            for dims, x, part in _stacks(b):
                m = models[dims]
                centred = m.centred(x)
                out.append(pd.DataFrame({
                    "n": m.n, "deviation": pd.array(m.deviation(centred), "Int64"), "z": list(m.whitened(centred)),
                    "explained": [m.explained] * len(x), "error": errors.get(dims, 0.0)}, index=part.index))
            yield pd.concat(out).sort_index() if out else pd.DataFrame(
                {"n": [], "deviation": [], "z": [], "explained": [], "error": []})

    done = ready.select("id", transform("x").alias("w"))
    return done.select("id", "w", F.posexplode(F.arrays_zip("w.z", "w.explained")).alias("at", "c")).select(
        F.col("id").alias(key), (F.col("at") + 1).alias("component"), "w.n", "w.deviation", F.col("c")["z"].alias("whitened"),
        F.col("c")["explained"].alias("explained"), F.col("w")["error"].alias("identity_error"))
