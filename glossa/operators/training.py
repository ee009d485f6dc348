"""Training-table preparation for learned quality metrics.

Covers what the fine-tuning jobs do to their inputs — column checks and renames,
string conversion, the 20 % evaluation slice, seeded shuffles, debug samples,
fixed-size batches with a role layout, step budgets — as DataFrame operators.
Batches and roles are keyed by name, never by position inside a flat tensor.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.fixed_text import EVAL_FRACTION, SHUFFLE_SEED
from glossa.functions.permute import Permutation
from glossa.functions.text import stringify
from glossa.operators.rows import head_in_order, with_index

TRIPLET_ROLES = ["src", "ref", "pos", "neg"]
REGRESSION_MAPPING = {"source": "src", "target": "mt", "score": "label"}


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def prepare_triplets(df: DataFrame, keep: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """src / ref / pos / neg as text; a missing ``ref`` column is filled from ``src``.

    The default converts every value the way ``str(v)`` does (null -> ``None``);
    ``strict=True`` keeps nulls. ``keep`` columns pass through unchanged.
    """
    if "ref" not in df.columns:
        df = df.withColumn("ref", F.col("src"))
    require(df, TRIPLET_ROLES)
    types = dict(df.dtypes)
    conv = (lambda c: F.col(c).cast("string")) if strict else (lambda c: stringify(c, dtype=types[c]))
    return df.select(*keep, *[conv(c).alias(c) for c in TRIPLET_ROLES])


def prepare_regression(df: DataFrame, mapping: dict[str, str] = REGRESSION_MAPPING,
                       keep: Sequence[str] = ()) -> DataFrame:
    """Rename to src / mt / label; text columns as ``str(v)``; label as a double.

    A label that does not read as a number (including a missing one) becomes
    null and ``label_ok`` is false, instead of failing the whole job.
    """
    require(df, list(mapping))
    types = dict(df.dtypes)
    out = [stringify(old, dtype=types[old]).alias(new) for old, new in mapping.items()]
    x = df.select(*keep, *out)
    label = mapping.get("score", "label")
    return x.withColumn(label, F.col(label).try_cast("double")) \
            .withColumn("label_ok", F.col(label).isNotNull())


def eval_split(df: DataFrame, order_col: str, frac: float = EVAL_FRACTION, key_col: str | None = None,
               disjoint: bool = False, dense: bool = False) -> DataFrame:
    """Mark the evaluation slice.

    Default: the first ``floor(n * frac)`` rows in input order are evaluation
    rows and stay in training too (``is_eval``). ``disjoint=True`` instead
    assigns each row to exactly one side by a portable hash of ``key_col``. With
    ``dense=True`` the order column already holds 0..n-1 (ids given at ingest) and
    the slice is a comparison, not a numbering.
    """
    if disjoint:
        share = hash60(F.col(key_col or order_col).cast("string"))
        return df.withColumn("split", F.when(share < F.lit(int(frac * (1 << 60))), "eval").otherwise("train"))
    cut = int(df.count() * frac)        # floor(n * frac), evaluated once
    if dense:
        return df.withColumn("is_eval", F.col(order_col) < F.lit(cut))
    x = with_index(df, order_col, out="_pos")
    return x.withColumn("is_eval", F.col("_pos") < F.lit(cut)).drop("_pos")


def hash60(text) -> F.Column:
    """The first 60 bits of the text's SHA-256 as a number (the same in any engine)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def seeded_key(key_col: str, seed: int = SHUFFLE_SEED):
    """A portable shuffle key: SHA-256 of ``seed:key``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string")), 256)


def seeded_position(df: DataFrame, key_col: str, seed: int = SHUFFLE_SEED, out: str = "shuffle_pos") -> DataFrame:
    """0-based position of every row in the seeded shuffle (ties of the 60-bit key by the key column)."""
    keyed = df.withColumn("_h60", hash60(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string"))))
    return with_index(keyed, ["_h60", key_col], out=out).drop("_h60")


def seeded_order(df: DataFrame, key_col: str, seed: int = SHUFFLE_SEED, out: str = "shuffle_key") -> DataFrame:
    return df.withColumn(out, seeded_key(key_col, seed))


def debug_sample(df: DataFrame, key_col: str, n: int, seed: int = SHUFFLE_SEED) -> DataFrame:
    """The first ``n`` rows after a seeded shuffle (a top-k, not a sort of the table)."""
    return head_in_order(df, n, seeded_key(key_col, seed), F.col(key_col))


def assign_batches(df: DataFrame, order_col: str, batch_size: int, by: Sequence[str] = ()) -> DataFrame:
    """Consecutive rows (in ``order_col`` order, per ``by`` key) into batches of ``batch_size``."""
    return batches_of(with_index(df, order_col, by=by, out="_pos"), "_pos", batch_size).drop("_pos")


def batches_of(df: DataFrame, pos_col: str, batch_size: int) -> DataFrame:
    """``batch`` and ``slot`` from a dense 0-based position: arithmetic, no shuffle."""
    return (df.withColumn("batch", F.floor(F.col(pos_col) / batch_size).cast("long"))
              .withColumn("slot", (F.col(pos_col) % batch_size).cast("int")))


def shuffled_batches(df: DataFrame, key_col: str, batch_size: int, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Batches cut along the seeded shuffle, the order training reads them in."""
    return batches_of(seeded_position(df, key_col, seed), "shuffle_pos", batch_size)


def is_dense(df: DataFrame, id_col: str) -> tuple[bool, int]:
    """Whether ``id_col`` holds 0..n-1, each once; n."""
    n, distinct, low, high = df.agg(F.count(F.lit(1)), F.count_distinct(id_col), F.min(id_col), F.max(id_col)).first()
    return n == distinct and (n == 0 or (low == 0 and high == n - 1)), n


def permuted_position(df: DataFrame, id_col: str, n: int, seed: int = SHUFFLE_SEED, out: str = "shuffle_pos") -> DataFrame:
    """Position of every row in a seeded permutation of its dense id (0..n-1): arithmetic, no shuffle."""
    return df.withColumn(out, Permutation(n, seed).column(id_col))


def permuted_batches(df: DataFrame, id_col: str, batch_size: int, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Batches along a seeded permutation. Dense ids (given at ingest) are permuted as they are; others
    are numbered first."""
    dense, n = is_dense(df, id_col)
    if dense:
        return batches_of(permuted_position(df, id_col, n, seed), "shuffle_pos", batch_size)
    numbered = with_index(df, id_col, out="_pos")
    return batches_of(permuted_position(numbered, "_pos", n, seed), "shuffle_pos", batch_size).drop("_pos")


def permuted_sample(df: DataFrame, id_col: str, n: int, size: int, seed: int = SHUFFLE_SEED) -> DataFrame:
    """The rows at the first ``size`` positions: a filter on their ids, found by the inverse."""
    ids = Permutation(n, seed).of(range(min(size, n)), inverse=True)
    return permuted_position(df, id_col, n, seed).where(F.col(id_col).isin([int(i) for i in ids]))


def to_roles(df: DataFrame, roles: Sequence[str], keys: Sequence[str] = ("batch", "slot"),
             keep: Sequence[str] = (), value: str = "text") -> DataFrame:
    """Wide -> long: one row per (keys, role) with the role's value, in its own type
    (texts, token structs, vectors: all roles must share it). ``keep`` columns, such
    as a label, go along on every row."""
    items = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias(value)) for r in roles])
    return df.select(*keys, *keep, F.posexplode(items).alias("role_pos", "_it")) \
             .select(*keys, *keep, "role_pos", "_it.role", f"_it.{value}")


def from_roles(long: DataFrame, roles: Sequence[str], keys: Sequence[str] = ("batch", "slot"),
               keep: Sequence[str] = (), value: str = "text") -> DataFrame:
    """Long -> wide by role name (never by position in a flattened block)."""
    return long.groupBy(*keys, *keep).pivot("role", list(roles)).agg(F.first(value))


def step_budget(n: F.Column, batch_size: F.Column, epochs: F.Column,
                accumulation: F.Column | None = None) -> F.Column:
    """Optimisation steps: ``floor(n / batch) * epochs``.

    As configured runs compute it, gradient accumulation is not applied; pass
    ``accumulation`` to divide (floor) the budget by the accumulation steps.
    """
    steps = F.floor(n / batch_size).cast("long") * epochs
    return steps if accumulation is None else F.floor(steps / accumulation).cast("long")


def normal_sums(df: DataFrame, features_col: str, label_col: str) -> DataFrame:
    """(i, j, v), i <= j: the sums of products of [features, 1, label] over the rows.

    A task adds up its blocks as matrix products and returns one row per pair, Spark sums
    these; what it returns grows with the square of the number of features, not with the rows.
    Rows with a null or non-finite label or feature are left out. The sums of two tables add up
    (``add_sums``), so a fit over a growing table or a stream reads only the new rows.
    """
    def run(batches):
        total = None
        for b in batches:
            x = np.stack(b["x"].to_numpy()).astype(np.float64) if len(b) else None
            if x is not None:
                part = x.T @ x
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    x = F.concat(F.transform(features_col, lambda v: v.cast("double")), F.array(F.lit(1.0), F.col(label_col).cast("double")))
    rows = df.select(x.alias("x")).where(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    return add_sums(rows.mapInPandas(run, "i int, j int, v double"))


def add_sums(*parts: DataFrame) -> DataFrame:
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("i", "j").agg(F.sum("v").alias("v"))


@dataclass(frozen=True)
class QualityHead:
    """A linear head: weights of the features, intercept, rows it was fitted on, penalty."""

    weights: list[float]
    intercept: float
    n: int
    reg: float


def solve_head(sums: DataFrame, reg: float = 0.0) -> QualityHead:
    """Least squares from ``normal_sums``, in closed form; ``reg`` times n is added to the
    features' squares (not to the intercept's)."""
    rows = sums.toPandas()
    size = int(rows["j"].max()) + 1 if len(rows) else 2
    m = np.zeros((size, size))
    m[rows["i"], rows["j"]] = m[rows["j"], rows["i"]] = rows["v"]
    d, n = size - 2, m[-2, -2]
    left = m[:-1, :-1] + np.diag([reg * n] * d + [0.0])
    beta = np.linalg.lstsq(left, m[:-1, -1], rcond=None)[0]
    return QualityHead(beta[:d].tolist(), float(beta[d]), int(n), reg)


def fit_quality_head(train: DataFrame, features_col: str, label_col: str, reg: float = 0.0) -> QualityHead:
    """Least-squares head on vector features."""
    return solve_head(normal_sums(train, features_col, label_col), reg)


def predict_quality(model: QualityHead, df: DataFrame, features_col: str, out: str = "prediction") -> DataFrame:
    weights = F.lit(model.weights) if model.weights else F.array().cast("array<double>")
    products = F.zip_with(features_col, weights, lambda x, w: x.cast("double") * w)
    return df.withColumn(out, F.aggregate(products, F.lit(model.intercept), lambda s, p: s + p))
