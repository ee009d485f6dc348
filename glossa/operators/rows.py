"""Row positions, ordered heads and lineage cuts.

``with_index`` gives each row its 0-based position inside a group. A plain
``row_number().over(Window.partitionBy(group))`` sends a whole group to one task;
when one key holds a third of the table that task is the job. Here the rows are
range-partitioned by (group, order) with sampled bounds, so any distribution of
ids and any hot group is spread evenly; they are written once with their place in
their partition, and positions follow from the partitions' row counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.session import scratch_path


def with_index(df: DataFrame, order_col: str | Sequence[str], by: Sequence[str] = (), out: str = "idx",
               partitions: int | None = None) -> DataFrame:
    """0-based position within each ``by`` group in ``order_col`` order.

    Same result as ``row_number() over (partition by by order by order_col) - 1``
    (null keys form a group, null order values come first). The order columns may
    have any sortable type and must be unique within a group (ties would make any
    row numbering nondeterministic).

    One range shuffle and one write: sampled bounds may differ when a plan runs
    again, so the numbered partitions are fixed as a table before anything is
    derived from them. The offsets are a table of partitions; a group's start is
    the smallest position in it.
    """
    by, order = list(by), [order_col] if isinstance(order_col, str) else list(order_col)
    keys = [F.col(c) for c in (*by, *order)]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    low = F.lit((1 << 33) - 1)        # the row's place in its partition
    placed = cut_lineage(ranged.sortWithinPartitions(*keys)
                         .withColumn("_rn", F.monotonically_increasing_id().bitwiseAND(low))
                         .withColumn("_pid", F.spark_partition_id()), "index-rows")
    counts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)     # a table of partitions
    offsets = counts.select("_pid", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_o"))
    whole = placed.join(offsets, "_pid").withColumn(out, (F.col("_o") + F.col("_rn")).cast("long"))
    whole = whole.drop("_pid", "_rn", "_o")
    if not by:
        return whole
    starts = (placed.join(offsets, "_pid").groupBy(*by).agg(F.min(F.col("_o") + F.col("_rn")).alias("_start"))
              .select(*[F.col(c).alias(f"_j_{c}") for c in by], "_start"))
    same = [whole[c].eqNullSafe(starts[f"_j_{c}"]) for c in by]
    return (whole.join(starts, same).withColumn(out, F.col(out) - F.col("_start"))
                 .drop("_start", *[f"_j_{c}" for c in by]))


def with_row_id(df: DataFrame, out: str = "row_id", dense: bool = True) -> DataFrame:
    """Ids in input order, assigned at ingest (call it on the scan).

    ``monotonically_increasing_id`` is unique and follows file / split order but
    leaves gaps (no shuffle: ``dense=False``); ``dense=True`` turns it into
    0..n-1 with ``with_index`` (one shuffle, no single-task window), whose written
    table fixes the ids. A column of that name is kept as it is: ids are given once.
    """
    if out in df.columns:
        return df
    if not dense:
        return df.withColumn(out, F.monotonically_increasing_id())
    return with_index(df.withColumn("_mono", F.monotonically_increasing_id()), "_mono", out=out).drop("_mono")


def spread(df: DataFrame, min_partitions: int | None = None, current_partitions: int | None = None) -> DataFrame:
    """Give a narrow, CPU-heavy stage at least as many tasks as the cluster has cores.

    A scan yields one task per file split; a file written as one row group is
    one task however large its rows are. When the input has fewer partitions
    than ``min_partitions`` (default: the session's parallelism) it is spread
    round-robin; otherwise it is returned unchanged, so on large inputs — many
    more splits than cores — this is a no-op and adds no shuffle.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions() if current_partitions is None else current_partitions
    return df.repartition(target) if parts < target else df


def attach_checked(rows: DataFrame, results: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join per-row results back by key and fail loudly on a mismatch.

    Where a list zip would silently truncate to the shorter side, this counts
    result keys without a row, rows without a result and keys with several results
    in one aggregate, and raises if any is non-zero. ``results`` (often the output of
    a model) is written first, so it is evaluated once.
    """
    keys = [on] if isinstance(on, str) else list(on)
    results = cut_lineage(results, "attach-results")
    sides = (rows.select(*keys, F.lit(1).alias("_row"), F.lit(0).alias("_res"))
             .union(results.select(*keys, F.lit(0), F.lit(1)))
             .groupBy(*keys).agg(F.sum("_row").alias("_row"), F.sum("_res").alias("_res")))
    orphans, missing, doubled = sides.agg(F.count_if(F.col("_row") == 0), F.count_if(F.col("_res") == 0),
                                                F.count_if(F.col("_res") > 1)).first()
    if orphans or missing or doubled:
        raise ValueError(f"results do not line up with rows: {orphans} results without a row, "
                         f"{missing} rows without a result, {doubled} keys with several results")
    return rows.join(results, keys, how)


def head_in_order(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """First ``n`` rows in a stated order (a bare ``limit`` is not deterministic).

    ``orderBy + limit`` plans as a top-k (TakeOrderedAndProject): each task keeps
    n rows, no full sort, no shuffle of the table.
    """
    return df.orderBy(*order).limit(n)


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a plan must not be recomputed (outputs of paid model calls) or a
    result is reused by several later stages; survives executor loss because the
    files live in the cluster's shared folder, not on a worker.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
