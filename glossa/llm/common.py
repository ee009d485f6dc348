"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that
    survives lost executors, and the point where a result is fixed for its readers."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Python workers need this package; ship it once per application."""
    ship_package(spark)


def crc_remainder(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n`` (null key: null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(n)


def held_out(key: str, n: int, remainder: int) -> Column:
    return F.coalesce(crc_remainder(key, n) == F.lit(remainder), F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(prefix: str) -> str:
    """A column name that cannot clash with a user column."""
    return f"_{prefix}_{uuid.uuid4().hex[:8]}"


def maybe_in(rows: DataFrame, wanted: DataFrame, *by: str, bits: int = 1 << 26) -> DataFrame:
    """The rows whose columns ``by`` may stand in ``wanted``, without a shuffle of ``rows``:
    a bit per hash slot, ``bits`` in all (8 MB), so the broadcast side has a fixed size. No
    row of ``wanted`` is missed; a slot that two values share only costs a row more."""
    slot = F.pmod(F.xxhash64(*by), F.lit(bits)) + 1
    s, bucket, found = fresh("s"), fresh("bucket"), fresh("bits")
    marks = wanted.select(slot.alias(s)).groupBy(F.bitmap_bucket_number(s).alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(s)).alias(found))
    at = F.bitmap_bit_position(s)
    byte = F.conv(F.hex(F.substring(found, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return (rows.withColumn(s, slot).withColumn(bucket, F.bitmap_bucket_number(s)).join(F.broadcast(marks), bucket)
            .where(F.getbit(byte, (at % 8).cast("int")) == 1).drop(s, bucket, found))


@contextmanager
def no_cycle_scans():
    """Pause the cycle collector around code that fills large tables of plain objects:
    nothing there is cyclic, and every scan would walk all of them again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b; long ids);
    the component is the smallest id reachable.

    Large-star / small-star contraction: each round links every neighbour of a
    node to the smallest of them, so the number of rounds grows with the
    logarithm of the longest chain. The neighbourhood is only ever reduced by
    ``min`` (map-side partial aggregation) and joined back, so a hub with many
    links is split by the skew join and never gathered in one task. The state
    of each round is a written table.
    """
    spark = edges.sparkSession
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"),
                                           F.least("a", "b").cast("long").alias("v")).distinct(), f"{name}-0")
    n = e.count()
    round_ = 0
    while n:
        round_ += 1
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).distinct())
        nxt = stage(small, f"{name}-{round_}")
        # finished when every node has one link and no link's target has a smaller one
        rows, nodes, chained = (nxt.agg(F.count(F.lit(1)), F.countDistinct("u")).first() +
                                (nxt.select(F.col("v").alias("u")).join(nxt.select("u").distinct(), "u", "left_semi")
                                 .limit(1).count(),))
        e = nxt
        if rows == nodes and not chained:
            break
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
