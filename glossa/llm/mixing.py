"""Mixing sources to target weights by pivotal dependent rounding (operator 1).

Targets. Sources, ordered by code point with null last, get the weights of a
repeating pattern and share ``total`` times all words; a source's target stops
at ``cap`` times its size and the excess is shared by weight among the others
until none is above (a water level, found by running sums over the sources).

Copies. Every document of a source should be taken target / size times. The whole
part is taken outright; the fractional parts are rounded together: two
documents at a time, words are moved at random from one to the other, keeping
their sum and each document's expectation, until one of them is taken fully or
not at all. The one left over goes on to the next pair. Documents are dealt by
hash into buckets of about ``BUCKET`` (so a hot source is many buckets); each
bucket leaves one fractional document, and these residuals meet in buckets of the
next level: a reduction tree whose depth is the logarithm of the largest source.
The last residual of a source goes to the nearer side, so a source's taken words
differ from its target by at most half of one document (plus rounding of
2^-20 words). All draws are hashes of the documents' keys, so reruns agree.
Only DataFrame functions are used.

Edge cases: null text and text without words have size 0 and are never taken in
words (their ``copies`` follow an own draw). Repeated rows are rounded as one
document with that many copies and dealt out over the rows. A source without
words has target 0. Empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import stage

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
CAP = 2.0
BUCKET = 128
UNITS = 20              # words are moved in steps of 2^-20
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size) plus target. One row per source, so the
    windows below order a table of sources, not of documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                           ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("w", pattern).withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("w"))
    level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    everywhere = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("share", (F.lit(total) * F.sum("source_size").over(everywhere)
                               - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
                     / F.sum("w").over(after))
    w = w.withColumn("full", F.col("share") > F.col("ratio"))
    open_share = F.first(F.when(~F.col("full"), F.col("share")), ignorenulls=True).over(everywhere)
    return w.select("source", "source_size",
                    F.when(F.col("full"), F.lit(cap) * F.col("source_size"))
                    .otherwise(F.col("w") * open_share).alias("target"))


def _uniform(*cols) -> F.Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


# One pivotal step over a bucket's documents, largest first. ``p`` is the pending
# fractional document, ``e`` the next: words move from one to the other so that one
# becomes whole; the other stays pending.
_STEP = """
aggregate(
  slice(items, 2, greatest(size(items) - 1, 0)),
  named_struct('p', items[0], 'done', slice(items, 1, 0)),
  (acc, e) -> transform(array(named_struct(
      'up', least((acc.p.size << {u}) - acc.p.a, e.a),
      'down', least(acc.p.a, (e.size << {u}) - e.a))),
    s -> transform(array(if(
        pmod(xxhash64({seed}L, acc.p.key, acc.p.size, e.key, e.size), 1099511627776L) / 1099511627776D
          * (s.up + s.down) < s.down, s.up, -s.down)),
      move -> if(acc.p.a + move = 0 or acc.p.a + move = acc.p.size << {u},
        named_struct('p', {e_moved}, 'done', concat(acc.done, array({p_moved}))),
        named_struct('p', {p_moved}, 'done', concat(acc.done, array({e_moved})))))[0])[0],
  acc -> concat(acc.done, array(acc.p)))
"""


def _moved(name: str, sign: str) -> str:
    return (f"named_struct('size', {name}.size, 'key', {name}.key, 'rows', {name}.rows, "
            f"'whole', {name}.whole, 'a', {name}.a {sign} move)")


def round_copies(items: DataFrame, bucket: int = BUCKET, seed: int = 0) -> DataFrame:
    """``items``: source, source_size, target, key, size, rows, whole, a (the
    fractional part in units of 2^-20 words, between 0 and size). Returns the same
    rows with ``a`` moved to 0 or to the whole size. Two residuals of a source
    never stay unpaired: every level halves a bucket's residuals to one."""
    whole = F.shiftleft("size", UNITS)
    open_ = (F.col("a") > 0) & (F.col("a") < whole)
    source = ["source", "source_size", "target"]
    columns = [*source, "key", "size", "rows", "whole", "a"]
    done = [items.where(~open_).select(*columns)]
    left = items.where(open_)
    counts = left.groupBy(*source).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    left = left.select(*columns, F.lit(None).cast("long").alias("n"))
    by = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ["source"]]
    left = (left.drop("n").alias("l").join(counts.select("source", "n").alias("r"), by)
            .select(*[F.col(f"l.{c}").alias(c) for c in columns], F.col("r.n").alias("n")))
    level = 0
    step = _STEP.format(u=UNITS, seed="{seed}", p_moved=_moved("acc.p", "+"), e_moved=_moved("e", "-"))
    while most:
        buckets = F.ceil(F.col("n") / F.lit(float(bucket))).cast("long")
        dealt = left.select(*columns, buckets.alias("n"), F.pmod(
            F.xxhash64(F.lit(seed), F.lit(level), "key", "size"), buckets).alias("b"))
        groups = dealt.groupBy(*source, "n", "b").agg(F.sort_array(F.collect_list(
            F.struct("size", "key", "rows", "whole", "a")), asc=False).alias("items"))
        rounded = groups.select(*source, "n", F.explode(F.expr(step.replace("{seed}", str(seed * 1000 + level)))).alias("i"))
        out = stage(rounded.select(*source, "i.key", "i.size", "i.rows", "i.whole", "i.a", "n"), f"mix-{level}")
        done.append(out.where(~open_).select(*columns))
        left = out.where(open_)
        level += 1
        if most <= 1 or (most := -(-most // bucket)) <= 1:
            break
    # one fractional document per source is left: the nearer side
    done.append(left.select(*source, "key", "size", "rows", "whole",
                            F.when(F.col("a") * 2 >= whole, whole).otherwise(F.lit(0)).alias("a")))
    result = done[0]
    for d in done[1:]:
        result = result.union(d)
    return result


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, total: float = TOTAL, cap: float = CAP, key: str = "doc_id",
        source: str = "source", text: str = "text", seed: int = 0, bucket: int = BUCKET) -> DataFrame:
    """One row per document: ``key``, size, source_size, target, taken (words the
    mix takes, repeats counted), copies, ``source``."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    items = stage(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"))
                  .groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-items")
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goal = targets(sizes, weights, total, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.col("rows") * rate
    planned = (items.alias("i").join(goal.alias("g"), F.col("i.source").eqNullSafe(F.col("g.source")))
               .select("i.key", "i.source", "i.size", "i.rows", "g.source_size", "g.target")
               .withColumn("whole", F.floor(wanted)).withColumn("rest", wanted - F.col("whole"))
               .withColumn("a", F.round(F.col("rest") * F.shiftleft("size", UNITS)).cast("long")))
    planned = stage(planned, "mix-planned")
    rounded = round_copies(planned.where("size > 0"), bucket, seed)
    empty = planned.where("size = 0").select(
        "source", "source_size", "target", "key", "size", "rows",
        (F.col("whole") + (_uniform(F.lit(seed), "key", "source") < F.col("rest")).cast("long")).alias("whole"), "a")
    out = rounded.union(empty).withColumn("n", F.col("whole") + F.when(F.col("size") > 0, F.col("a") / F.shiftleft(
        "size", UNITS)).otherwise(0).cast("long"))
    # repeated rows share the document's copies evenly
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    copies = F.floor(F.col("n") / F.col("rows")) + (F.col("row") <= F.col("n") % F.col("rows")).cast("long")
    return out.withColumn("copies", copies).select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        "copies", F.col("source").alias(source))
