"""Skew-safe numbering, batches, splits, training-table preparation."""

import pytest
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.fixed_text import RUN_CONFIGS
from glossa.functions.tokens import pad_encode
from glossa.operators import training as T
from glossa.operators.rows import with_index


def skewed(spark, n=3000):
    # key 0 holds a third of the rows; ids are sparse and unordered
    data = [(i * 7 + 3, 0 if i % 3 == 0 else i % 50) for i in range(n)]
    return spark.createDataFrame(data, "id long, k int")


@pytest.mark.parametrize("partitions", [None, 1, 37])
def test_with_index_matches_window(spark, partitions):
    df = skewed(spark)
    ours = with_index(df, "id", by=["k"], out="idx", partitions=partitions)
    ref = df.withColumn("idx", F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1)
    assert sorted(map(tuple, ours.select("id", "k", "idx").collect())) == \
        sorted(map(tuple, ref.select("id", "k", F.col("idx").cast("long")).collect()))


def test_with_index_global(spark):
    df = skewed(spark, 500)
    ours = with_index(df, "id", out="idx", partitions=12)
    got = sorted((r.id, r.idx) for r in ours.collect())
    assert [idx for _, idx in got] == list(range(500))


def task_rows(df):
    """Rows per partition of the table that ``with_index`` wrote last."""
    return sorted(r[0] for r in df.groupBy("_pid").count().select("count").collect())


@pytest.mark.parametrize("ids", ["outlier", "clustered", "hot"])
def test_no_task_gets_most_rows(spark, ids, monkeypatch):
    """Outliers, clustered ids and a hot group: the largest task stays near the mean."""
    from glossa.operators import rows as R

    n = 20_000
    base = spark.range(n)
    if ids == "outlier":
        df = base.select(F.when(F.col("id") == 0, 10**15).otherwise(F.col("id")).alias("id"), F.lit(1).alias("k"))
    elif ids == "clustered":
        df = base.repartition(3).select(F.monotonically_increasing_id().alias("id"), F.lit(1).alias("k"))
    else:
        df = base.select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("k"))
    written = []
    cut = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda d, name="cut": written.append(cut(d, name)) or written[-1])
    got = with_index(df, "id", by=["k"], out="idx", partitions=16)
    rows = task_rows(written[0])
    assert len(rows) == 16 and rows[-1] < 2 * n / 16
    ref = df.withColumn("idx", (F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1).cast("long")) \
        if ids != "clustered" else None
    if ref is not None:
        assert got.select("id", "idx").exceptAll(ref.select("id", "idx")).count() == 0
    assert sorted(r.idx for r in got.where(F.col("k") == (-1 if ids == "hot" else 1)).collect()) == \
        list(range(got.where(F.col("k") == (-1 if ids == "hot" else 1)).count()))


def test_triplets_without_ref_and_stringify(spark):
    df = spark.createDataFrame([("s", "p", None)], "src string, pos string, neg string")
    r = T.prepare_triplets(df).first()
    assert (r.src, r.ref, r.pos, r.neg) == ("s", "s", "p", "None")
    assert T.prepare_triplets(df, strict=True).first().neg is None
    with pytest.raises(ValueError, match="Missing required columns"):
        T.prepare_triplets(spark.createDataFrame([("s",)], "src string"))


def test_regression_rows(spark):
    df = spark.createDataFrame([("a", "b", 0.5), ("c", "d", None)], "source string, target string, score double")
    rows = {r.src: r for r in T.prepare_regression(df).collect()}
    assert rows["a"].mt == "b" and rows["a"].label == 0.5 and rows["a"].label_ok
    assert rows["c"].label is None and not rows["c"].label_ok
    with pytest.raises(ValueError, match="Missing required column"):
        T.prepare_regression(df.drop("target"))


def test_batches_and_roles_roundtrip(spark):
    df = spark.createDataFrame([(i, f"s{i}", f"m{i}") for i in range(19)], "row_id long, src string, mt string")
    b = T.assign_batches(df, "row_id", 8)
    assert sorted((r.batch, r.slot) for r in b.collect())[-1] == (2, 2)
    wide = T.from_roles(T.to_roles(b, ["src", "mt"]), ["src", "mt"])
    got = sorted((r.batch, r.slot, r.src, r.mt) for r in wide.collect())
    assert got == sorted((i // 8, i % 8, f"s{i}", f"m{i}") for i in range(19))


def test_eval_split(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    x = T.eval_split(df, "doc_id")
    assert sorted(r.doc_id for r in x.where("is_eval").collect()) == list(range(10))
    y = T.eval_split(df, "doc_id", disjoint=True)
    assert {r.split for r in y.collect()} == {"eval", "train"}


def test_disjoint_split_at_any_fraction(spark):
    df = spark.range(10_000).withColumnRenamed("id", "doc_id")
    n = {f: T.eval_split(df, "doc_id", frac=f, disjoint=True).where("split = 'eval'").count() for f in (0.0, 0.003, 0.2, 1.0)}
    assert n[0.0] == 0 and n[1.0] == 10_000 and 10 <= n[0.003] <= 60 and 1800 <= n[0.2] <= 2200


def test_shuffled_batches_follow_the_seed(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    first = [r.doc_id for r in T.shuffled_batches(df, "doc_id", 8).where("batch = 0").orderBy("slot").collect()]
    assert len(first) == 8 and first != list(range(8))
    assert first == [r.doc_id for r in T.shuffled_batches(df.repartition(5), "doc_id", 8).where("batch = 0")
                     .orderBy("slot").collect()]


def test_roles_keep_types_and_label(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0], [3.0, 4.0], 0.5)],
                               "batch long, slot int, src array<float>, mt array<float>, label double")
    long = T.to_roles(df, ["src", "mt"], keep=["label"], value="embedding")
    assert dict(long.dtypes)["embedding"] == "array<float>"
    assert [(r.role, r.embedding, r.label) for r in long.orderBy("role_pos").collect()] == \
        [("src", [1.0, 2.0], 0.5), ("mt", [3.0, 4.0], 0.5)]
    wide = T.from_roles(long, ["src", "mt"], keep=["label"], value="embedding").first()
    assert (wide.src, wide.mt, wide.label) == ([1.0, 2.0], [3.0, 4.0], 0.5)


def test_attach_checked(spark):
    from glossa.operators.rows import attach_checked

    rows = spark.range(10).withColumnRenamed("id", "row_id")
    good = rows.withColumn("score", F.col("row_id") * 2)
    assert attach_checked(rows, good, "row_id").count() == 10
    for bad, text in ((good.where("row_id < 9"), "1 rows without"), (good.union(good), "10 keys with several"),
                      (good.union(spark.createDataFrame([(77, 1)], "row_id long, score long")), "1 results without")):
        with pytest.raises(ValueError, match=text):
            attach_checked(rows, bad, "row_id")


def test_float_text_as_python(spark):
    from glossa.functions.text import stringify

    values = [1e-05, 1e10, 0.1, 123.456, 1e16, 1e15, 1.5e300, -2.5e-7, 0.0, -0.0, 1e-4, 0.00012345, 100.0, 12345678.9,
              float("nan"), float("inf"), -float("inf")]
    d = spark.createDataFrame([(v,) for v in values], "v double").select("v", stringify("v", dtype="double").alias("s"))
    assert [(str(r.v), r.s) for r in d.collect()] == [(str(r), str(r)) for r in values]


def test_debug_sample_is_seeded(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    a = [r.doc_id for r in T.debug_sample(df, "doc_id", 10).collect()]
    b = [r.doc_id for r in T.debug_sample(df.repartition(7), "doc_id", 10).collect()]
    assert a == b and len(set(a)) == 10 and a != list(range(10))


def test_step_budget(spark):
    df = spark.createDataFrame([(n, b, e) for _, _, b, e, _, _, t in RUN_CONFIGS for n in [t or 50000]],
                               "n long, b int, e int")
    got = [r.s for r in df.select(T.step_budget(F.col("n"), F.col("b"), F.col("e")).alias("s")).collect()]
    assert got[0] == (50000 // 8) * 2 == 12500


def test_pad_encode(spark):
    df = spark.createDataFrame([("a  b\tc\n",), ("",), (None,)], "t string")
    rows = df.select(pad_encode(F.col("t"), 4).alias("e")).collect()
    assert rows[0].e.tokens == ["a", "b", "c", "<pad>"] and rows[0].e.attention_mask == [1, 1, 1, 0]
    assert rows[1].e.tokens == ["<pad>"] * 4 and rows[2].e.attention_mask == [0] * 4
    assert rows[0].e.input_ids[3] == 0 and all(i > 0 for i in rows[0].e.input_ids[:3])


def test_vocab_ids(spark):
    from glossa.functions.tokens import pad_tokens, vocab_ids, whitespace_tokens
    df = spark.createDataFrame([(1, "the cat sat"), (2, "the dog")], "k long, t string")
    df = df.withColumn("tokens", pad_tokens(whitespace_tokens(F.col("t")), 4))
    vocab = spark.createDataFrame([("the", 5), ("cat", 6), ("sat", 7)], "token string, id long")
    got = {r.k: r.input_ids for r in vocab_ids(df, "tokens", vocab, "k").collect()}
    assert got == {1: [5, 6, 7, 0], 2: [5, 1, 0, 0]}


def test_vocab_ids_all_padding(spark):
    from glossa.functions.tokens import pad_tokens, vocab_ids, whitespace_tokens
    df = spark.createDataFrame([(1, "")], "k long, t string").withColumn(
        "tokens", pad_tokens(whitespace_tokens(F.col("t")), 3))
    vocab = spark.createDataFrame([("x", 5)], "token string, id long")
    assert vocab_ids(df, "tokens", vocab, "k").first().input_ids == [0, 0, 0]


def test_step_budget_accumulation(spark):
    df = spark.createDataFrame([(50000, 8, 2, 4)], "n long, b int, e int, g int")
    r = df.select(T.step_budget(F.col("n"), F.col("b"), F.col("e")).alias("s"),
                  T.step_budget(F.col("n"), F.col("b"), F.col("e"), F.col("g")).alias("a")).first()
    assert (r.s, r.a) == (12500, 3125)


def test_with_index_null_keys_and_orders(spark):
    data = [(1, None), (2, None), (None, "a"), (3, "a"), (5, "a"), (None, None)]
    df = spark.createDataFrame(data, "id long, k string")
    ours = with_index(df, "id", by=["k"], out="idx", partitions=4)
    ref = df.withColumn("idx", (F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1).cast("long"))
    assert sorted(map(tuple, ours.select("id", "k", "idx").collect()), key=str) == \
        sorted(map(tuple, ref.select("id", "k", "idx").collect()), key=str)


def test_stringify_like_python(spark):
    df = spark.createDataFrame([("s", True, None), ("t", False, 3)], "src string, pos boolean, neg int")
    rows = [(r.src, r.pos, r.neg) for r in T.prepare_triplets(df).orderBy("src").collect()]
    assert rows == [("s", str(True), str(None)), ("t", str(False), str(3))]


def test_scratch_of_a_run_is_cleared(spark):
    import os

    from glossa.operators.rows import cut_lineage
    from glossa.session import clear_scratch, scratch_root

    spark.conf.set("glossa.run", "to-clear")
    try:
        kept = cut_lineage(spark.range(5), "clear").count()
        root = scratch_root(spark).removeprefix("file://")
        assert kept == 5 and os.listdir(root)
        assert clear_scratch(spark) and not os.path.exists(root)
    finally:
        spark.conf.unset("glossa.run")
    assert not scratch_root(spark).endswith("to-clear")


def test_vocab_ids_beyond_the_broadcast_bound(spark):
    """Same ids by either way; without a broadcast dictionary no row's tokens are regrouped."""
    from glossa.functions.tokens import pad_tokens, vocab_ids, whitespace_tokens
    df = spark.range(500).select("id", F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k) % 97) for k in (1, 3, 7)]).alias("t"))
    df = df.union(df.limit(3)).withColumn("tokens", pad_tokens(whitespace_tokens(F.col("t")), 5))
    df = df.union(df.limit(1).withColumn("tokens", F.lit(None).cast("array<string>")))
    vocab = spark.range(60).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") + 2).alias("id"))
    one, two = (sorted(map(str, vocab_ids(df, "tokens", vocab, "id", map_bytes=b).collect())) for b in (1 << 20, 0))
    assert one == two and len(one) == 504
    plan = vocab_ids(df, "tokens", vocab, "id")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan


def test_permutations_and_their_inverse(spark):
    from glossa.functions.permute import Permutation
    for n in [*range(0, 40), 1000, 1001, 4095, 4097]:
        p = Permutation(n, 7)
        got = p.of(range(n))
        assert sorted(got.tolist()) == list(range(n)) and (p.of(got, inverse=True) == np.arange(n)).all()
    assert Permutation(1000, 1).of(range(1000)).tolist() != Permutation(1000, 2).of(range(1000)).tolist()
    for n in (1, 2, 3, 5, 7, 1000, 10_007):
        p = Permutation(n, 42)
        rows = spark.range(n).withColumn("p", p.column("id")).withColumn("back", p.column("p", inverse=True)).toPandas()
        assert (rows.back == rows.id).all() and (rows.p == p.of(rows.id)).all()
    big = Permutation((1 << 40) - 3, 5)
    ids = np.array([0, 1, 12345678901, (1 << 40) - 4])
    rows = spark.createDataFrame([(int(i),) for i in ids], "id long").withColumn("p", big.column("id")).toPandas()
    assert (big.of(big.of(ids), inverse=True) == ids).all() and (np.sort(rows.p) == np.sort(big.of(ids))).all()


def test_a_permutation_spreads(spark):
    """Neighbours land anywhere: every tenth of the ids meets every tenth of the positions evenly."""
    from glossa.functions.permute import Permutation
    n = 20_000
    p = Permutation(n, 42).of(range(n))
    table = np.histogram2d(np.arange(n), p, bins=10)[0]
    assert abs(table - n / 100).max() < 80
    assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.03


def test_permuted_batches_have_no_exchange(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    out = T.permuted_batches(df, "row_id", 8)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.select("batch", "slot").distinct().count() == 1000 and out.agg(F.max("batch")).first()[0] == 124
    gaps = T.permuted_batches(df.withColumn("row_id", F.col("row_id") * 3), "row_id", 8)
    assert sorted(r.shuffle_pos for r in gaps.collect()) == list(range(1000))
    sample = T.permuted_sample(df, "row_id", 1000, 10)
    assert sorted(r.shuffle_pos for r in sample.collect()) == list(range(10))


def test_head_sums_add_up(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(300, 4)), np.array([1.0, -1.0, 2.0, 0.0])
    y = x @ w + 3 + rng.normal(size=300) * 0.1
    rows = [(x[i].tolist(), float(y[i])) for i in range(300)] + [([1.0, None, 0.0, 0.0], 1.0), ([1.0] * 4, None), ([float("nan")] * 4, 0.0)]
    df = spark.createDataFrame(rows, "f array<double>, label double").withColumn("part", F.monotonically_increasing_id() % 2)
    whole = T.normal_sums(df, "f", "label")
    parts = [T.normal_sums(df.where(F.col("part") == k), "f", "label") for k in (0, 1)]
    one, two = T.solve_head(whole, 0.1), T.solve_head(T.add_sums(*parts), 0.1)
    assert one.n == two.n == 300 and np.allclose(one.weights, two.weights)
    ext = np.column_stack([x, np.ones(300)])
    want = np.linalg.solve(ext.T @ ext + np.diag([30.0] * 4 + [0.0]), ext.T @ y)
    assert np.allclose([*one.weights, one.intercept], want)
    assert T.solve_head(T.normal_sums(df.where("false"), "f", "label")).n == 0
