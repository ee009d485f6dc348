"""Vector metrics against numpy, QA score, scoring UDFs with stand-in models."""

import numpy as np
from pyspark.sql import functions as F

from glossa.functions.vectors import harmonic_mean, l2_distance
from glossa.operators import metrics as M
from glossa.operators.scoring import encode_texts, generate_judgements, score_segments
from glossa.operators.stubs import LetterEncoder, LengthRatioScorer, StubJudge
from glossa.operators import training as T


def dist(a, b, eps=1e-6):
    return float(np.sqrt(np.sum((np.asarray(a, float) - np.asarray(b, float) + eps) ** 2)))


def test_triplet_metrics_brute_force(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(30, 4, 8)).astype(np.float32)
    df = spark.createDataFrame([tuple(v.tolist() for v in t) for t in vecs],
                               "src array<float>, ref array<float>, pos array<float>, neg array<float>")
    got = M.triplet_metrics(df).first()
    ls = np.mean([max(dist(s, p) - dist(s, n) + 1, 0) for s, r, p, n in vecs])
    lr = np.mean([max(dist(r, p) - dist(r, n) + 1, 0) for s, r, p, n in vecs])
    hp = np.mean([2 * dist(p, s) * dist(p, r) / (dist(p, s) + dist(p, r)) for s, r, p, n in vecs])
    hn = np.mean([2 * dist(n, s) * dist(n, r) / (dist(n, s) + dist(n, r)) for s, r, p, n in vecs])
    assert abs(got.loss - (ls + lr)) < 1e-9
    assert abs(got.distance_pos - hp) < 1e-9 and abs(got.distance_neg - hn) < 1e-9
    assert got.n == 30


def test_harmonic_guard(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "a double, b double")
    assert [r.h for r in df.select(harmonic_mean(F.col("a"), F.col("b")).alias("h")).collect()] == [None, 1.5]


def test_l2_distance(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.0, 4.0])], "a array<float>, b array<float>")
    assert abs(df.select(l2_distance(F.col("a"), F.col("b")).alias("d")).first().d - dist([1, 2], [0, 4])) < 1e-12


def test_qa_score_weights(spark):
    df = spark.createDataFrame([(1, "{'1': 'YES', '2': 'no', '3': 'maybe', '4': 'N/A'}"), (2, "nothing"),
                                (3, "{'1': 'N/A'}")], "row_id long, response string")
    got = {r.row_id: r.score for r in M.with_qa_score(df, questions=4).collect()}
    assert got == {1: 0.5, 2: None, 3: None}
    w = {r.row_id: r.score for r in M.with_qa_score(df, weights={"1": 3.0, "2": 1.0}).collect()}
    assert w[1] == 0.75


def test_answers_long_and_tallies(spark):
    df = spark.createDataFrame([(1, "a", "{'1': 'YES', '2': 'NO'}"), (2, "a", "{'1': 'yes', '2': 'x'}")],
                               "row_id long, model string, response string")
    t = {r.qid: (r.yes, r.no, r.maybe, r.invalid) for r in M.answer_tallies(M.answers_long(df)).collect()}
    assert t == {1: (2, 0, 0, 0), 2: (0, 1, 0, 1)}


def test_segment_scoring_and_document(spark, tmp):
    df = spark.createDataFrame([(0, "m", "abcd", "ab"), (1, "m", "abcd", "a"), (2, "n", "ab", "abcd")],
                               "row_id long, model string, src string, tgt string")
    s = M.with_segment_ids(score_segments(df, "src", "tgt", LengthRatioScorer, batch_size=2))
    rows = {r.row_id: r for r in s.collect()}
    assert rows[0].score == 0.5 and rows[0].error_spans is None and rows[0].segment_id == 0
    assert rows[1].score == 0.25 and rows[1].error_spans[0].severity == "major" and rows[1].segment_id == 1
    assert rows[2].segment_id == 0
    doc = {r.model: r for r in M.score_document(s).collect()}
    assert doc["m"].n_segments == 2 and abs(doc["m"].system_score - 0.375) < 1e-12


def test_reference_based_scoring(spark):
    df = spark.createDataFrame([("ab", "ab", "ref")], "src string, tgt string, ref string")
    assert score_segments(df, "src", "tgt", LengthRatioScorer, ref_col="ref").first().score == 1.0


def test_judge_generation_and_encoder(spark):
    df = spark.createDataFrame([(1, "hello"), (2, None)], "i int, p string")
    g = {r.i: r.llm_response for r in generate_judgements(df, "p", StubJudge, batch_size=1).collect()}
    assert g == {1: "Feedback: stub [RESULT] 5", 2: None}
    e = encode_texts(df, "p", lambda: LetterEncoder(16)).collect()
    assert all(len(r.vec) == 16 for r in e)
    assert abs(float(np.linalg.norm(e[0].vec)) - 1.0) < 1e-5


def test_quality_head_fits(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0, 0.0, 3.0]) + 0.1
    df = spark.createDataFrame([(x[i].tolist(), float(y[i])) for i in range(200)], "f array<double>, label double")
    model = T.fit_quality_head(df, "f", "label")
    pred = T.predict_quality(model, df, "f").select(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert pred < 1e-6


def test_attach_checked(spark):
    from glossa.operators.rows import attach_checked
    import pytest
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, src string")
    res = spark.createDataFrame([(1, 0.5), (2, 0.7)], "row_id long, score double")
    assert attach_checked(rows, res, "row_id").count() == 2
    with pytest.raises(ValueError, match="1 rows without a result"):
        attach_checked(rows, res.where("row_id = 1"), "row_id")


def test_answer_pivot_and_cube(spark):
    df = spark.createDataFrame([(1, "a", "{'1': 'YES', '2': 'x'}"), (2, "b", "{'1': 'no'}")],
                               "row_id long, model string, response string")
    p = {r.model: (r.YES, r.NO, r.MAYBE, r.INVALID) for r in M.answer_pivot(M.answers_long(df)).collect()}
    assert p == {"a": (1, 0, 0, 1), "b": (0, 1, 0, 0)}
    d = spark.createDataFrame([("x", 1, 2.0), ("y", 1, 4.0)], "a string, b int, v double")
    cube = M.score_rollup(d, ["a", "b"], {"avg_v": F.avg("v")}, mode="cube").collect()
    assert len(cube) == 2 + 2 + 1 + 1


def test_answers_are_parsed_once(spark):
    """No second parse below the exchange, from a filter that Catalyst infers of the explode."""
    from glossa.operators.metrics import answers_long

    rows = spark.createDataFrame([(1, "m", "{'1': 'YES'}")], "row_id long, model string, response string").repartition(3)
    plan = answers_long(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert [tuple(r) for r in answers_long(rows).collect()] == [(1, "m", 1, "YES", "YES")]


def test_model_calls_get_bounded_batches(spark):
    """A session that this package did not build has Spark's own batch limits."""
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    df = spark.createDataFrame([(1, "a", "b")], "row_id long, src string, tgt string")
    try:
        for given, want in ((("10000", str(1 << 31)), ("2048", str(64 << 20))), (("100", "1000"), ("100", "1000"))):
            for n, v in zip(names, given):
                spark.conf.set(n, v)
            score_segments(df, "src", "tgt", LengthRatioScorer)
            assert tuple(spark.conf.get(n) for n in names) == want
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
