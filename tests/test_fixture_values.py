"""Expected values at sf0.01 (the fixtures' published checks)."""

from pyspark.sql import functions as F

from glossa.fixed_text import MODELS
from glossa.functions.text import judge_score
from glossa.operators import metrics as M
from glossa.operators import sweep as S
from glossa.plans.views import v_answers, v_judge, v_pairs, v_qa, v_trip

SF = "/root/testdata/sf0.01"


def test_judge_score_counts(spark):
    got = {r.s: r["count"] for r in v_judge(spark, SF).groupBy(judge_score("response").alias("s")).count().collect()}
    assert got == {None: 5000, 1: 2077, 2: 616, 3: 211, 4: 627, 5: 1469}


def test_triplet_metrics_values(spark):
    r = M.triplet_metrics(v_trip(spark, SF)).first()
    assert (round(r.loss, 6), round(r.distance_pos, 6), round(r.distance_neg, 6)) == (1.977932, 1.401216, 1.4128)
    assert r.n == 463


def test_distinct_request_keys(spark):
    keyed = S.with_request_key(S.expand_models(v_pairs(spark, SF), MODELS[:2]), "src")
    assert keyed.count() == 2000
    assert keyed.select("request_id").distinct().count() == 1854


def test_raw_answer_counts(spark):
    got = {r.raw: r["count"] for r in v_answers(spark, SF).groupBy("raw").count().collect()}
    assert got == {"YES": 90907, "yes": 22725, "NO": 68179, "MAYBE": 45460, "N/A": 22729}


def test_qa_score_summary(spark):
    s = M.with_qa_score(v_qa(spark, SF)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("score").alias("d"),
                                            F.count_if(F.col("score").isNull()).alias("nulls")).first()
    assert (s.n, s.d + 1, s.nulls) == (10000, 56, 140)
