"""End-to-end jobs on small CSV inputs: prompt build, sweep, judge, segment scoring."""

import json
import os

from glossa.fixed_text import QUESTIONS, SHUFFLE_SEED, TEMPLATE_BASELINE
from glossa.functions.permute import Permutation
from glossa.operators.rows import with_row_id
from glossa.operators.stubs import EchoClient, LengthRatioScorer, StubJudge, stub_answer
from glossa.plans import jobs
from glossa.sources.cache import ResponseCache
from glossa.sources.sinks import write_table


def pairs_csv(spark, tmp):
    rows = [("Der Hund bellt.", "The dog barks.", "de-en", "sys1", "set0"),
            ("Il pleut.", "It rains.", "fr-en", "sys2", "set1"),
            ("NA", "quoted \"text\"\nwith newline", "es-en", "sys1", "set0")]
    df = spark.createDataFrame(rows, "src string, tgt string, pair string, model string, dataset string")
    write_table(df.coalesce(1), f"{tmp}/pairs", fmt="csv")
    return f"{tmp}/pairs"


def test_with_row_id_dense(spark):
    df = spark.range(0, 1000, 3).repartition(5)
    ids = sorted(r.row_id for r in with_row_id(df).collect())
    assert ids == list(range(334))


def test_prompt_then_sweep(spark, tmp):
    path = pairs_csv(spark, tmp)
    out = jobs.prompt_job(spark, path, f"{tmp}/prompts", out_fmt="parquet")
    base = {r.src: r.QA for r in out.where("prompt_variant = 'baseline'").collect()}
    assert base[None] == TEMPLATE_BASELINE.format(source="nan", translation="quoted \"text\"\nwith newline",
                                                  questions=QUESTIONS)
    assert {"prompt_variant=baseline", "prompt_variant=stepwise"} <= set(os.listdir(f"{tmp}/prompts"))
    with open(f"{tmp}/models.txt", "w") as f:
        f.write("openai/gpt-4o-mini\nm2\n")
    swept = jobs.sweep_job(spark, f"{tmp}/prompts/prompt_variant=baseline", f"{tmp}/results",
                           f"{tmp}/cache", EchoClient, models=f"{tmp}/models.txt", fmt="parquet",
                           backoff_s=0.0, test_size=2)
    got = swept.collect()
    assert len(got) == 4 and all(r.response.startswith("Feedback: stub") or r.error for r in got)
    assert any(d.startswith("output_name=openai_gpt-4o-mini_prompt_variant")
               for d in os.listdir(f"{tmp}/results"))


def test_ids_stay_the_same_between_steps(spark, tmp):
    """A written step with several files keeps the ids its reader sees."""
    df = spark.createDataFrame([(f"s{i:04d}", f"t{i}", "a-b", "m", "d") for i in range(2000)],
                               "src string, tgt string, pair string, model string, dataset string")
    write_table(df.coalesce(1), f"{tmp}/in", fmt="csv")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = jobs.prompt_job(spark, f"{tmp}/in", f"{tmp}/p", out_fmt="parquet")
        want = {r.src: r.row_id for r in out.where("prompt_variant = 'baseline'").collect()}
        back = jobs.load(spark, f"{tmp}/p/prompt_variant=baseline", fmt="parquet")
        assert {r.src: r.row_id for r in back.collect()} == want
        assert want == {f"s{i:04d}": i for i in range(2000)}
        three = jobs.load(spark, f"{tmp}/p/prompt_variant=baseline", fmt="parquet", test_size=3)
        assert sorted(r.src for r in three.collect()) == ["s0000", "s0001", "s0002"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_judge_job(spark, tmp):
    df = spark.createDataFrame([("a source", "a translation"), ("b", "c")], "source string, tgt string")
    write_table(df.coalesce(1), f"{tmp}/judge_in", fmt="csv")
    report = {}
    out = jobs.judge_job(spark, f"{tmp}/judge_in", f"{tmp}/judge_out", StubJudge, report=report)
    rows = out.collect()
    assert all(r.llm_response.startswith("Feedback: stub [RESULT]") and 1 <= r.llm_score <= 5 for r in rows)
    back = spark.read.options(header="true", multiLine="true", escape='"').csv(f"{tmp}/judge_out")
    assert back.count() == 2 and "llm_score" in back.columns
    assert report == {"n": 2, "n_null": 0}


def test_segment_job(spark, tmp):
    path = pairs_csv(spark, tmp)
    segs = jobs.segment_job(spark, path, f"{tmp}/doc", LengthRatioScorer, model_info={"scorer": "length-ratio"})
    assert sorted(r.segment_id for r in segs.collect()) == [0, 1, 2]
    summary = [json.loads(line) for f in os.listdir(f"{tmp}/doc/summary") if f.endswith(".json")
               for line in open(f"{tmp}/doc/summary/{f}", encoding="utf-8")]
    assert len(summary) == 1 and summary[0]["n_segments"] == 3 and summary[0]["model_info"]["scorer"] == "length-ratio"


def test_with_row_id_sparse(spark):
    df = spark.range(0, 100).repartition(4)
    ids = [r.row_id for r in with_row_id(df, dense=False).collect()]
    assert len(set(ids)) == 100


def test_training_table_jobs(spark, tmp):
    df = spark.createDataFrame([(f"s{i}", f"t{i}", float(i % 3) if i != 7 else None) for i in range(30)],
                               "source string, target string, score double")
    write_table(df.coalesce(1), f"{tmp}/regr", fmt="csv")
    out = jobs.regression_tables_job(spark, f"{tmp}/regr", f"{tmp}/regr_out")
    assert out["train"].count() == 30 and out["eval"].count() == 6
    assert out["train"].where("not label_ok").count() == 1          # the missing score
    dbg = jobs.regression_tables_job(spark, f"{tmp}/regr", f"{tmp}/regr_dbg", debug=True)
    assert dbg["train"].count() == 10 and dbg["eval"].count() == 4
    assert dbg["train"].schema == out["train"].schema and dbg["train"].where("slot > 1").count() == 0
    # batches follow the seeded shuffle, tokens carry the label
    first = [r.row_id for r in out["train"].where("batch = 0").orderBy("slot").collect()]
    assert len(first) == 8 and first != list(range(8))
    assert out["train_tokens"].count() == 60 and out["train_tokens"].where("label = 1.0").count() == 18
    # the evaluation slice is shuffled too; in debug mode its rows are the first of the train shuffle
    evals = [r.row_id for r in out["eval"].orderBy("batch", "slot").collect()]
    assert sorted(evals) == list(range(6)) and evals == sorted(range(6), key=lambda i: Permutation(6, SHUFFLE_SEED).of([i])[0])
    order = [r.row_id for r in out["train"].orderBy("batch", "slot").collect()]
    assert order == Permutation(30, SHUFFLE_SEED).of(range(30), inverse=True).tolist()
    for name, n in (("train", 10), ("eval", 4)):
        assert [r.row_id for r in dbg[name].orderBy("batch", "slot").collect()] == order[:n]
    tri = spark.createDataFrame([(f"s{i}", f"p{i}", f"n{i}") for i in range(9)], "src string, pos string, neg string")
    write_table(tri.coalesce(1), f"{tmp}/rank", fmt="csv")
    long = jobs.ranking_tables_job(spark, f"{tmp}/rank", f"{tmp}/rank_out", max_length=4)
    assert long.count() == 9 * 4
    assert {r.role for r in long.collect()} == {"src", "ref", "pos", "neg"}
    r = long.where("role = 'ref' and text = 's0'").first()
    assert r.enc.tokens == ["s0", "<pad>", "<pad>", "<pad>"]


def test_sweep_of_both_variants_at_once(spark, tmp):
    """Every (row_id, prompt_variant) gets the answer to its own prompt."""
    path = pairs_csv(spark, tmp)
    prompts = jobs.prompt_job(spark, path, f"{tmp}/prompts", out_fmt="parquet").collect()
    report = {}
    swept = jobs.sweep_job(spark, f"{tmp}/prompts", f"{tmp}/results", f"{tmp}/cache", EchoClient, models=["m"],
                           fmt="parquet", backoff_s=0.0, report=report).collect()
    want = {(r.row_id, r.prompt_variant): stub_answer(r.QA) if len(r.QA.encode()) % 11 else None for r in prompts}
    assert len(prompts) == len(want) == len(swept) == 6
    assert {(r.row_id, r.prompt_variant): r.response for r in swept} == want
    assert ResponseCache(spark, f"{tmp}/cache").raw().count() == 6
    lost = sum(v is None for v in want.values())
    assert report == {"n": 6, "n_failed": lost, "n_no_response": lost}


def test_rows_without_a_usable_id_are_swept(spark, tmp):
    df = spark.createDataFrame([("a1", "one"), (None, "three"), ("7", "fourteen"), ("7", "twenty one")], "row_id string, QA string")
    df.coalesce(1).write.parquet(f"{tmp}/in")
    swept = jobs.sweep_job(spark, f"{tmp}/in", f"{tmp}/results", f"{tmp}/cache", EchoClient, models=["m"], fmt="parquet",
                           backoff_s=0.0).collect()
    assert sorted((r.row_id or "", r.response) for r in swept) == sorted(
        (i, stub_answer(t)) for i, t in [("a1", "one"), ("", "three"), ("7", "fourteen"), ("7", "twenty one")])
