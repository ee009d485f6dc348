"""Prompt rendering against Python's str.format, question banks, judge prompts."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossa.fixed_text import (JUDGE_RUBRIC, JUDGE_SYSTEM, JUDGE_TASK, QUESTIONS, QUESTIONS_STEPWISE,
                               TEMPLATE_BASELINE, TEMPLATE_STEPWISE)
from glossa.operators import prompts as P


def render(spark, template, rows, on_null="nan"):
    df = spark.createDataFrame(rows, "i int, src string, tgt string")
    out = P.render_prompt(df, template, {"source": F.col("src"), "translation": F.col("tgt"),
                                         "questions": QUESTIONS}, on_null=on_null)
    return {r.i: r.prompt for r in out.collect()}


def test_baseline_matches_str_format(spark):
    rows = [(0, "Der Hund.", "The dog."), (1, "x {translation} y", "{source} and {{braces}}"),
            (2, "multi\nline 'quoted' \"text\"", "ünïcödé 下雨")]
    got = render(spark, TEMPLATE_BASELINE, rows)
    for i, s, t in rows:
        assert got[i] == TEMPLATE_BASELINE.format(source=s, translation=t, questions=QUESTIONS)


def test_stepwise_and_null_source(spark):
    got = render(spark, TEMPLATE_STEPWISE, [(0, None, "t")])
    assert got[0] == TEMPLATE_STEPWISE.format(source="nan", translation="t", questions=QUESTIONS)
    got = render(spark, TEMPLATE_STEPWISE, [(0, None, "t")], on_null="null")
    assert got[0] is None


def test_doubled_braces_become_single():
    segs = P.parse_template("a {{x}} {source} }}")
    assert "".join(lit for lit, _ in segs) == "a {x}  }"
    assert [f for _, f in segs if f] == ["source"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=30), st.text(max_size=30)), min_size=1, max_size=10))
def test_property_str_format(spark, pairs):
    rows = [(i, s, t) for i, (s, t) in enumerate(pairs)]
    got = render(spark, TEMPLATE_BASELINE, rows)
    for i, s, t in rows:
        assert got[i] == TEMPLATE_BASELINE.format(source=s, translation=t, questions=QUESTIONS)


def test_variants_stack_one_scan(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "i int, src string, tgt string")
    out = P.render_variants(df, {"baseline": TEMPLATE_BASELINE, "stepwise": TEMPLATE_STEPWISE},
                            {"source": F.col("src"), "translation": F.col("tgt"), "questions": QUESTIONS})
    assert out.count() == 4
    assert {r.prompt_variant for r in out.collect()} == {"baseline", "stepwise"}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def python_questions(text):
    out = []
    for part in re.split(r"\n(?=[0-9]+\.)", text):
        m = re.match(r"^([0-9]+)\.\s*(.*)$", part, re.S)
        out.append((int(m.group(1)), m.group(2).rstrip()))
    return out


def test_question_banks(spark, tmp):
    for text in (QUESTIONS, QUESTIONS_STEPWISE):
        path = f"{tmp}/bank-{len(text)}.txt"
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        from glossa.sources.tables import read_wholetext
        rows = P.question_rows(read_wholetext(spark, path)).orderBy("qid").collect()
        assert [(r.qid, r.question) for r in rows] == python_questions(text)
        assert [r.qid for r in rows] == list(range(1, 26))
    # a line without a number continues the previous question
    q2 = [q for i, q in python_questions(QUESTIONS_STEPWISE) if i == 2][0]
    assert "\nExample:" in q2


def test_judge_content_and_messages(spark):
    df = spark.createDataFrame([("source text", "translated text")], "s string, t string")
    content = P.judge_content(F.col("s"), F.col("t"))
    row = df.select(P.as_messages(content).alias("m"), P.flatten_chat(P.as_messages(content)).alias("flat")).first()
    want = JUDGE_SYSTEM + "\n\n" + JUDGE_TASK.format(instruction="source text", response="translated text",
                                                     rubric=JUDGE_RUBRIC)
    assert row.m[0].role == "user" and row.m[0].content == want
    assert row.flat == "<|im_start|>user\n" + want + "<|im_end|>\n<|im_start|>assistant\n"


def test_strip_fence():
    t = P.strip_fence(TEMPLATE_BASELINE)
    assert not t.startswith("'''") and not t.rstrip().endswith("'''")
    assert t == TEMPLATE_BASELINE[len("'''\n"):-len("\n'''")]
    assert P.strip_fence("no fence {source}") == "no fence {source}"
