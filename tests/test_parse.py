"""Judge-score and QA-answer parsing against Python semantics."""

from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.functions.answers import normalize_answer, parse_answers
from glossa.functions.text import judge_score

# Expected results of the judge rule (text after the last marker, strip, first
# token, int, clamp to 1..5, None on any failure).
CASES = [
    ("Feedback: fine [RESULT] 4", 4),
    ("[RESULT] 9", 5),
    ("[RESULT] -3", 1),
    ("[RESULT] +3", 3),
    ("[RESULT] 4.", None),
    ("[RESULT] (4)", None),
    ("[RESULT] 4/5", None),
    ("[RESULT] 3.0", None),
    ("[RESULT] 3 [RESULT] 2", 2),
    ("[RESULT]\n\n5\nx", 5),
    ("4 good", 4),
    ("", None),
    ("[RESULT]", None),
    ("Feedback: cut [RESULT]", None),
    (None, None),
    ("[RESULT] 12345678901234567890", 5),
    ("[RESULT] -12345678901234567890", 1),
    ("[RESULT]\t 0003 trailing", 3),
    ("no marker here", None),
    ("[RESULT]\xa04\u3000good", 4),
    ("[RESULT] 4\x1c5", 4),
]


def python_rule(text):
    """The rule in plain Python, for ASCII input."""
    if text is None:
        return None
    tail = text.split("[RESULT]")[-1].strip()
    if not tail:
        return None
    tok = tail.split()[0]
    body = tok[1:] if tok[:1] in "+-" else tok
    if not body or not body.isascii() or not body.isdigit():
        return None
    return min(max(int(tok), 1), 5)


def test_table_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, r string")
    got = {r.i: r.s for r in df.select("i", judge_score("r").alias("s")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, (text, got[i], want)
        assert python_rule(text) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("0123456789+- .\nab\xa0\u2003\x1c\x0b") + ["[RESULT]"]), max_size=12)
                .map("".join), min_size=1, max_size=30))
def test_matches_python_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, r string")
    got = {r.i: r.s for r in df.select("i", judge_score("r").alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == python_rule(t), t


ANSWERS = [
    ("single", "{'1': 'YES', '2': 'no', '3': 'MAYBE'}", {"1": "YES", "2": "no", "3": "MAYBE"}),
    ("double", '{"1": "YES", "2": "NO"}', {"1": "YES", "2": "NO"}),
    ("unquoted", "{1: 'YES', 2: 'NO'}", {"1": "YES", "2": "NO"}),
    ("fenced", "```json\n{'1': 'YES'}\n```", {"1": "YES"}),
    ("prose", "Here you go: {'1': 'MAYBE'} hope it helps", {"1": "MAYBE"}),
    ("trailing_comma", "{'1': 'YES',}", None),
    ("none", "I cannot answer.", None),
    ("null", None, None),
]


def test_answer_json(spark):
    df = spark.createDataFrame([(k, t) for k, t, _ in ANSWERS], "k string, t string")
    got = {r.k: r.m for r in df.select("k", parse_answers("t").alias("m")).collect()}
    for k, _, want in ANSWERS:
        assert (dict(got[k]) if got[k] is not None else None) == want, k


def test_normalize_answer(spark):
    df = spark.createDataFrame([(" yes ",), ("MAYBE",), ("N/A",), (None,), ("No",)], "v string")
    assert [r.a for r in df.select(normalize_answer("v").alias("a")).collect()] == ["YES", "MAYBE", None, None, "NO"]
