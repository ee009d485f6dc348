"""QA answer parsing: response text -> map of question number -> YES / NO / MAYBE.

The answer contract is a JSON object whose example uses single quotes. The
parser takes the outermost ``{...}`` (so code fences and surrounding prose are
ignored) and reads it as ``map<string,string>`` with single quotes and unquoted
keys allowed. Malformed JSON (e.g. a trailing comma) gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: valid answers and their numeric value in the QA score -------------
ANSWER_VALUES = {"YES": 1.0, "MAYBE": 0.5, "NO": 0.0}

JSON_OPTIONS = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "mode": "PERMISSIVE"}


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def parse_answers(text: Column | str) -> Column:
    body = F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(body != "", body), "map<string,string>", JSON_OPTIONS)


def normalize_answer(raw: Column | str) -> Column:
    """Upper-cased, trimmed answer when it is a valid one; null otherwise."""
    v = F.upper(F.trim(_c(raw)))
    return F.when(v.isin(list(ANSWER_VALUES)), v)


def answer_value(answer: Column) -> Column:
    """Numeric value of a normalised answer (null for anything else)."""
    m = F.create_map(*[x for k, v in ANSWER_VALUES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, answer)


def question_weights(weights: dict | None = None, questions: int = 25) -> dict[str, float]:
    return {str(k): float(v) for k, v in (weights or {i: 1.0 for i in range(1, questions + 1)}).items()}
