"""Prompt construction as Catalyst expressions.

A template is parsed once on the driver with ``string.Formatter`` (the same
grammar as ``str.format``: ``{slot}`` fields, ``{{``/``}}`` escapes). Rendering
is then a single ``concat`` of literal segments and columns, so values that
happen to contain ``{translation}`` are never re-scanned (chained ``replace``
would corrupt them) and the template text is a constant folded into the plan.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.fixed_text import JUDGE_RUBRIC, JUDGE_SYSTEM, JUDGE_TASK
from glossa.functions.text import as_python_text

Slot = Column | str


def strip_fence(template: str, fence: str = "'''") -> str:
    """Drop a fence line at the start and at the end of a template file.

    The template files begin and end with a literal fence line that is sent to
    the model as is; rendering keeps the text verbatim unless this is applied.
    """
    lines = template.split("\n")
    if lines and lines[0].strip() == fence:
        lines = lines[1:]
    if lines and lines[-1].strip() == fence:
        lines = lines[:-1]
    return "\n".join(lines)


def parse_template(template: str) -> list[tuple[str, str | None]]:
    """``[(literal, field_or_None), ...]`` exactly as ``str.format`` reads the template."""
    out = []
    for literal, field, spec, conv in Formatter().parse(template):
        if spec or conv:
            raise ValueError(f"format spec / conversion not supported in slot {field!r}")
        out.append((literal, field))
    return out


def template_expr(template: str, slots: dict[str, Slot], on_null: str = "nan") -> Column:
    """One ``concat`` for the rendered text.

    ``slots`` maps each field to a Column or to literal text (a question bank,
    a rubric). ``on_null='nan'`` renders a missing value as ``nan`` the way
    ``str.format`` prints a missing pandas cell; ``'null'`` makes the prompt null.
    """
    parts: list[Column | str] = []

    def add(p):
        if isinstance(p, str) and parts and isinstance(parts[-1], str):
            parts[-1] += p
        elif not (isinstance(p, str) and p == ""):
            parts.append(p)

    for literal, field in parse_template(template):
        add(literal)
        if field is None:
            continue
        if field not in slots:
            raise KeyError(f"template slot {field!r} has no value")
        v = slots[field]
        if isinstance(v, str):
            add(v)
        else:
            add(as_python_text(v) if on_null == "nan" else v.cast("string"))
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    if not cols:
        return F.lit("")
    return cols[0] if len(cols) == 1 else F.concat(*cols)


def render_prompt(df: DataFrame, template: str, slots: dict[str, Slot], out: str = "prompt",
                  on_null: str = "nan") -> DataFrame:
    return df.withColumn(out, template_expr(template, slots, on_null))


def render_variants(df: DataFrame, templates: dict[str, str], slots: dict[str, Slot],
                    variant_col: str = "prompt_variant", out: str = "prompt",
                    on_null: str = "nan") -> DataFrame:
    """Stack several templates as rows (UNION ALL semantics) in one scan.

    Each row carries one struct per variant and is inlined: a narrow operator,
    not a union of two scans of the input.
    """
    variants = F.array(*[F.struct(F.lit(name).alias(variant_col),
                                  template_expr(t, slots, on_null).alias(out))
                         for name, t in templates.items()])
    return df.select("*", F.inline(variants))


def rubric_text(rubric: dict[str, str]) -> str:
    """The rubric as the judge sees it: the Python ``str`` of the dict (rendered once, on the driver)."""
    return str(rubric)


def judge_content(source: Column, target: Column, system: str = JUDGE_SYSTEM, task: str = JUDGE_TASK,
                  rubric: dict[str, str] = JUDGE_RUBRIC, on_null: str = "nan") -> Column:
    """System text, a blank line, then the task with instruction / response / rubric filled in."""
    return template_expr(_judge_template(system, task),
                         {"instruction": source, "response": target, "rubric": rubric_text(rubric)},
                         on_null)


def _judge_template(system: str, task: str) -> str:
    # The system text is prepended verbatim (it is not a template); escape its braces.
    return system.replace("{", "{{").replace("}", "}}") + "\n\n" + task


def as_messages(content: Column, role: str = "user") -> Column:
    """A one-message chat: ``[{role, content}]``."""
    return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))


# A chat-template layout: per-role prefix and suffix, and the text that opens
# the assistant turn. The caller names the layout of the serving model.
CHATML = {
    "roles": {"system": ("<|im_start|>system\n", "<|im_end|>\n"),
              "user": ("<|im_start|>user\n", "<|im_end|>\n"),
              "assistant": ("<|im_start|>assistant\n", "<|im_end|>\n")},
    "generation": "<|im_start|>assistant\n",
}


def flatten_chat(messages: Column, layout: dict = CHATML, add_generation_prompt: bool = True) -> Column:
    """Message array to the single prompt string a completion model reads."""
    pre = F.create_map(*[x for r, (p, _) in layout["roles"].items() for x in (F.lit(r), F.lit(p))])
    suf = F.create_map(*[x for r, (_, s) in layout["roles"].items() for x in (F.lit(r), F.lit(s))])
    body = F.array_join(F.transform(messages, lambda m: F.concat(
        F.coalesce(F.element_at(pre, m["role"]), F.lit("")), m["content"],
        F.coalesce(F.element_at(suf, m["role"]), F.lit("")))), "")
    return F.concat(body, F.lit(layout["generation"])) if add_generation_prompt else body


def question_rows(bank: DataFrame, text_col: str = "value") -> DataFrame:
    """Question bank text to ``(qid, question)`` rows.

    A new question starts at a line beginning with ``<number>.``; a line without
    a number continues the previous question. Trailing spaces are dropped.
    """
    parts = F.explode(F.split(F.col(text_col), r"\n(?=[0-9]+\.)"))
    x = bank.select(parts.alias("_q"))
    m = r"(?s)^([0-9]+)\.\s*(.*)$"
    return x.select(F.regexp_extract("_q", m, 1).cast("int").alias("qid"),
                    F.regexp_replace(F.regexp_extract("_q", m, 2), r"[ \t\r\n]+$", "").alias("question"))
