"""DuckDB SQL for each registered query (the correctness oracle).

Written independently of the Spark code: the prompt texts are rendered with
Python's own ``str.format`` around placeholder markers and turned into SQL
string literals, the question bank is split with Python's ``re`` into VALUES,
and every view is the SQL of the fixtures. DuckDB's ``concat`` skips nulls where
Spark's returns null, so text slots are coalesced explicitly on both sides.
"""

from __future__ import annotations

import re

from glossa.fixed_text import (DEBUG_EVAL_ROWS, DEBUG_SAMPLES, DEBUG_TRAIN_ROWS, DEFAULT_RANKING_SAMPLES,
                               JUDGE_RUBRIC, JUDGE_SYSTEM, JUDGE_TASK, MODELS, QUESTIONS, RUN_CONFIGS, SHUFFLE_SEED,
                               TEMPLATE_BASELINE, TEMPLATE_STEPWISE)
from glossa.functions.permute import PRIME, round_keys
from glossa.functions.text import PANDAS_NA_VALUES, python_whitespace_class

PAD_LENGTH = 512
BATCH_SIZE = 8


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def render_sql(text_with_marks: str, exprs: list[str]) -> str:
    parts = re.split("\x00([0-9]+)\x00", text_with_marks)
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                out.append(lit(p))
        else:
            out.append(exprs[int(p)])
    return "concat(" + ", ".join(out) + ")"


def mark(i: int) -> str:
    return f"\x00{i}\x00"


def prompt_sql(template: str, src: str, tgt: str) -> str:
    text = template.format(source=mark(0), translation=mark(1), questions=QUESTIONS)
    return render_sql(text, [f"coalesce({src}, 'nan')", f"coalesce({tgt}, 'nan')"])


def judge_sql(src: str, tgt: str) -> str:
    text = JUDGE_SYSTEM + "\n\n" + JUDGE_TASK.format(instruction=mark(0), response=mark(1), rubric=str(JUDGE_RUBRIC))
    return render_sql(text, [f"coalesce({src}, 'nan')", f"coalesce({tgt}, 'nan')"])


def flat_sql(content: str) -> str:
    return f"concat('<|im_start|>user' || chr(10), {content}, '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10))"


def score_sql(r: str) -> str:
    """Judge score: token after the last marker (Python whitespace), ASCII integer, clamped, null-safe."""
    ws = python_whitespace_class()
    tok = f"regexp_extract(string_split({r}, '[RESULT]')[-1], '^[{ws}]*([^{ws}]+)', 1)"
    num = f"case when regexp_full_match({tok}, '[+-]?[0-9]+') then try_cast({tok} as double) end"
    return f"cast(case when ({num}) is not null then least(5.0, greatest(1.0, {num})) end as integer)"


V_PAIRS = """v_pairs as (
  select d.doc_id as row_id, d.text as src, b.text as tgt, concat(d.lang, '-en') as pair, d.source as model,
         concat('set', cast(d.doc_id % 3 as varchar)) as dataset
  from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark))"""

V_JUDGE = """v_judge as (
  select event_id as row_id, event_type as model,
   case event_id % 8
    when 0 then concat('Feedback: ok [RESULT] ', cast(cast(floor(value) as bigint) as varchar))
    when 1 then concat('[RESULT] 2 then [RESULT] ', cast(event_id % 7 as varchar))
    when 2 then concat('Feedback: x [RESULT] ', cast(event_id % 6 as varchar), '.')
    when 3 then 'no marker here'
    when 4 then concat(cast(event_id % 6 as varchar), ' leading number')
    when 5 then concat('[RESULT] -', cast(event_id % 6 as varchar))
    when 6 then 'Feedback: cut [RESULT]' else null end as response
  from events)"""

V_TRIP = """r as (select vec_id, label, embedding, row_number() over (partition by label order by vec_id) as k from embeddings),
v_trip as (
  select a.vec_id as row_id, a.embedding as src, rf.embedding as ref, p.embedding as pos, n.embedding as neg
  from r a join r rf on rf.label = a.label and rf.k = a.k + 1
           join r p  on p.label  = a.label and p.k  = a.k + 2
           join r n  on n.label  = (a.label + 1) % 10 and n.k = a.k)"""

V_TURNS = """v_turns as (
  select u.conv_id, u.turn, u.text as src, a.text as tgt
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant')"""

V_QE = """v_qe as (
  select d.doc_id as row_id, d.text as source, b.text as target, l.quality as score
  from documents d join labels l on l.doc_id = d.doc_id
       join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark))"""

V_ANSWERS = """v_answers as (
  select event_id as row_id, event_type as model, qid,
         case when r < 4 then 'YES' when r < 7 then 'NO' when r < 9 then 'MAYBE' when r = 9 then 'yes' else 'N/A' end as raw
  from (select event_id, event_type, qid, (event_id + qid*qid*(event_id % 13)) % 11 as r
        from events cross join range(1, 26) t(qid)))"""

MODELS_SQL = "(values " + ", ".join(f"({lit(m)})" for m in MODELS) + ") m(chat_model)"

KEYED = f"""prompts as (select row_id, pair, {prompt_sql(TEMPLATE_BASELINE, 'src', 'tgt')} as content from v_pairs),
keyed as (select p.row_id, p.pair, p.content, m.chat_model,
                 sha256(concat_ws(chr(1), m.chat_model, p.content, '0.3', 'true')) as request_id
          from prompts p cross join {MODELS_SQL}),
cached as (select distinct request_id from keyed where pair = 'en-en' and strlen(content) % 11 <> 0)"""


def l2(a: str, b: str) -> str:
    return (f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: pow(cast({a}[i] as double) - cast({b}[i] as double) + 1e-6, 2))))")


def _questions_values() -> str:
    rows = []
    for part in re.split(r"\n(?=[0-9]+\.)", QUESTIONS):
        m = re.match(r"^([0-9]+)\.\s*(.*)$", part, re.S)
        rows.append(f"({int(m.group(1))}, {lit(m.group(2).rstrip(' ' + chr(9) + chr(13) + chr(10)))})")
    return "(values " + ", ".join(rows) + ") q(qid, question)"


def _norm(raw: str) -> str:
    return f"case when upper(trim({raw})) in ('YES', 'NO', 'MAYBE') then upper(trim({raw})) end"


def _configs_values() -> str:
    rows = ", ".join(f"({lit(n)}, {lit(k)}, {b}, {e}, {('NULL' if t is None else t)})"
                     for n, k, b, e, _ml, _ga, t in RUN_CONFIGS)
    return f"(values {rows}) c(config, kind, batch_size, epochs, total)"


def _tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')"


def _split(frac: float) -> str:
    """Side of the disjoint split: the first 15 hex digits against the share of 2^60."""
    cut = int(frac * (1 << 60))
    if cut >= 1 << 60:
        return "'eval'"
    return f"case when substr(sha256(cast(doc_id as varchar)), 1, 15) < '{cut:015x}' then 'eval' else 'train' end"


def _letters(text: str, n: int = 16) -> str:
    counts = ", ".join(f"cast(length({text}) - length(replace({text}, '{chr(97 + i)}', '')) as double)" for i in range(n))
    return f"[{counts}]"


NA_LIST = ", ".join(lit(v) for v in PANDAS_NA_VALUES)

def _feistel(source: str) -> str:
    """The rounds of the seeded permutation over ``source`` (doc_id, step, n, a, b, l, r)."""
    for k, (m, c) in enumerate(round_keys(SHUFFLE_SEED)):
        v = "l" if k % 2 else "r"
        q = f"(({v} * {m} + {c}) % {PRIME})"
        f = f"(({q} * {q} + {v}) % {PRIME})"
        left, right = ("l", f"(r + {f}) % b") if k % 2 else (f"(l + {f}) % a", "r")
        source = f"select doc_id, step, n, a, b, {left} as l, {right} as r from ({source})"
    return source


ORACLE = {
    "scan_head": f"""
select doc_id as row_id, case when text in ({NA_LIST}) then null else text end as src, concat(lang, '-en') as pair
from documents order by doc_id limit 100""",

    "csv_roundtrip": f"""with {V_PAIRS}
select row_id, sha256(src) as src_sha, sha256(tgt) as tgt_sha, cast(length(src) as integer) as src_len,
       sha256(case row_id % 5 when 0 then '  ' || tgt when 1 then tgt || ' ' || chr(10) || chr(9)
              when 2 then ' ' || chr(9) || ' ' end) as edge_sha, 0 as malformed
from v_pairs""",

    "model_slug": r"""
select page_id, replace(url, '/', '_') as slug,
       string_split(regexp_replace(url, '/+$', ''), '/')[-1] as base,
       regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '(.)\.[^./]*$', '\1') as stem,
       cast(ends_with(url, '#top') as integer) as is_top
from pages""",

    "render_baseline": f"""with {V_PAIRS}, x as (select row_id, {prompt_sql(TEMPLATE_BASELINE, 'src', 'tgt')} as prompt from v_pairs)
select row_id, sha256(prompt) as prompt_sha, cast(length(prompt) as integer) as prompt_len from x""",

    "render_variants": f"""with {V_PAIRS},
x as (select row_id, 'baseline' as prompt_variant, {prompt_sql(TEMPLATE_BASELINE, 'src', 'tgt')} as prompt from v_pairs
      union all
      select row_id, 'stepwise' as prompt_variant, {prompt_sql(TEMPLATE_STEPWISE, 'src', 'tgt')} as prompt from v_pairs)
select row_id, prompt_variant, cast(length(prompt) as integer) as prompt_len, sha256(prompt) as prompt_sha from x""",

    "render_judge": f"""with {V_TURNS}, x as (select conv_id, turn, {judge_sql('src', 'tgt')} as content from v_turns)
select conv_id, turn, 'user' as role, sha256(content) as content_sha, sha256({flat_sql('content')}) as flat_sha from x""",

    "question_table": f"""with {V_ANSWERS},
c as (select qid, count({_norm('raw')}) as n_valid, count(*) as n_answers from v_answers group by qid)
select q.qid, q.question, c.n_valid, c.n_answers from {_questions_values()} left join c on c.qid = q.qid""",

    "sweep_expand": f"""with {V_PAIRS}, {KEYED}
select chat_model, count(*) as n_rows, count(distinct request_id) as n_keys from keyed group by chat_model""",

    "sweep_dedupe": f"""with {V_PAIRS}, {KEYED}
select request_id, chat_model, count(*) as n_rows from keyed group by request_id, chat_model""",

    "sweep_variants": f"""with {V_PAIRS},
p as (select 'baseline' as prompt_variant, {prompt_sql(TEMPLATE_BASELINE, 'src', 'tgt')} as content from v_pairs
      union all
      select 'stepwise' as prompt_variant, {prompt_sql(TEMPLATE_STEPWISE, 'src', 'tgt')} as content from v_pairs)
select prompt_variant, m.chat_model, replace(m.chat_model, '/', '_') || '_pairs.csv' as output_name,
       count(*) as n_rows, count(distinct content) as n_keys
from p cross join {MODELS_SQL} group by all""",

    "failed_requests": f"""with {V_PAIRS}, {KEYED}
select row_id, chat_model, 'RuntimeError: stub failure' as error, 5 as attempts from keyed where strlen(content) % 11 = 0""",

    "sweep_report": f"""with {V_PAIRS}, {KEYED},
y as (select chat_model, strlen(content) % 11 = 0 as bad from keyed)
select chat_model, count(*) as n, count(*) filter (where bad) as n_null,
       round(count(*) filter (where bad) / count(*), 6) as null_rate, count(*) filter (where bad) as n_failed
from y group by chat_model""",

    "cache_misses": f"""with {V_PAIRS}, {KEYED}
select distinct request_id, chat_model from keyed where request_id not in (select request_id from cached)""",

    "cache_report": f"""with {V_PAIRS}, {KEYED},
k as (select distinct chat_model, request_id from keyed)
select chat_model, count(*) as n_keys,
       count(*) filter (where request_id in (select request_id from cached)) as hits,
       count(*) filter (where request_id not in (select request_id from cached)) as misses
from k group by chat_model""",

    "score_stub": f"""with {V_PAIRS}, {KEYED},
x as (select row_id, chat_model, strlen(content) as nb from keyed),
y as (select row_id, chat_model,
             case when nb % 11 = 0 then null else concat('Feedback: stub [RESULT] ', cast(nb % 7 as varchar)) end as response,
             case when nb % 11 = 0 then 'RuntimeError: stub failure' end as error,
             case when nb % 11 = 0 then 5 else 1 end as attempts
      from x)
select row_id, chat_model, response, {score_sql('response')} as score, error, attempts from y""",

    "response_extract": "select event_id as row_id, props as content from events",

    "judge_generate": f"""with {V_TURNS},
x as (select conv_id, turn, {flat_sql(judge_sql('src', 'tgt'))} as prompt from v_turns),
y as (select conv_id, turn, concat('Feedback: stub [RESULT] ', cast(strlen(prompt) % 7 as varchar)) as llm_response from x)
select conv_id, turn, llm_response, {score_sql('llm_response')} as llm_score from y""",

    "judge_score": f"""with {V_JUDGE}
select row_id, {score_sql('response')} as score from v_judge""",

    "parse_report": f"""with {V_JUDGE}, x as (select model, {score_sql('response')} as score from v_judge)
select model, count(*) as n, count(*) filter (where score is null) as n_null,
       round(count(*) filter (where score is null) / count(*), 6) as null_rate
from x group by model""",

    "segment_scores": f"""with {V_PAIRS},
x as (select row_id, model, strlen(src) as a, strlen(tgt) as b from v_pairs)
select row_id, model, row_number() over (partition by model order by row_id) - 1 as segment_id,
       round(case when greatest(a, b) = 0 then 0.0 else least(a, b) / greatest(a, b) end, 6) as score,
       cast(2 * b < a as integer) as has_spans
from x""",

    "system_score": f"""with {V_JUDGE}, x as (select model, {score_sql('response')} as score from v_judge)
select model, round(avg(score), 6) as system_score, count(score) as n_scored, count(*) as n from x group by model""",

    "score_document": f"""with {V_PAIRS},
x as (select model, strlen(src) as a, strlen(tgt) as b from v_pairs)
select model, round(avg(case when greatest(a, b) = 0 then 0.0 else least(a, b) / greatest(a, b) end), 6) as system_score,
       count(*) as n_segments, count(*) filter (where 2 * b < a) as n_with_spans
from x group by model""",

    "segments_table": f"""with {V_PAIRS},
x as (select *, strlen(src) as a, strlen(tgt) as b from v_pairs)
select model, row_number() over (partition by model order by row_id) - 1 as segment_id, row_id,
       sha256(src) as source_sha, sha256(tgt) as translation_sha,
       round(case when greatest(a, b) = 0 then 0.0 else least(a, b) / greatest(a, b) end, 6) as score,
       cast(case when 2 * b < a then b end as integer) as span_end, case when 2 * b < a then 'major' end as severity,
       'length' as scorer
from x""",

    "reference_scores": f"""with {V_PAIRS},
x as (select row_id, model, strlen(src) as a, strlen(tgt) as b from v_pairs)
select row_id, model, round(case when greatest(a, b) = 0 then 0.0 else least(a, b) / greatest(a, b) end, 6) as score
from x""",

    "qa_score_weighted": f"""with {V_ANSWERS},
x as (select row_id, model, case {_norm('raw')} when 'YES' then 1.0 when 'MAYBE' then 0.5 when 'NO' then 0.0 end as v,
             case when qid % 2 = 1 then 0.5 else 2.0 end as w
      from v_answers where qid <= 20)
select row_id, model, round(cast(sum(v * w) as double) / cast(sum(w) filter (where v is not null) as double), 6) as score
from x group by row_id, model""",

    "answer_pivot": f"""with {V_ANSWERS}, x as (select model, {_norm('raw')} as answer from v_answers)
select model, count(*) filter (where answer = 'YES') as n_yes, count(*) filter (where answer = 'NO') as n_no,
       count(*) filter (where answer = 'MAYBE') as n_maybe, count(*) filter (where answer is null) as n_invalid
from x group by model""",

    "judged_rollup": f"""with {V_PAIRS},
x as (select model, pair, dataset, case when row_id % 7 < 5 then row_id % 7 + 1 end as score from v_pairs)
select model, pair, dataset, grouping(model, pair, dataset) as gid, count(*) as n, round(avg(score), 6) as system_score,
       round(count(*) filter (where score is null) / count(*), 6) as null_rate
from x group by rollup (model, pair, dataset)""",

    "answers_long": f"""with {V_ANSWERS}, x as (select cast(qid as integer) as qid, model, {_norm('raw')} as answer from v_answers)
select qid, model, count(*) filter (where answer = 'YES') as yes, count(*) filter (where answer = 'NO') as no,
       count(*) filter (where answer = 'MAYBE') as maybe, count(*) filter (where answer is null) as invalid
from x group by qid, model""",

    "qa_score": f"""with {V_ANSWERS},
x as (select row_id, model, case {_norm('raw')} when 'YES' then 1.0 when 'MAYBE' then 0.5 when 'NO' then 0.0 end as v
      from v_answers)
select row_id, model, round(avg(v), 6) as score from x group by row_id, model""",

    "score_rollup": """
select d.lang, l.quality, grouping(d.lang, l.quality) as gid, count(*) as n,
       round(avg(d.n_chars), 6) as avg_chars, round(avg(l.toxic), 6) as toxic_rate
from documents d join labels l on l.doc_id = d.doc_id
group by rollup (d.lang, l.quality)""",

    "prepare_triplets": f"""with {V_TURNS},
x as (select t.conv_id, t.turn, t.src, t.tgt as pos, c.text as neg
      from v_turns t left join conversations c
        on c.conv_id = t.conv_id and c.turn = t.turn + 3 and c.role = 'assistant')
select conv_id, turn, sha256(coalesce(src, 'None')) as src_sha, sha256(coalesce(src, 'None')) as ref_sha,
       sha256(coalesce(pos, 'None')) as pos_sha, sha256(coalesce(neg, 'None')) as neg_sha,
       cast(coalesce(neg, 'None') = 'None' as integer) as neg_missing
from x""",

    "prepare_regression": f"""with {V_QE}
select row_id, sha256(coalesce(source, 'None')) as src_sha, sha256(coalesce(target, 'None')) as mt_sha,
       try_cast(coalesce(cast(score as varchar), 'None') as double) as label,
       cast(try_cast(coalesce(cast(score as varchar), 'None') as double) is not null as integer) as label_ok
from v_qe""",

    "roles_roundtrip": f"""with {V_QE},
x as (select row_number() over (order by row_id) - 1 as p, source, target from v_qe)
select cast(p // {BATCH_SIZE} as bigint) as batch, cast(p % {BATCH_SIZE} as integer) as slot,
       sha256(coalesce(source, 'None')) as src_sha, sha256(coalesce(target, 'None')) as mt_sha
from x""",

    "assign_batches": f"""
with x as (select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as p from documents)
select doc_id, lang, cast(p // {BATCH_SIZE} as bigint) as batch, cast(p % {BATCH_SIZE} as integer) as slot from x""",

    "shuffled_batches": f"""
with x as (select doc_id, row_number() over (order by substr(sha256(concat('42:', cast(doc_id as varchar))), 1, 15), doc_id) - 1 as p
           from documents)
select doc_id, cast(p as bigint) as shuffle_pos, cast(p // {BATCH_SIZE} as bigint) as batch,
       cast(p % {BATCH_SIZE} as integer) as slot from x""",

    "regression_layout": f"""with {V_QE},
x as (select row_number() over (order by substr(sha256(concat('42:', cast(row_id as varchar))), 1, 15), row_id) - 1 as p,
             source, target, cast(score as double) as label from v_qe),
l as (select p, 'src' as role, source as text, label from x union all select p, 'mt', target, label from x),
c as (select p, role, label, {_tokens('text')}[1:{PAD_LENGTH}] as cut from l)
select cast(p // {BATCH_SIZE} as bigint) as batch, cast(p % {BATCH_SIZE} as integer) as slot, role, label,
       cast(len(cut) as integer) as n_tokens,
       sha256(array_to_string(list_concat(cut, list_transform(range({PAD_LENGTH} - len(cut)), lambda x: '<pad>')), chr(1))) as tokens_sha
from c""",

    "stack_embeddings": f"""with {V_TRIP},
x as (select row_number() over (order by row_id) - 1 as p, src, ref, pos, neg from v_trip),
l as (select p, 0 as role_pos, 'src' as role, src as e from x union all select p, 1, 'ref', ref from x
      union all select p, 2, 'pos', pos from x union all select p, 3, 'neg', neg from x)
select cast(p // {BATCH_SIZE} as bigint) as batch, cast(p % {BATCH_SIZE} as integer) as slot, cast(role_pos as integer) as role_pos,
       role, cast(len(e) as integer) as dim, round(list_sum(list_transform(e, lambda v: cast(v as double))), 4) as total
from l""",

    "permuted_batches": f"""
with recursive d as (select doc_id, row_number() over (order by doc_id) - 1 as id from documents),
dims as (select n, a, greatest(1, cast(ceil(n / a) as bigint)) as b
         from (select n, greatest(1, cast(ceil(sqrt(n)) as bigint)) as a from (select count(*) as n from documents))),
walk(doc_id, step, v) as (
  select doc_id, 0, cast(id as bigint) from d
  union all
  select doc_id, step + 1, l * b + r from ({_feistel("select doc_id, step, n, a, b, v // b as l, v % b as r from walk, dims where step = 0 or v >= n")})),
p as (select doc_id, v as p from walk, dims where step > 0 and v < n)
select doc_id, p as shuffle_pos, p // {BATCH_SIZE} as batch, cast(p % {BATCH_SIZE} as integer) as slot from p""",
    "vocab_ids": f"""
with w as (select distinct unnest({_tokens('text')}) as token from benchmark),
v as (select token, row_number() over (order by token) + 1 as id from w),
t as (select doc_id, {_tokens('text')}[1:{PAD_LENGTH}] as cut from documents),
u as (select doc_id, unnest(cut) as token from t),
s as (select u.doc_id, count(*) as n, count(*) filter (where v.id is null) as n_unknown, sum(coalesce(v.id, 1)) as id_sum
      from u left join v on v.token = u.token group by u.doc_id)
select t.doc_id, {PAD_LENGTH} as length, cast(coalesce(s.n_unknown, 0) as integer) as n_unknown,
       cast({PAD_LENGTH} - coalesce(s.n, 0) as integer) as n_pad, cast(coalesce(s.id_sum, 0) as bigint) as id_sum
from t left join s on s.doc_id = t.doc_id""",

    "step_budget": f"""with {V_QE}, f as (select count(*) as n_file from v_qe),
x as (select c.config, case when c.kind = 'ranking' then coalesce(c.total, {DEFAULT_RANKING_SAMPLES})
                            when c.kind = 'regression_debug' then {DEBUG_SAMPLES}
                            else f.n_file end as n, c.batch_size, c.epochs
      from {_configs_values()} cross join f)
select config, cast(n as bigint) as n, cast(n // batch_size as bigint) as steps_per_epoch,
       cast((n // batch_size) * epochs as bigint) as max_steps from x""",

    "pad_encode": f"""
with t as (select doc_id, {_tokens('text')} as toks from documents),
c as (select doc_id, len(toks) as n_words, toks[1:{PAD_LENGTH}] as cut from t)
select doc_id, cast(n_words as integer) as n_words, cast(len(cut) as integer) as n_tokens, {PAD_LENGTH} as length,
       sha256(array_to_string(list_concat(cut, list_transform(range({PAD_LENGTH} - len(cut)), lambda x: '<pad>')), chr(1))) as tokens_sha
from c""",

    "triplet_metrics": f"""with {V_TRIP},
d as (select greatest({l2('src', 'pos')} - {l2('src', 'neg')} + 1.0, 0.0) as ls,
             greatest({l2('ref', 'pos')} - {l2('ref', 'neg')} + 1.0, 0.0) as lr,
             {l2('pos', 'src')} as ps, {l2('pos', 'ref')} as pr, {l2('neg', 'src')} as ns, {l2('neg', 'ref')} as nr
      from v_trip)
select round(avg(ls) + avg(lr), 6) as loss,
       round(avg(case when ps + pr <> 0 then 2 * ps * pr / (ps + pr) end), 6) as distance_pos,
       round(avg(case when ns + nr <> 0 then 2 * ns * nr / (ns + nr) end), 6) as distance_neg,
       count(*) as n
from d""",

    "pair_score_mse": f"""with {V_QE},
x as (select ((strlen(source) % 100) / 100.0 + (strlen(target) % 100) / 100.0) / 2.0 as pred,
             cast(score as double) as label from v_qe)
select round(avg((pred - label) * (pred - label)), 6) as mse, count(pred - label) as n from x""",

    "eval_split": f"""
select doc_id,
       cast(row_number() over (order by doc_id) - 1 < floor(count(*) over () * 0.2) as integer) as is_eval,
       {_split(0.2)} as split, {_split(0.003)} as split_few, {_split(0.5)} as split_half, {_split(1.0)} as split_all
from documents""",

    "encode_text": f"""with {V_TURNS},
l as (select conv_id, turn, 'src' as role, coalesce(src, 'None') as t from v_turns
      union all select conv_id, turn, 'ref', coalesce(src, 'None') from v_turns
      union all select conv_id, turn, 'pos', coalesce(tgt, 'None') from v_turns
      union all select conv_id, turn, 'neg', coalesce(reverse(tgt), 'None') from v_turns),
c as (select conv_id, turn, role, {_letters('t')} as v from l),
n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from c)
select conv_id, turn, role, round(case when norm > 0 then v[1] / norm else 0.0 end, 3) as first,
       round(case when norm > 0 then list_sum(v) / norm else 0.0 end, 3) as total, cast(len(v) as integer) as dim
from n""",

    "quality_head": f"""with {V_TRIP},
p as (select list_concat(src, pos) as x, 1.0::double as y from v_trip union all select list_concat(src, neg), 0.0 from v_trip),
e as (select unnest(list_append(x, 1.0)) as x, unnest(range(0, len(x) + 1)) as i, y from p)
select cast(i as integer) as feature, count(*) as n, round(sum(cast(x as double) * y), 4) as xy, 0.0::double as residual
from e group by i""",
    "quality_line": f"""with {V_QE},
x as (select row_id, (strlen(source) % 100) / 100.0 as f, cast(score as double) as label from v_qe),
m as (select regr_slope(label, f) as b, regr_intercept(label, f) as a from x)
select x.row_id, round(m.a + m.b * x.f, 4) as prediction from x cross join m""",

    "seeded_sample": f"""
with s as (select doc_id from documents order by sha256(concat('42:', cast(doc_id as varchar))), doc_id
           limit {DEBUG_TRAIN_ROWS}),
r as (select doc_id, row_number() over (order by sha256(concat('42:', cast(doc_id as varchar))), doc_id) - 1 as pos from s)
select doc_id, cast(pos as integer) as pos, cast(pos < {DEBUG_EVAL_ROWS} as integer) as in_eval from r""",

    "run_labels": """
select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp, event_type as run, 4 as n_keys, '2e-05' as lr,
       '8' as batch_size
from events""",
}
