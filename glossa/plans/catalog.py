"""Registered queries: one per operator group, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the whole input tables (through the views in
``glossa.plans.views``); none subsets rows to stay cheap. Column names match
the DuckDB oracle in ``glossa.plans.oracle``. Long texts are compared through
their SHA-256 and length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.fixed_text import (DEBUG_EVAL_ROWS, DEBUG_SAMPLES, DEBUG_TRAIN_ROWS, DEFAULT_RANKING_SAMPLES,
                               MODELS, QUESTIONS, RUN_CONFIGS, TEMPLATE_BASELINE, TEMPLATE_STEPWISE)
from glossa.functions.config import get_or, merge_right_wins, run_stamp
from glossa.functions.answers import normalize_answer
from glossa.functions.text import basename, has_suffix, judge_score, na_normalize, slug, stem
from glossa.functions.tokens import pad_encode as pad_encode_expr, pad_tokens, vocab_ids as vocab_ids_op, whitespace_tokens
from glossa.operators import metrics as M
from glossa.operators import prompts as P
from glossa.operators import sweep as S
from glossa.operators import training as T
from glossa.operators.rows import attach_checked, cut_lineage, head_in_order, with_index
from glossa.operators.scoring import encode_texts, generate_judgements, response_content, score_segments
from glossa.operators.stubs import EchoClient, LengthRatioScorer, LetterEncoder, StubJudge
from glossa.plans.views import table, v_answers, v_judge, v_pairs, v_qa, v_qe, v_trip, v_turns
from glossa.session import scratch_path
from glossa.sources.cache import ResponseCache
from glossa.sources.sinks import with_output_name, write_scored_document, write_table
from glossa.sources.tables import read_table, read_wholetext

PAD_LENGTH = 512          # max_length of the training configurations
HEAD_PENALTY = 0.1        # ridge penalty of the many-feature head
BATCH_SIZE = 8            # batch_size of the training configurations
WARM_PAIR = "en-en"       # the language pair a previous sweep already scored


def sha(c) -> F.Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def _slots(src="src", tgt="tgt"):
    return {"source": F.col(src), "translation": F.col(tgt), "questions": QUESTIONS}


# ---------------------------------------------------------------- sources, projections
def scan_head(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    x = docs.select(F.col("doc_id").alias("row_id"), na_normalize("text").alias("src"),
                    F.concat("lang", F.lit("-en")).alias("pair"))
    return head_in_order(x, 100, "row_id")


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "pairs-csv")
    # a text with white space around it, of white space only, empty, or missing
    k = F.col("row_id") % 5
    edge = (F.when(k == 0, F.concat(F.lit("  "), "tgt")).when(k == 1, F.concat("tgt", F.lit(" \n\t")))
             .when(k == 2, F.lit(" \t ")).when(k == 3, F.lit("")))
    write_table(v_pairs(spark, d).select("row_id", "src", "tgt", edge.alias("edge")), path, fmt="csv")
    back = read_table(spark, path, "csv", schema="row_id long, src string, tgt string, edge string", keep_corrupt=True)
    return back.select("row_id", sha("src").alias("src_sha"), sha("tgt").alias("tgt_sha"),
                       F.length("src").alias("src_len"), sha("edge").alias("edge_sha"),
                       F.col("_corrupt_record").isNotNull().cast("int").alias("malformed"))


def model_slug(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    return pages.select("page_id", slug("url").alias("slug"), basename("url").alias("base"),
                        stem("url").alias("stem"), has_suffix("url", "#top").cast("int").alias("is_top"))


# ---------------------------------------------------------------- prompts
def render_baseline(spark: SparkSession, d: str) -> DataFrame:
    x = P.render_prompt(v_pairs(spark, d), TEMPLATE_BASELINE, _slots())
    return x.select("row_id", sha("prompt").alias("prompt_sha"), F.length("prompt").alias("prompt_len"))


def render_variants(spark: SparkSession, d: str) -> DataFrame:
    x = P.render_variants(v_pairs(spark, d), {"baseline": TEMPLATE_BASELINE, "stepwise": TEMPLATE_STEPWISE},
                          _slots())
    return x.select("row_id", "prompt_variant", F.length("prompt").alias("prompt_len"),
                    sha("prompt").alias("prompt_sha"))


def render_judge(spark: SparkSession, d: str) -> DataFrame:
    t = v_turns(spark, d)
    msgs = P.as_messages(P.judge_content(F.col("src"), F.col("tgt")))
    x = t.select("conv_id", "turn", msgs.alias("messages"))
    return x.select("conv_id", "turn", F.col("messages")[0]["role"].alias("role"),
                    sha(F.col("messages")[0]["content"]).alias("content_sha"),
                    sha(P.flatten_chat(F.col("messages"))).alias("flat_sha"))


def question_table(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "questions")          # the bank as a file, read whole
    spark.createDataFrame([(QUESTIONS,)], "value string").coalesce(1).write.text(path)
    qs = P.question_rows(read_wholetext(spark, path))
    counts = (v_answers(spark, d).groupBy("qid")
              .agg(F.count(normalize_answer("raw")).alias("n_valid"), F.count(F.lit(1)).alias("n_answers")))
    return qs.join(counts, "qid", "left").select("qid", "question", "n_valid", "n_answers")


# ---------------------------------------------------------------- sweep, dedupe, cache
def _prompt_rows(spark: SparkSession, d: str) -> DataFrame:
    """The slots of the sweep's prompts; ``_content`` renders them where the text is needed."""
    return v_pairs(spark, d).select("row_id", "pair", "src", "tgt")


def _content() -> F.Column:
    return P.template_expr(TEMPLATE_BASELINE, _slots())


def _keyed(rows: DataFrame) -> DataFrame:
    return S.request_keys(rows, MODELS, _content())


def _warm_cache(spark: SparkSession, rows: DataFrame) -> ResponseCache:
    """A cache holding a previous sweep over one language pair."""
    cache = ResponseCache(spark, scratch_path(spark, "cache"))
    earlier = rows.where(F.col("pair") == WARM_PAIR)
    S.fill_cache(S.unique_requests(_keyed(earlier)), earlier, _content(), cache, EchoClient, backoff_s=0.0)
    return cache


def sweep_expand(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(_prompt_rows(spark, d)).groupBy("chat_model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("request_id").alias("n_keys"))


def sweep_dedupe(spark: SparkSession, d: str) -> DataFrame:
    k = _keyed(_prompt_rows(spark, d))
    return k.groupBy("request_id", "chat_model").agg(F.count(F.lit(1)).alias("n_rows"))


def sweep_variants(spark: SparkSession, d: str) -> DataFrame:
    """Both prompt variants to every model of a model-list file."""
    path = scratch_path(spark, "models")
    spark.createDataFrame([(m,) for m in MODELS] + [("",)], "value string").coalesce(1).write.text(path)
    prompts = P.render_variants(v_pairs(spark, d), {"baseline": TEMPLATE_BASELINE, "stepwise": TEMPLATE_STEPWISE},
                                _slots(), out="content").select("row_id", "prompt_variant", "content")
    keyed = S.with_request_key(S.expand_models(prompts, S.read_models(spark, path)), "content")
    named = with_output_name(keyed, "chat_model", input_name="pairs.csv")
    return named.groupBy("prompt_variant", "chat_model", "output_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("request_id").alias("n_keys"))


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    rows = _prompt_rows(spark, d)
    requests = S.unique_requests(cut_lineage(_keyed(rows), "request-keys"))
    cache = _warm_cache(spark, rows)
    return S.split_cache(requests, cache.keys(requests))[1].select("request_id", "chat_model")


def cache_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _prompt_rows(spark, d)
    keyed = cut_lineage(_keyed(rows), "request-keys")
    return S.cache_report(keyed, _warm_cache(spark, rows).keys(keyed))


def score_stub(spark: SparkSession, d: str) -> DataFrame:
    rows = _prompt_rows(spark, d)
    cache = _warm_cache(spark, rows)
    keyed = cut_lineage(_keyed(rows), "request-keys")
    S.fill_cache(S.unique_requests(keyed), rows, _content(), cache, EchoClient, backoff_s=0.0)
    out = S.attach_responses(keyed, cache)
    return out.select("row_id", "chat_model", "response", judge_score("response").alias("score"),
                      "error", "attempts")


def _answered(spark: SparkSession, d: str) -> DataFrame:
    cache = ResponseCache(spark, scratch_path(spark, "cache"))
    answered = S.run_sweep(_prompt_rows(spark, d), MODELS, _content(), cache, EchoClient, backoff_s=0.0)
    return answered.withColumn("score", judge_score("response"))


def failed_requests(spark: SparkSession, d: str) -> DataFrame:
    return S.failed(_answered(spark, d)).select("row_id", "chat_model", "error", "attempts")


def sweep_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows, unparsed scores and failed requests per model."""
    return M.parse_report(_answered(spark, d), "score", by=["chat_model"], error_col="error").withColumn(
        "null_rate", F.round("null_rate", 6))


def response_extract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    full = F.to_json(F.struct(F.col("event_id").alias("id"), F.lit("chat.completion").alias("object"),
                              F.array(F.struct(F.lit(0).alias("index"), F.struct(
                                  F.lit("assistant").alias("role"), F.col("props").alias("content")
                              ).alias("message"))).alias("choices")))
    return e.select(F.col("event_id").alias("row_id"), full.alias("full_response")) \
            .select("row_id", response_content("full_response").alias("content"))


# ---------------------------------------------------------------- judge
def judge_generate(spark: SparkSession, d: str) -> DataFrame:
    t = v_turns(spark, d)
    x = t.select("conv_id", "turn",
                 P.flatten_chat(P.as_messages(P.judge_content(F.col("src"), F.col("tgt")))).alias("prompt"))
    g = generate_judgements(x, "prompt", StubJudge)
    return g.select("conv_id", "turn", "llm_response", judge_score("llm_response").alias("llm_score"))


def judge_score_q(spark: SparkSession, d: str) -> DataFrame:
    return v_judge(spark, d).select("row_id", judge_score("response").alias("score"))


def parse_report(spark: SparkSession, d: str) -> DataFrame:
    x = v_judge(spark, d).withColumn("score", judge_score("response"))
    return M.parse_report(x, "score", by=["model"]).withColumn("null_rate", F.round("null_rate", 6))


def system_score(spark: SparkSession, d: str) -> DataFrame:
    x = v_judge(spark, d).withColumn("score", judge_score("response"))
    return M.system_score(x, "score", by=["model"]).withColumn("system_score", F.round("system_score", 6))


# ---------------------------------------------------------------- segment scoring
def _segments(spark: SparkSession, d: str) -> DataFrame:
    s = score_segments(v_pairs(spark, d), "src", "tgt", LengthRatioScorer)
    return M.with_segment_ids(s, by=["model"], order_col="row_id")


def segment_scores(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("row_id", "model", "segment_id", F.round("score", 6).alias("score"),
                                      F.col("error_spans").isNotNull().cast("int").alias("has_spans"))


def score_document(spark: SparkSession, d: str) -> DataFrame:
    seg = _segments(spark, d).select("model", "segment_id", "row_id", F.col("src").alias("source"),
                                     F.col("tgt").alias("translation"), "score", "error_spans")
    path = scratch_path(spark, "score-doc")
    write_scored_document(seg, path, lambda x: M.score_document(x, by=["model"]))
    back = spark.read.schema("model string, system_score double, n_segments long, n_with_spans long") \
        .json(f"{path}/summary")
    return back.withColumn("system_score", F.round("system_score", 6))


def segments_table(spark: SparkSession, d: str) -> DataFrame:
    """The written segment list of the scoring document, with the summary's model info."""
    seg = _segments(spark, d).select("model", "segment_id", "row_id", F.col("src").alias("source"),
                                     F.col("tgt").alias("translation"), "score", "error_spans")
    path = scratch_path(spark, "score-doc")
    back = write_scored_document(seg, path, lambda x: M.score_document(x, by=["model"], model_info={"scorer": "length"}))
    info = spark.read.schema("model string, model_info struct<scorer:string>").json(f"{path}/summary")
    return back.join(info, "model").select(
        "model", "segment_id", "row_id", sha("source").alias("source_sha"), sha("translation").alias("translation_sha"),
        F.round("score", 6).alias("score"), F.col("error_spans")[0]["end"].alias("span_end"),
        F.col("error_spans")[0]["severity"].alias("severity"), F.col("model_info.scorer").alias("scorer"))


def reference_scores(spark: SparkSession, d: str) -> DataFrame:
    """Reference-based segment scores, attached to their rows by a checked join."""
    pairs = v_pairs(spark, d).select("row_id", "src", "tgt", "model")
    scored = score_segments(pairs.withColumn("ref", F.upper("tgt")), "src", "tgt", LengthRatioScorer, ref_col="ref")
    out = attach_checked(pairs.select("row_id", "model"), scored.select("row_id", "score"), "row_id")
    return out.select("row_id", "model", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- QA answers
def answers_long(spark: SparkSession, d: str) -> DataFrame:
    return M.answer_tallies(M.answers_long(v_qa(spark, d)))


def qa_score(spark: SparkSession, d: str) -> DataFrame:
    x = M.with_qa_score(v_qa(spark, d), "response")
    return x.select("row_id", "model", F.round("score", 6).alias("score"))


def qa_score_weighted(spark: SparkSession, d: str) -> DataFrame:
    x = M.with_qa_score(v_qa(spark, d), "response", weights={str(k): (0.5 if k % 2 else 2.0) for k in range(1, 21)})
    return x.select("row_id", "model", F.round("score", 6).alias("score"))


def answer_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = M.answer_pivot(M.answers_long(v_qa(spark, d)), by=["model"])
    return p.select("model", *[F.col(c).alias(f"n_{c.lower()}") for c in ("YES", "NO", "MAYBE", "INVALID")])


def judged_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Mean judge score by model, pair and dataset, with subtotals and the null rate."""
    k = F.col("row_id") % 7
    response = F.when(k < 5, F.concat(F.lit("ok [RESULT] "), (k + 1).cast("string"))).when(k == 5, F.lit("no mark"))
    x = v_pairs(spark, d).select("model", "pair", "dataset", judge_score(response).alias("score"))
    r = M.score_rollup(x, ["model", "pair", "dataset"], {
        "system_score": F.avg("score"), "null_rate": F.count_if(F.col("score").isNull()) / F.count(F.lit(1))})
    return r.select("model", "pair", "dataset", "gid", "n", F.round("system_score", 6).alias("system_score"),
                    F.round("null_rate", 6).alias("null_rate"))


def score_rollup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    x = docs.join(table(spark, d, "labels"), "doc_id", "inner")
    r = M.score_rollup(x, ["lang", "quality"], {"avg_chars": F.avg("n_chars"), "toxic_rate": F.avg("toxic")})
    return r.select("lang", "quality", "gid", "n", F.round("avg_chars", 6).alias("avg_chars"),
                    F.round("toxic_rate", 6).alias("toxic_rate"))


# ---------------------------------------------------------------- training tables
def prepare_triplets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    t = v_turns(spark, d)
    nxt = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("neg"))
    x = t.join(nxt, ["conv_id", "turn"], "left").select("conv_id", "turn", "src", F.col("tgt").alias("pos"), "neg")
    p = T.prepare_triplets(x, keep=["conv_id", "turn"])
    return p.select("conv_id", "turn", sha("src").alias("src_sha"), sha("ref").alias("ref_sha"),
                    sha("pos").alias("pos_sha"), sha("neg").alias("neg_sha"),
                    (F.col("neg") == "None").cast("int").alias("neg_missing"))


def prepare_regression(spark: SparkSession, d: str) -> DataFrame:
    p = T.prepare_regression(v_qe(spark, d), keep=["row_id"])
    return p.select("row_id", sha("src").alias("src_sha"), sha("mt").alias("mt_sha"), "label",
                    F.col("label_ok").cast("int").alias("label_ok"))


def roles_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = T.prepare_regression(v_qe(spark, d), keep=["row_id"])
    b = T.assign_batches(p, "row_id", BATCH_SIZE)
    wide = T.from_roles(T.to_roles(b, ["src", "mt"]), ["src", "mt"])
    return wide.select("batch", "slot", sha("src").alias("src_sha"), sha("mt").alias("mt_sha"))


def assign_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return T.assign_batches(docs, "doc_id", BATCH_SIZE, by=["lang"]).select("doc_id", "lang", "batch", "slot")


def shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return T.shuffled_batches(docs, "doc_id", BATCH_SIZE).select("doc_id", "shuffle_pos", "batch", "slot")


def permuted_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches along a seeded permutation of the ids: arithmetic, no sort and no shuffle."""
    docs = table(spark, d, "documents").select("doc_id")
    return T.permuted_batches(docs, "doc_id", BATCH_SIZE).select("doc_id", "shuffle_pos", "batch", "slot")


def regression_layout(spark: SparkSession, d: str) -> DataFrame:
    """Shuffled batches of the regression rows: tokens and mask per role, with the label."""
    p = T.prepare_regression(v_qe(spark, d), keep=["row_id"])
    b = T.shuffled_batches(p, "row_id", BATCH_SIZE)
    x = T.to_roles(b, ["src", "mt"], keep=["label"]).withColumn("enc", pad_encode_expr(F.col("text"), PAD_LENGTH))
    return x.select("batch", "slot", "role", "label",
                    F.aggregate("enc.attention_mask", F.lit(0), lambda a, m: a + m).alias("n_tokens"),
                    sha(F.array_join("enc.tokens", "\u0001")).alias("tokens_sha"))


def stack_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The four role vectors of every triplet as rows of the batch layout, in their own type."""
    b = T.assign_batches(v_trip(spark, d), "row_id", BATCH_SIZE)
    x = T.to_roles(b, T.TRIPLET_ROLES, value="embedding")
    return x.select("batch", "slot", "role_pos", "role", F.size("embedding").alias("dim"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"))


def vocab_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of documents from a vocabulary table (the benchmark's words, numbered in order)."""
    words = table(spark, d, "benchmark").select(F.explode(whitespace_tokens(F.col("text"))).alias("token")).distinct()
    vocab = with_index(words, "token", out="i").select("token", (F.col("i") + 2).alias("id"))
    docs = table(spark, d, "documents").select("doc_id", pad_tokens(whitespace_tokens(F.col("text")), PAD_LENGTH).alias("tokens"))
    ids = vocab_ids_op(docs, "tokens", vocab, "doc_id")
    return ids.select("doc_id", F.size("input_ids").alias("length"),
                      F.size(F.filter("input_ids", lambda i: i == 1)).alias("n_unknown"),
                      F.size(F.filter("input_ids", lambda i: i == 0)).alias("n_pad"),
                      F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, i: a + i).alias("id_sum"))


def step_budget(spark: SparkSession, d: str) -> DataFrame:
    n_file = v_qe(spark, d).agg(F.count(F.lit(1)).alias("n_file"))
    cfg = F.array(*[F.struct(F.lit(name).alias("config"), F.lit(kind).alias("kind"), F.lit(b).alias("batch_size"),
                             F.lit(e).alias("epochs"), F.lit(total).cast("long").alias("total"))
                    for name, kind, b, e, _ml, _ga, total in RUN_CONFIGS])
    x = n_file.select("n_file", F.inline(cfg))
    n = (F.when(F.col("kind") == "ranking", F.coalesce("total", F.lit(DEFAULT_RANKING_SAMPLES).cast("long")))
          .when(F.col("kind") == "regression_debug", F.lit(DEBUG_SAMPLES).cast("long"))
          .otherwise(F.col("n_file")))
    x = x.withColumn("n", n)
    return x.select("config", "n", F.floor(F.col("n") / F.col("batch_size")).cast("long").alias("steps_per_epoch"),
                    T.step_budget(F.col("n"), F.col("batch_size"), F.col("epochs")).alias("max_steps"))


def pad_encode(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    e = docs.select("doc_id", F.size(whitespace_tokens(F.col("text"))).alias("n_words"),
                    pad_encode_expr(F.col("text"), PAD_LENGTH).alias("enc"))
    return e.select("doc_id", "n_words",
                    F.aggregate("enc.attention_mask", F.lit(0), lambda a, m: a + m).alias("n_tokens"),
                    F.size("enc.tokens").alias("length"),
                    sha(F.array_join("enc.tokens", "\u0001")).alias("tokens_sha"))


def triplet_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = M.triplet_metrics(v_trip(spark, d))
    return m.select(*[F.round(c, 6).alias(c) for c in ("loss", "distance_pos", "distance_neg")], "n")


def pair_score_mse(spark: SparkSession, d: str) -> DataFrame:
    q = v_qe(spark, d)
    stub = lambda c: (F.octet_length(c) % 100) / F.lit(100.0)  # noqa: E731 - stand-in side scores
    x = q.select(stub("source").alias("src_score"), stub("target").alias("mt_score"),
                 F.col("score").cast("double").alias("label"))
    x = x.withColumn("pred", M.pair_score("src_score", "mt_score"))
    return M.mse(x, "pred", "label").withColumn("mse", F.round("mse", 6))


def eval_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    a = T.eval_split(docs, "doc_id")
    b = T.eval_split(a, "doc_id", disjoint=True)
    for name, frac in (("split_few", 0.003), ("split_half", 0.5), ("split_all", 1.0)):
        b = T.eval_split(b.withColumnRenamed("split", "_s"), "doc_id", frac=frac, disjoint=True)
        b = b.withColumnRenamed("split", name).withColumnRenamed("_s", "split")
    return b.select("doc_id", F.col("is_eval").cast("int").alias("is_eval"), "split", "split_few", "split_half", "split_all")


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    train = T.debug_sample(docs, "doc_id", DEBUG_TRAIN_ROWS)
    # the sample is DEBUG_TRAIN_ROWS rows: a window without partitions is bounded here
    ranked = T.seeded_order(train, "doc_id").withColumn(
        "pos", F.row_number().over(Window.orderBy("shuffle_key", "doc_id")) - 1)
    return ranked.select("doc_id", "pos", (F.col("pos") < DEBUG_EVAL_ROWS).cast("int").alias("in_eval"))


def encode_text(spark: SparkSession, d: str) -> DataFrame:
    """Sentence vectors of every role of the triplet rows."""
    x = T.prepare_triplets(v_turns(spark, d).withColumnRenamed("tgt", "pos").withColumn("neg", F.reverse("pos")),
                           keep=["conv_id", "turn"])
    long = T.to_roles(x, T.TRIPLET_ROLES, keys=["conv_id", "turn"])
    vec = encode_texts(long, "text", LetterEncoder)
    return vec.select("conv_id", "turn", "role", F.round(F.col("vec")[0].cast("double"), 3).alias("first"),
                      F.round(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double")), 3).alias("total"),
                      F.size("vec").alias("dim"))


def quality_head(spark: SparkSession, d: str) -> DataFrame:
    trip = v_trip(spark, d)
    pairs = trip.select("row_id", F.inline(F.array(
        F.struct(F.lit("pos").alias("kind"), F.concat("src", "pos").alias("features"), F.lit(1.0).alias("label")),
        F.struct(F.lit("neg").alias("kind"), F.concat("src", "neg").alias("features"), F.lit(0.0).alias("label")))))
    model = T.fit_quality_head(pairs, "features", "label", reg=HEAD_PENALTY)
    # the normal equations, from the predictions of all rows: features' sums times what is left over
    left = T.predict_quality(model, pairs, "features").withColumn("rest", F.col("label") - F.col("prediction"))
    rest = T.normal_sums(left, "features", "rest").where((F.col("i") <= len(model.weights)) & (F.col("j") == len(model.weights) + 1))
    label = T.normal_sums(pairs, "features", "label").where((F.col("i") <= len(model.weights)) & (F.col("j") == len(model.weights) + 1))
    weights = F.lit([w * model.n * model.reg for w in model.weights] + [0.0])
    both = rest.select("i", F.col("v").alias("r")).join(label.select("i", "v"), "i")
    residual = F.round(F.col("r") - F.element_at(weights, F.col("i") + 1), 6)
    return both.select(F.col("i").alias("feature"), F.lit(model.n).cast("long").alias("n"), F.round("v", 4).alias("xy"),
                       F.when(residual == 0, 0.0).otherwise(residual).alias("residual"))


def quality_line(spark: SparkSession, d: str) -> DataFrame:
    """The learned head on one feature is the least-squares line."""
    rows = v_qe(spark, d).select("row_id", F.array(F.octet_length("source") % 100 / 100.0).alias("features"),
                                 F.col("score").cast("double").alias("label"))
    model = T.fit_quality_head(rows, "features", "label")
    return T.predict_quality(model, rows, "features").select("row_id", F.round("prediction", 4).alias("prediction"))


def run_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    base = F.create_map(F.lit("batch_size"), F.lit("8"), F.lit("num_epochs"), F.lit("2"), F.lit("run"), F.lit("base"))
    results = F.create_map(F.lit("run"), F.col("event_type"), F.lit("value"), F.col("value").cast("string"))
    merged = merge_right_wins(base, results)
    return e.select("event_id", run_stamp(F.col("ts")).alias("stamp"), merged["run"].alias("run"),
                    F.size(merged).alias("n_keys"), get_or(merged, "learning_rate", "2e-05").alias("lr"),
                    merged["batch_size"].alias("batch_size"))


QUERIES = {
    "scan_head": scan_head,
    "csv_roundtrip": csv_roundtrip,
    "model_slug": model_slug,
    "render_baseline": render_baseline,
    "render_variants": render_variants,
    "render_judge": render_judge,
    "question_table": question_table,
    "sweep_expand": sweep_expand,
    "sweep_dedupe": sweep_dedupe,
    "sweep_variants": sweep_variants,
    "cache_misses": cache_misses,
    "failed_requests": failed_requests,
    "sweep_report": sweep_report,
    "cache_report": cache_report,
    "score_stub": score_stub,
    "response_extract": response_extract,
    "judge_generate": judge_generate,
    "judge_score": judge_score_q,
    "parse_report": parse_report,
    "segment_scores": segment_scores,
    "segments_table": segments_table,
    "reference_scores": reference_scores,
    "system_score": system_score,
    "score_document": score_document,
    "answers_long": answers_long,
    "qa_score": qa_score,
    "qa_score_weighted": qa_score_weighted,
    "answer_pivot": answer_pivot,
    "judged_rollup": judged_rollup,
    "score_rollup": score_rollup,
    "prepare_triplets": prepare_triplets,
    "prepare_regression": prepare_regression,
    "roles_roundtrip": roles_roundtrip,
    "assign_batches": assign_batches,
    "shuffled_batches": shuffled_batches,
    "permuted_batches": permuted_batches,
    "regression_layout": regression_layout,
    "stack_embeddings": stack_embeddings,
    "vocab_ids": vocab_ids,
    "step_budget": step_budget,
    "pad_encode": pad_encode,
    "triplet_metrics": triplet_metrics,
    "pair_score_mse": pair_score_mse,
    "eval_split": eval_split,
    "seeded_sample": seeded_sample,
    "encode_text": encode_text,
    "quality_head": quality_head,
    "quality_line": quality_line,
    "run_labels": run_labels,
}
