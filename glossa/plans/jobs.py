"""End-to-end jobs: the evaluation scripts' lifecycles as single Spark jobs.

Each reads a table (CSV with pandas NA rules by default, or Parquet), gives rows
stable ids at ingest, optionally keeps the first ``test_size`` rows in input
order, runs the operators and writes partitioned results to shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.fixed_text import (CONCURRENCY, CONCURRENCY_TEST, DEBUG_EVAL_ROWS, DEBUG_TRAIN_ROWS, MODELS, QUESTIONS,
                               TEMPLATE_BASELINE, TEMPLATE_STEPWISE)
from glossa.functions.text import judge_score
from glossa.operators import prompts as P
from glossa.operators.metrics import score_document
from glossa.operators.rows import cut_lineage, head_in_order, with_index, with_row_id
from glossa.operators.scoring import JUDGE_SAMPLING, generate_judgements, score_segments
from glossa.operators.sweep import read_models, run_sweep
from glossa.sources.cache import ResponseCache
from glossa.sources.sinks import with_output_name, write_counted, write_scored_document, write_table
from glossa.sources.tables import read_table

PROMPT_COLUMNS = ["src", "tgt", "QA", "pair", "model", "dataset"]


def ingest(spark: SparkSession, path: str, fmt: str = "csv", test_size: int | None = None,
           schema: str | None = None) -> tuple[DataFrame, str, bool]:
    """The input with a row key, written once; the key's name; whether its values are 0..n-1.

    An input whose ``row_id`` names every row (whole numbers, no null, no repeat) keeps it
    as the key, so ids mean the same row in every step. An input without ``row_id`` gets
    one here, in input order. Any other ``row_id`` (the steps' variants in one table, say)
    is a plain column: it stays as it is, and a key of its own is given in input order.
    The written table is what the job works on: ids do not change between readers.
    """
    df = read_table(spark, path, fmt=fmt, na_rules="pandas" if fmt == "csv" else "spark", schema=schema)
    key, dense = "row_id", "row_id" not in df.columns
    if dense:
        rows = with_row_id(df)
    else:
        rows = cut_lineage(df.withColumn(key, F.col(key).try_cast("long")), "ingest")
        n, distinct = rows.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
        if n != distinct:
            key, dense = "_row_key", True
            while key in df.columns:
                key = f"_{key}"
            rows = with_row_id(df, key)
    return (head_in_order(rows, test_size, key) if test_size else rows), key, dense


def load(spark: SparkSession, path: str, fmt: str = "csv", test_size: int | None = None,
         schema: str | None = None) -> DataFrame:
    """The ingested input without an internal key."""
    rows, key, _ = ingest(spark, path, fmt, test_size, schema)
    return rows if key == "row_id" else rows.drop(key)


def prompt_job(spark: SparkSession, input_path: str, output_path: str, *, fmt: str = "csv",
               templates: dict[str, str] | None = None, questions: str = QUESTIONS,
               out_fmt: str = "csv", mode: str = "errorifexists") -> DataFrame:
    """Render every template per pair; one output folder per variant, columns in the fixed order."""
    templates = templates or {"baseline": TEMPLATE_BASELINE, "stepwise": TEMPLATE_STEPWISE}
    pairs = load(spark, input_path, fmt)
    out = P.render_variants(pairs, templates, {"source": F.col("src"), "translation": F.col("tgt"),
                                               "questions": questions}, out="QA")
    out = out.select("row_id", "prompt_variant", *PROMPT_COLUMNS)
    write_table(out, output_path, fmt=out_fmt, partition_by=["prompt_variant"], mode=mode)
    return out


def sweep_job(spark: SparkSession, input_path: str, output_path: str, cache_path: str,
              client_factory: Callable, *, models: list[str] | str = MODELS, content_col: str = "QA",
              fmt: str = "csv", test_size: int | None = None, mode: str = "errorifexists",
              report: dict | None = None, **score_opts) -> DataFrame:
    """Every prompt to every model through the cache; results per (model, input file).
    A ``report`` receives the rows written (n), failed and without a response.

    ``models`` is a list of ids or the path of a model-list file (one id per line). At
    most ``CONCURRENCY`` requests are in flight (``CONCURRENCY_TEST`` with a test size).
    """
    if isinstance(models, str):
        models = read_models(spark, models)
    score_opts.setdefault("concurrency", CONCURRENCY_TEST if test_size else CONCURRENCY)
    rows, key, _ = ingest(spark, input_path, fmt, test_size)
    answered = run_sweep(rows, models, content_col, ResponseCache(spark, cache_path), client_factory,
                         row_key=key, **score_opts)
    answered = answered if key == "row_id" else answered.drop(key)
    named = with_output_name(answered, "chat_model", input_name=input_path.rstrip("/").split("/")[-1])
    counts = write_counted(named, output_path, {"n_failed": F.col("error").isNotNull(),
                                                "n_no_response": F.col("response").isNull()},
                           partition_by=["output_name"], mode=mode)
    if report is not None:
        report.update(counts)
    return named


def judge_job(spark: SparkSession, input_path: str, output_path: str, generator_factory: Callable, *,
              source_col: str = "source", target_col: str = "tgt", fmt: str = "csv",
              test_size: int | None = None, sampling: dict = JUDGE_SAMPLING, layout: dict = P.CHATML,
              out_fmt: str = "csv", mode: str = "errorifexists", report: dict | None = None) -> DataFrame:
    """Rubric judge: prompt, chat flattening, generation, score parsing, attach, write.
    A ``report`` receives the rows written (n) and those whose score did not parse."""
    rows = load(spark, input_path, fmt, test_size)
    prompt = P.flatten_chat(P.as_messages(P.judge_content(F.col(source_col), F.col(target_col))), layout)
    judged = generate_judgements(rows.withColumn("_prompt", prompt), "_prompt", generator_factory, sampling)
    out = judged.drop("_prompt").withColumn("llm_score", judge_score("llm_response"))
    counts = write_counted(out, output_path, {"n_null": F.col("llm_score").isNull()}, fmt=out_fmt, mode=mode)
    if report is not None:
        report.update(counts)
    # read the written result back: acting on ``out`` again would call the model again
    return read_table(spark, output_path, fmt=out_fmt, schema=out.schema)


def segment_job(spark: SparkSession, input_path: str, output_path: str, scorer_factory: Callable, *,
                src_col: str = "src", mt_col: str = "tgt", ref_col: str | None = None, fmt: str = "csv",
                test_size: int | None = None, batch_size: int = 8, model_info: dict | None = None,
                mode: str = "errorifexists") -> DataFrame:
    """Segment scores with 0-based ids in input order, plus one summary row (the system score)."""
    rows, key, dense = ingest(spark, input_path, fmt, test_size)
    # ids given at ingest are the segment ids; kept ids are numbered before scoring
    rows = rows.withColumn("segment_id", F.col(key)) if dense else with_index(rows, key, out="segment_id")
    segs = score_segments(rows, src_col, mt_col, scorer_factory, ref_col=ref_col, batch_size=batch_size)
    cols = ["segment_id", F.col(src_col).alias("source"), F.col(mt_col).alias("translation"), "score"]
    if ref_col:
        cols.append(F.col(ref_col).alias("reference"))
    segs = segs.select(*cols, "error_spans")
    # segments written first, summary from the files: the scorer runs once
    return write_scored_document(segs, output_path, lambda x: score_document(x, by=(), model_info=model_info), mode=mode)


DEBUG_BATCH = 2      # batch size of the debug runs


def regression_tables_job(spark: SparkSession, input_path: str, output_path: str, *, fmt: str = "csv",
                          batch_size: int = 8, frac: float = 0.2, max_length: int = 512, debug: bool = False,
                          mode: str = "errorifexists") -> dict[str, DataFrame]:
    """Regression training tables: rename and check columns, label to float, the
    evaluation slice (first ``frac`` of rows in file order, also kept in train),
    train and evaluation batches along their seeded shuffles; in debug mode the first 10
    rows of the train shuffle, and 4 of them for evaluation, in batches of 2, with the same columns.

    Writes ``train/`` and ``eval/`` (wide rows) and ``train_tokens/`` and
    ``eval_tokens/`` (per role: padded tokens and mask, with the label) under
    ``output_path`` and returns them as read back. The input is read once; the
    slice and both shuffles are arithmetic on the ingest ids.
    """
    from glossa.functions.tokens import pad_encode
    from glossa.operators import training as T

    loaded, key, dense = ingest(spark, input_path, fmt)
    if not dense:
        loaded = with_index(loaded, key, out="_file_pos")
    pos = key if dense else "_file_pos"
    rows = T.prepare_regression(loaded, keep=list(dict.fromkeys(["row_id", key, pos])))
    n = loaded.count()
    cut = int(n * frac)
    train = T.permuted_position(rows.withColumn("is_eval", F.col(pos) < cut), pos, n)
    if debug:
        batch_size = DEBUG_BATCH
        train = train.where(F.col("shuffle_pos") < DEBUG_TRAIN_ROWS)
        evals = train.where(F.col("shuffle_pos") < DEBUG_EVAL_ROWS)
    else:
        evals = T.permuted_position(train.where("is_eval").drop("shuffle_pos"), pos, cut)
    out = {}
    for name, df in (("train", train), ("eval", evals)):
        batched = T.batches_of(df, "shuffle_pos", batch_size)
        batched = batched.drop("_file_pos", *([key] if key != "row_id" else []))
        batched.write.mode(mode).parquet(f"{output_path}/{name}")
        out[name] = wide = spark.read.schema(batched.schema).parquet(f"{output_path}/{name}")
        tokens = T.to_roles(wide, ["src", "mt"], keep=["label", "label_ok"]).withColumn(
            "enc", pad_encode(F.col("text"), max_length))
        tokens.write.mode(mode).parquet(f"{output_path}/{name}_tokens")
        out[f"{name}_tokens"] = spark.read.schema(tokens.schema).parquet(f"{output_path}/{name}_tokens")
    return out


def ranking_tables_job(spark: SparkSession, input_path: str, output_path: str, *, fmt: str = "csv",
                       batch_size: int = 8, max_length: int = 512, debug: bool = False,
                       mode: str = "errorifexists") -> DataFrame:
    """Ranking training table: ``ref`` filled from ``src`` when the column is
    missing, values as text, batches of ``batch_size`` and the role layout
    (src, ref, pos, neg) with padded tokens and masks per role; debug keeps 10 rows."""
    from glossa.functions.tokens import pad_encode
    from glossa.operators import training as T

    loaded, key, dense = ingest(spark, input_path, fmt)
    rows = T.prepare_triplets(loaded, keep=list(dict.fromkeys(["row_id", key])))
    if debug:
        rows = head_in_order(rows, 10, key)
    batched = T.batches_of(rows, key, batch_size) if dense else T.assign_batches(rows, key, batch_size)
    batched = batched if key == "row_id" else batched.drop(key)
    encoded = T.to_roles(batched, T.TRIPLET_ROLES).withColumn("enc", pad_encode(F.col("text"), max_length))
    encoded.write.mode(mode).parquet(output_path)
    return spark.read.schema(encoded.schema).parquet(output_path)
