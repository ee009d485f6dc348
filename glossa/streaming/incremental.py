"""Incremental scoring with Structured Streaming.

New files of evaluation rows land in a folder; each micro-batch is rendered,
keyed, checked against the response cache, scored for its misses only and
written out. Restart-safe on three levels: the stream checkpoint records which
files were consumed, the cache makes a re-run micro-batch send no request twice,
and each batch's output goes to its own ``epoch=<id>`` folder with overwrite, so
a replayed batch replaces its earlier partial output instead of duplicating it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glossa.functions.text import judge_score
from glossa.operators.prompts import template_expr
from glossa.operators.rows import cut_lineage
from glossa.operators.sweep import run_sweep
from glossa.sources.cache import ResponseCache


def score_stream(spark: SparkSession, source_dir: str, schema: str, template: str, slots: dict,
                 models: list[str], cache_path: str, client_factory: Callable, output_path: str,
                 checkpoint_location: str, *, fmt: str = "parquet", available_now: bool = True,
                 max_files_per_trigger: int | None = None, keep: list[str] | None = None, row_key: str = "row_id",
                 **score_opts) -> StreamingQuery:
    """``keep`` are the columns written with the answers. A micro-batch whose ``row_key`` does not name
    its rows (nulls, repeats) gets a key of its own, so that no file can stop the stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.load(source_dir)
    keep = keep or [c for c in rows.columns]

    def batch(df: DataFrame, epoch_id: int) -> None:
        rows, key = cut_lineage(df, "micro-batch"), row_key
        n, distinct = rows.agg(F.count(F.lit(1)), F.count_distinct(row_key)).first()
        if n != distinct:
            key = f"_key_{uuid.uuid4().hex[:8]}"
            rows = cut_lineage(rows.withColumn(key, F.monotonically_increasing_id()), "micro-batch")
        answered = run_sweep(rows, models, template_expr(template, slots), ResponseCache(df.sparkSession, cache_path),
                             client_factory, row_key=key, **score_opts)
        out = answered.select(*keep, "chat_model", "request_id", "response",
                              judge_score("response").alias("score"), "error", "attempts")
        out.write.mode("overwrite").parquet(f"{output_path}/epoch={epoch_id}")

    w = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_scored(spark: SparkSession, output_path: str) -> DataFrame:
    return spark.read.parquet(output_path).withColumn("epoch", F.col("epoch").cast("long"))
