"""Result sinks.

Results go to Parquet partitioned by (model slug, input name, ...): one folder
per (model, input) like the per-model output files of a sweep, but readable
back with partition pruning. CSV output quotes and doubles ``"`` so text with
newlines survives a round trip; JSON output keeps non-ASCII text as is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from glossa.functions.text import basename, slug

# White space is text: nothing is trimmed. An empty text is written as a quoted empty
# cell and a missing value as a bare one; on reading both are missing, the rule of the
# CSV inputs. Parquet keeps the difference.
CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "false", "emptyValue": '""', "nullValue": "",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def with_output_name(df: DataFrame, model_col: str, input_path_col: str | None = None,
                     input_name: str | None = None, out: str = "output_name") -> DataFrame:
    """``<model with / as _>_<input file name>``."""
    inp = basename(F.col(input_path_col)) if input_path_col else F.lit(input_name or "")
    return df.withColumn(out, F.concat(slug(F.col(model_col)), F.lit("_"), inp))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "errorifexists") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**CSV_WRITE).csv(path)
    elif fmt == "json":
        w.option("ignoreNullFields", "false").json(path)
    else:
        w.format(fmt).save(path)


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], fmt: str = "parquet",
                  partition_by: Sequence[str] = (), mode: str = "errorifexists") -> dict[str, int]:
    """``write_table`` that returns ``n``, the rows written, and for every condition in ``counts``
    the rows that meet it (a null is no hit), observed by the write itself: no further job, and
    no second model call. An empty table counts 0."""
    seen = Observation()
    hits = [F.count_if(cond).alias(name) for name, cond in counts.items()]
    write_table(df.observe(seen, F.count(F.lit(1)).alias("n"), *hits), path, fmt, partition_by, mode)
    return {"n": 0, **dict.fromkeys(counts, 0), **seen.get}


def write_document(summary: DataFrame, segments: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A scoring document as two JSON tables: ``summary/`` (one row per key) and
    ``segments/`` (one row per segment), both UTF-8 JSON lines. For segments that
    come from a model call use ``write_scored_document`` (one model pass)."""
    summary.write.mode(mode).json(f"{path}/summary")
    segments.write.mode(mode).json(f"{path}/segments")


def write_scored_document(segments: DataFrame, path: str, summarize, mode: str = "errorifexists") -> DataFrame:
    """Write the segments, then the summary computed from the *written* segments.

    Segments usually come from a model call; writing them first and summarising
    the files means the model runs once (two writes of one lazy plan would run
    it twice). Returns the written segments.
    """
    segments.write.mode(mode).json(f"{path}/segments")
    back = segments.sparkSession.read.schema(segments.schema).json(f"{path}/segments")
    summarize(back).write.mode(mode).json(f"{path}/summary")
    return back
