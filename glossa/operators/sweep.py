"""Model sweep with request keys, dedupe and a write-through response cache.

    rows --expand_models--> rows x models --request key--> keys (no text)
         --distinct keys, one lookup in the cache, on digests--> misses
         --claim key ranges, join the slots once, render, send--> answers, stored as they come
         --settle--> cache
    keys --left join the cache entries they need--> answered rows

Each distinct request is sent once; a rerun sends only keys without a
successful cached answer, and two sweeps at the same time share the work by claims on
key ranges. Only digests are shuffled, deduplicated and compared; the
prompt is rendered again just before its call. Answers are stored before they are read
again, so a recomputed plan never calls the paid client twice.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.fixed_text import INCLUDE_REASONING, TEMPERATURE
from glossa.functions.keys import request_key
from glossa.functions.text import strip_newlines
from glossa.operators.rows import cut_lineage
from glossa.operators.scoring import answer_requests, response_content
from glossa.sources.cache import ResponseCache
from glossa.sources.claims import RANGES, KeyClaims

POLL_S = 2.0         # between looks at ranges that another sweep has claimed


def read_models(spark: SparkSession, path: str) -> list[str]:
    """Model list file: one id per line, newline stripped, blank lines dropped."""
    lines = spark.read.text(path).select(strip_newlines(F.trim("value")).alias("m")).where(F.col("m") != "").collect()
    return [r.m for r in lines]


def expand_models(df: DataFrame, models: list[str], out: str = "chat_model") -> DataFrame:
    """One row per (input row, model): one literal array and a narrow explode, whatever its length."""
    if not models:
        raise ValueError("the model list is empty")
    return df.withColumn(out, F.explode(F.lit(list(models))))


def with_request_key(df: DataFrame, content_col: str, model_col: str = "chat_model",
                     temperature: float = TEMPERATURE, include_reasoning: bool = INCLUDE_REASONING,
                     out: str = "request_id") -> DataFrame:
    return df.withColumn(out, request_key(F.col(model_col), F.col(content_col), temperature,
                                          include_reasoning))


def distinct_requests(keyed: DataFrame, content_col: str, model_col: str = "chat_model") -> DataFrame:
    """One row per request key (identical requests are sent once)."""
    return keyed.select("request_id", model_col, content_col).dropDuplicates(["request_id"])


def request_keys(rows: DataFrame, models: list[str], content: Column, row_key: str = "row_id",
                 temperature: float = TEMPERATURE, include_reasoning: bool = INCLUDE_REASONING) -> DataFrame:
    """(row_key, chat_model, request_id) of every row and model, without the text."""
    texts = rows.select(row_key, content.alias("_content"))
    return with_request_key(expand_models(texts, models), "_content", "chat_model", temperature,
                            include_reasoning).drop("_content")


def unique_requests(keyed: DataFrame, row_key: str = "row_id") -> DataFrame:
    """One row per request key, with the smallest row that asks it (digests only)."""
    return keyed.groupBy("request_id", "chat_model").agg(F.min(row_key).alias(row_key))


def request_counts(keyed: DataFrame) -> DataFrame:
    """How many input rows share each request key."""
    return keyed.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_rows"))


def split_cache(requests: DataFrame, cache_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of the requests against the cached keys."""
    return (requests.join(cache_keys, "request_id", "left_semi"),
            requests.join(cache_keys, "request_id", "left_anti"))


def cache_report(keyed: DataFrame, cache_keys: DataFrame, model_col: str = "chat_model") -> DataFrame:
    """Per model: distinct requests, how many are cached, how many are not."""
    k = keyed.select(model_col, "request_id").distinct()
    flagged = k.join(cache_keys.withColumn("_hit", F.lit(1)), "request_id", "left")
    return flagged.groupBy(model_col).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("_hit").isNotNull()).alias("hits"),
        F.count_if(F.col("_hit").isNull()).alias("misses"))


def _key_range(request_id: Column) -> Column:
    """The claim range of a key, from its first digits."""
    return F.floor(F.conv(F.substring(request_id, 1, 4), 16, 10).cast("long") * RANGES / (1 << 16)).cast("int")


def require_row_key(rows: DataFrame, row_key: str) -> None:
    """Raise unless ``row_key`` names every row: texts and answers are joined by it, so a
    null would lose its row and a repeated key would send one row's text for another's."""
    key = F.col(row_key)
    n, named, distinct = rows.agg(F.count(F.lit(1)), F.count(key), F.count_distinct(key)).first()
    if n != distinct:
        raise ValueError(f"{row_key} does not name the rows: {n - named} of {n} are null, "
                         f"{named - distinct} repeat another row's")


def fill_cache(requests: DataFrame, texts: DataFrame, content: Column, cache: ResponseCache,
               client_factory: Callable, *, row_key: str = "row_id", slots: Sequence[str] | None = None,
               **send_opts) -> int:
    """Send every request without a cached answer and store the answers in the cache.

    ``requests`` has request_id, chat_model and ``row_key``; ``content`` is rendered from
    ``texts`` (``row_key``, unique and not null, and the ``slots`` that the prompt needs: all columns,
    if not given) just before the call. The cache is looked up once; the misses (digests) are
    written once. A sweep sends only what lies in key ranges it has claimed: ranges that another sweep
    holds are waited for, and what that one has answered is not sent again. ``send_opts`` go to
    ``answer_requests``. Returns the number of requests sent.
    """
    require_row_key(texts, row_key)
    slots = [c for c in texts.columns if c != row_key] if slots is None else list(slots)
    seen = cache.version()
    misses = cut_lineage(split_cache(requests, cache.keys(requests))[1]
                         .withColumn("_range", _key_range(F.col("request_id"))), "misses")
    count = dict(misses.groupBy("_range").count().collect())       # RANGES rows at most
    waiting, sent = set(count), 0
    while waiting:
        with KeyClaims(cache.spark, f"{cache.path}/claims") as claims:
            got = claims.take(waiting)
            if got:
                part, n = misses.where(F.col("_range").isin(sorted(got))), sum(count[r] for r in got)
                if cache.version() != seen:        # others have stored answers since the lookup
                    part = cut_lineage(part.join(cache.keys(part, since=seen), "request_id", "left_anti"), "misses")
                    n = part.count()
                if n:
                    sweep = uuid.uuid4().hex[:16]
                    # a row's slots meet all its requests at once: they are not shuffled per model
                    asks = part.groupBy(row_key).agg(F.sort_array(F.collect_list(F.struct("request_id", "chat_model"))).alias("_asks"))
                    ready = texts.select(row_key, *slots).join(asks, row_key)
                    answer_requests(ready, content, cache.uri("pending", f"append={sweep}"), client_factory, asks="_asks",
                                    by=row_key, n=n, **send_opts)
                    cache.settle(sweep, n=n)
                    sent += n
                waiting -= got
        if waiting:
            time.sleep(POLL_S)
    return sent


def attach_responses(keyed: DataFrame, cache: ResponseCache) -> DataFrame:
    """Rows with ``response``, ``full_response``, ``error``, ``attempts`` joined by key (never by position)."""
    e = cache.entries(keyed).select("request_id", "full_response", "error", "attempts")
    return (keyed.join(e, "request_id", "left")
                 .withColumn("response", response_content("full_response")))


def run_sweep(rows: DataFrame, models: list[str], content: str | Column, cache: ResponseCache,
              client_factory: Callable, *, row_key: str = "row_id", slots: Sequence[str] | None = None,
              temperature: float = TEMPERATURE, include_reasoning: bool = INCLUDE_REASONING,
              **send_opts) -> DataFrame:
    """Every row to every model through the cache.

    ``content`` is the prompt: a column of ``rows`` (left out of the result) or an
    expression over them (over ``slots``, where given), such as a rendered template, which then
    never crosses a shuffle. ``row_key`` names the rows uniquely; nulls and repeats raise before a
    call is made.
    """
    text = F.col(content) if isinstance(content, str) else content
    if isinstance(content, str):
        slots = [content]
    # the digests are written once: dedupe, lookups and the answers read them, not the prompts
    keyed = cut_lineage(request_keys(rows, models, text, row_key, temperature, include_reasoning), "request-keys")
    fill_cache(unique_requests(keyed, row_key), rows, text, cache, client_factory, row_key=row_key, slots=slots,
               temperature=temperature, include_reasoning=include_reasoning, **send_opts)
    answered = attach_responses(keyed, cache)
    return (rows.drop(content) if isinstance(content, str) else rows).join(answered, row_key)


def failed(answered: DataFrame) -> DataFrame:
    return answered.where(F.col("error").isNotNull())
