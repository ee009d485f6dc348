"""Model calls inside Arrow batches.

Only these operators run Python on executors. Each takes a *factory* (a
picklable zero-argument callable) that builds the client / model once per task,
so connections and weights are not shipped per row. Failures are captured per
row (``error`` column, ``attempts`` count); one bad request never fails the job.

Concurrency: requests in flight = the calls that the running tasks may make at a time.
``concurrency`` fixes their sum (``in_flight``). A call that its client does not end within the
timeout counts as failed when the time is up, and its place is free again.
"""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql import functions as F

from glossa.fixed_text import (INCLUDE_REASONING, JUDGE_MAX_TOKENS, JUDGE_TOP_P, RETRY_ATTEMPTS,
                               TEMPERATURE, TIMEOUT_S)
from glossa.session import bound_batches, ship_package

RESULT_SCHEMA = "request_id string, chat_model string, full_response string, error string, attempts int"
CONTENT_PATH = "$.choices[0].message.content"


@dataclass(frozen=True)
class Calls:
    """How a request is sent: the fixed parts of the request, retries and deadline."""

    temperature: float = TEMPERATURE
    include_reasoning: bool = INCLUDE_REASONING
    timeout_s: float = TIMEOUT_S
    attempts: int = RETRY_ATTEMPTS
    backoff_s: float = 1.0
    retry_if: Callable | None = None       # decides whether a failure is worth another attempt (default: all are)

    def request(self, model: str, content: str) -> dict:
        return {"model": model, "messages": [{"role": "user", "content": content}],
                "temperature": self.temperature, "include_reasoning": self.include_reasoning}


class _Worker:
    """A thread's state: when the attempt it is on began, and whether it was left behind."""

    __slots__ = ("began", "item", "gone")

    def __init__(self):
        self.began, self.item, self.gone = None, None, False


def call_all(requests: Iterable[tuple], client, places: int, how: Calls) -> Iterator[tuple]:
    """(key, full response, error, attempts) for every (key, model, content), in the order in which the answers
    come, with ``places`` calls at a time: as soon as one ends, the next goes out.

    The client is told the timeout. An attempt that has not ended by then is a failed one: its thread is
    left behind, another takes its place, and an answer that comes later is not used.
    """
    inbox, outbox, lock = queue.SimpleQueue(), queue.SimpleQueue(), threading.Lock()
    workers: set[_Worker] = set()

    def work(me: _Worker) -> None:
        while (item := inbox.get()) is not None:
            _, request, attempt = item
            if attempt > 1 and how.backoff_s > 0:
                time.sleep(how.backoff_s * 2 ** (attempt - 2))
            me.item, me.began = item, time.monotonic()
            try:
                answer, error = client(request, timeout=how.timeout_s), None
            except BaseException as e:  # noqa: BLE001 - every failure becomes a row value
                answer, error = None, e
            with lock:
                me.began = None
                if me.gone:
                    return
            outbox.put((item, answer, error))

    def hire() -> None:
        me = _Worker()
        workers.add(me)
        threading.Thread(target=work, args=(me,), daemon=True).start()

    def overdue() -> list[tuple]:
        late = []
        with lock:
            for w in [w for w in workers if w.began is not None and time.monotonic() - w.began > how.timeout_s]:
                w.gone = True
                workers.discard(w)
                late.append((w.item, None, TimeoutError(f"no answer within {how.timeout_s:g} s")))
        for _ in late:
            hire()
        return late

    source, open_, more = iter(requests), 0, True
    tick = min(1.0, how.timeout_s / 4)
    look = time.monotonic() + tick
    while True:
        while more and open_ < places:
            try:
                key, model, content = next(source)
            except StopIteration:
                more = False
                break
            if len(workers) < places:
                hire()
            inbox.put((key, how.request(model, content), 1))
            open_ += 1
        if not open_:
            break
        try:
            ended = [outbox.get(timeout=tick)]
        except queue.Empty:
            ended = []
        if time.monotonic() >= look:
            ended += overdue()
            look = time.monotonic() + tick
        for (key, request, attempt), answer, error in ended:
            if error is None:
                open_ -= 1
                yield key, answer, None, attempt
            elif attempt < how.attempts and (how.retry_if is None or how.retry_if(error)):
                inbox.put((key, request, attempt + 1))
            else:
                open_ -= 1
                yield key, None, f"{type(error).__name__}: {error}", attempt
    for _ in workers:
        inbox.put(None)


def in_flight(concurrency: int | None, threads: int, slots: int) -> list[int]:
    """Calls at a time for each of the tasks; with ``concurrency`` they add up to it exactly."""
    if not concurrency:
        return [threads] * slots
    tasks = min(-(-concurrency // max(1, threads)), slots)
    return [concurrency // tasks + (i < concurrency % tasks) for i in range(tasks)]


def score_requests(requests: DataFrame, client_factory: Callable, model_col: str = "chat_model",
                   content_col: str = "content", threads: int = 8, partitions: int | None = None,
                   concurrency: int | None = None, **calls) -> DataFrame:
    """Send one chat request per row; returns ``RESULT_SCHEMA`` rows (raw JSON kept).

    ``concurrency`` caps the requests in flight across the cluster; ``calls`` are the
    fields of ``Calls``. An operator for one table of requests: a sweep over many uses
    ``answer_requests``, which stores answers as they come.
    """
    how = Calls(**calls)
    share = in_flight(concurrency, threads, requests.sparkSession.sparkContext.defaultParallelism) if concurrency else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        places = share[TaskContext.get().partitionId()] if share else threads
        for pdf in batches:
            got = {k: r for k, *r in call_all(zip(range(len(pdf)), pdf[model_col], pdf[content_col]), client, places, how)}
            res = [got[k] for k in range(len(pdf))]
            if res:
                yield pd.DataFrame({"request_id": pdf["request_id"].values, "chat_model": pdf[model_col].values,
                                    "full_response": [r[0] for r in res], "error": [r[1] for r in res],
                                    "attempts": pd.array([r[2] for r in res], dtype="int32")})

    ship_package(requests.sparkSession)
    x = requests.select("request_id", model_col, content_col)
    if share or partitions:
        x = x.repartition(len(share) if share else partitions, "request_id")
    return x.mapInPandas(run, RESULT_SCHEMA)


CHUNK = 500          # answers per stored file: what a killed task sends again, at most
CHUNK_S = 30.0       # or the answers of so many seconds
TASK_REQUESTS = 20_000   # requests of a task, where only the slots bound the calls in flight


def _answer_sink(folder: str, client_factory: Callable, share: list[int], how: Calls, chunk: int, chunk_s: float) -> type[DataSource]:
    """A data source whose tasks send the rows they get (request_id, chat_model, content) and
    store the answers chunk by chunk as Parquet files below ``folder`` (a URI)."""

    class AnswerWriter(DataSourceArrowWriter):
        def write(self, iterator):
            import pyarrow as pa
            import pyarrow.parquet as pq
            from pyarrow import fs as pafs

            schema = pa.schema([("request_id", pa.string()), ("chat_model", pa.string()), ("entry", pa.int64()),
                                ("full_response", pa.string()), ("error", pa.string()), ("attempts", pa.int32()),
                                ("written_at", pa.timestamp("us", tz="UTC"))])
            part = TaskContext.get().partitionId()
            fs, base = pafs.FileSystem.from_uri(folder)
            fs.create_dir(base, recursive=True)
            # an earlier attempt of this task has stored these; a task's rows are always the same
            stored = [f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.startswith(f"p{part:05d}-")]
            known = {k for f in stored for k in pq.read_table(f, columns=["request_id"], filesystem=fs)["request_id"].to_pylist()}

            def requests():
                for b in iterator:
                    for key, model, content in zip(*(b.column(c).to_pylist() for c in ("request_id", "chat_model", "content"))):
                        if key not in known:
                            yield (key, model), model, content

            buffer: list[tuple] = []
            since = time.monotonic()

            def store() -> None:
                nonlocal since
                if buffer:
                    name = f"p{part:05d}-{uuid.uuid4().hex}.parquet"
                    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buffer), schema)], schema=schema)
                    pq.write_table(table, f"{base}/_{name}", filesystem=fs, compression="zstd")
                    fs.move(f"{base}/_{name}", f"{base}/{name}")      # complete, or not seen
                    buffer.clear()
                since = time.monotonic()

            for (key, model), *answer in call_all(requests(), client_factory(), share[part % len(share)], how):
                buffer.append((key, model, uuid.uuid4().int >> 65, *answer, time.time_ns() // 1000))
                if len(buffer) >= chunk or time.monotonic() - since > chunk_s:
                    store()
            store()
            return WriterCommitMessage()

    class AnswerSink(DataSource):
        @classmethod
        def name(cls) -> str:
            return sink

        def writer(self, schema, overwrite):
            return AnswerWriter()

    sink = f"answers_{uuid.uuid4().hex[:12]}"
    return AnswerSink


def answer_requests(requests: DataFrame, content: Column, folder: str, client_factory: Callable, *, threads: int = 8,
                    concurrency: int | None = None, chunk: int = CHUNK, chunk_s: float = CHUNK_S,
                    asks: str | None = None, by: str = "request_id", n: int = 0, **calls) -> None:
    """Send every request and store the answers below ``folder`` (a URI that tasks can write to).

    ``requests`` has request_id, chat_model and what ``content`` renders the prompt from;
    that crosses the one shuffle, the prompt does not. With ``asks`` a row holds an array of
    (request_id, chat_model) in that column, and its slots cross the shuffle once for all of them;
    ``by`` then names the column that deals the rows. As many tasks as ``in_flight`` says run to
    the end, each with its share of the requests by key and its share of ``concurrency``; no call
    waits for another task or for a slower call. Without a ``concurrency`` the slots alone bound the calls
    in flight, and ``n`` requests make a task for every ``TASK_REQUESTS``, if these are more. A killed task finds
    its stored answers again and sends ``chunk`` requests again at most, besides those in flight.
    """
    spark = requests.sparkSession
    ship_package(spark)
    share = in_flight(concurrency, threads, spark.sparkContext.defaultParallelism)
    sink = _answer_sink(folder, client_factory, share, Calls(**calls), chunk, chunk_s)
    spark.dataSource.register(sink)
    tasks = len(share) if concurrency else max(len(share), -(-n // TASK_REQUESTS))
    dealt = requests.repartition(tasks, by)
    if asks:
        dealt = dealt.select("*", F.inline(asks))
    dealt.select("request_id", "chat_model", content.alias("content")).write.format(sink.name()).mode("append").save()


def response_content(full_response: Column | str, path: str = CONTENT_PATH) -> Column:
    """The answer text inside a raw chat-completion JSON (JVM-side JSON path)."""
    c = F.col(full_response) if isinstance(full_response, str) else full_response
    return F.get_json_object(c, path)


JUDGE_SAMPLING = {"temperature": TEMPERATURE, "top_p": JUDGE_TOP_P, "max_tokens": JUDGE_MAX_TOKENS}


def generate_judgements(df: DataFrame, prompt_col: str, generator_factory: Callable,
                        sampling: dict = JUDGE_SAMPLING, out: str = "llm_response",
                        batch_size: int = 64) -> DataFrame:
    """Rubric-judge generation: the model is built once per task and fed Arrow batches."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)

    @F.pandas_udf("string")
    def gen(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        g = generator_factory()
        for s in it:
            texts = s.tolist()
            outs: list = []
            for i in range(0, len(texts), batch_size):
                outs.extend(g.generate(texts[i:i + batch_size], sampling))
            yield pd.Series(outs, dtype="object")

    return df.withColumn(out, gen(F.col(prompt_col)))


SPAN_SCHEMA = "array<struct<text:string,start:int,end:int,severity:string>>"


def score_segments(df: DataFrame, src_col: str, mt_col: str, scorer_factory: Callable,
                   ref_col: str | None = None, batch_size: int = 8) -> DataFrame:
    """Reference-free (or reference-based) segment scoring.

    Adds ``score double`` and ``error_spans`` (kept only when non-empty).
    """
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)

    def _pred(scorer, src, mt, ref):
        samples = [{"src": s, "mt": m} if ref is None else {"src": s, "mt": m, "ref": r}
                   for s, m, r in zip(src, mt, ref if ref is not None else [None] * len(src))]
        scores, spans = [], []
        for i in range(0, len(samples), batch_size):
            sc, sp = scorer.predict(samples[i:i + batch_size])
            scores.extend(sc)
            spans.extend(sp)
        return pd.DataFrame({"score": pd.array(scores, dtype="float64"),
                             "spans": [list(x) if x else None for x in spans]})

    if ref_col is None:
        @F.pandas_udf(f"score double, spans {SPAN_SCHEMA}")
        def seg(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            scorer = scorer_factory()
            for src, mt in it:
                yield _pred(scorer, src.tolist(), mt.tolist(), None)
        s = seg(F.col(src_col), F.col(mt_col))
    else:
        @F.pandas_udf(f"score double, spans {SPAN_SCHEMA}")
        def seg(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            scorer = scorer_factory()
            for src, mt, ref in it:
                yield _pred(scorer, src.tolist(), mt.tolist(), ref.tolist())
        s = seg(F.col(src_col), F.col(mt_col), F.col(ref_col))

    return (df.withColumn("_seg", s)
              .withColumn("score", F.col("_seg.score"))
              .withColumn("error_spans", F.col("_seg.spans"))
              .drop("_seg"))


def encode_texts(df: DataFrame, text_col: str, encoder_factory: Callable, out: str = "vec",
                 batch_size: int = 64) -> DataFrame:
    """Text to a dense float vector (sentence embedding), batched per task."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def enc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder_factory()
        for s in it:
            texts = s.tolist()
            vecs: list = []
            for i in range(0, len(texts), batch_size):
                vecs.extend(list(e.encode(texts[i:i + batch_size])))
            yield pd.Series(vecs, dtype="object")

    return df.withColumn(out, enc(F.col(text_col)))
