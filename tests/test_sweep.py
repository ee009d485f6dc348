"""Model sweep: keys, dedupe, cache hits/misses, retries, error rows, rerun makes no calls."""

import hashlib
import json
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from glossa.functions.keys import request_key
from glossa.operators import sweep as S
from glossa.operators.rows import cut_lineage
from glossa.operators.scoring import answer_requests, in_flight, score_requests
from glossa.operators.stubs import EchoClient, FlakyClient
from glossa.session import scratch_path
from glossa.sources.cache import ResponseCache
from glossa.sources.claims import KeyClaims

MODELS = ["openai/gpt-4o-mini", "Qwen/Qwen2.5-32B-Instruct"]


def rows(spark):
    data = [(i, f"prompt {i % 5}") for i in range(20)] + [(20, "x" * 11)]  # 11 bytes: the stub fails
    return spark.createDataFrame(data, "row_id long, content string")


def test_request_key_is_portable(spark):
    df = spark.createDataFrame([("m/1", "héllo")], "m string, c string")
    got = df.select(request_key(F.col("m"), F.col("c"), 0.3, True).alias("k")).first().k
    assert got == hashlib.sha256("m/1\x01héllo\x010.3\x01true".encode()).hexdigest()


def test_expand_and_dedupe(spark):
    k = S.with_request_key(S.expand_models(rows(spark), MODELS), "content")
    assert k.count() == 42
    assert S.distinct_requests(k, "content").count() == 2 * 6
    counts = {r.n_rows for r in S.request_counts(k).collect()}
    assert counts == {4, 1}


def test_cache_second_run_makes_no_calls(spark):
    cache = ResponseCache(spark, scratch_path(spark, "cache-test"))
    first = S.run_sweep(rows(spark), MODELS, "content", cache, EchoClient, backoff_s=0.0)
    a = sorted((r.row_id, r.chat_model, r.response, r.error) for r in first.collect())
    calls_first = cache.raw().count()
    assert calls_first == 12                      # one call per distinct request
    second = S.run_sweep(rows(spark), MODELS, "content", cache, EchoClient, backoff_s=0.0)
    b = sorted((r.row_id, r.chat_model, r.response, r.error) for r in second.collect())
    assert a == b
    # only the two failed requests are retried on the rerun
    assert cache.raw().count() == calls_first + 2
    failed = S.failed(second).collect()
    assert {r.row_id for r in failed} == {20}
    assert all(r.attempts == 5 and r.error.startswith("RuntimeError") for r in failed)
    report = {r.chat_model: (r.n_keys, r.hits, r.misses) for r in S.cache_report(
        S.with_request_key(S.expand_models(rows(spark), MODELS), "content"), cache.keys()).collect()}
    assert report == {m: (6, 5, 1) for m in MODELS}


def test_retries_then_success(spark):
    req = spark.createDataFrame([("k1", "m", "hello")], "request_id string, chat_model string, content string")
    out = score_requests(req, lambda: FlakyClient(2), backoff_s=0.0, attempts=5).first()
    assert out.error is None and out.attempts == 3
    assert json.loads(out.full_response)["choices"][0]["message"]["content"].startswith("Feedback: stub")
    out = score_requests(req, lambda: FlakyClient(9), backoff_s=0.0, attempts=5).first()
    assert out.full_response is None and out.attempts == 5 and "TimeoutError" in out.error


def test_split_cache(spark):
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    keys = spark.createDataFrame([("b",), ("z",)], "request_id string")
    hits, misses = S.split_cache(req, keys)
    assert [r.request_id for r in hits.collect()] == ["b"]
    assert sorted(r.request_id for r in misses.collect()) == ["a", "c"]


def test_cache_compaction(spark):
    cache = ResponseCache(spark, scratch_path(spark, "cache-compact"))
    S.run_sweep(rows(spark), MODELS, "content", cache, EchoClient, backoff_s=0.0)
    S.run_sweep(rows(spark), MODELS, "content", cache, EchoClient, backoff_s=0.0)
    assert cache.raw().count() == 14
    small = cache.compact(scratch_path(spark, "cache-compacted"))
    assert small.raw().count() == 12
    assert sorted(map(tuple, small.entries().select("request_id", "error").collect())) == \
        sorted(map(tuple, cache.entries().select("request_id", "error").collect()))


def test_rerun_with_everything_cached(spark):
    data = spark.createDataFrame([(1, "abc"), (2, "abcd")], "row_id long, content string")
    cache = ResponseCache(spark, scratch_path(spark, "cache-full"))
    S.run_sweep(data, MODELS, "content", cache, EchoClient, backoff_s=0.0)
    n = cache.raw().count()
    again = S.run_sweep(data, MODELS, "content", cache, EchoClient, backoff_s=0.0)
    assert again.count() == 4 and cache.raw().count() == n


cloudpickle.register_pickle_by_value(sys.modules[__name__])     # workers cannot import this file


class CountingClient(EchoClient):
    """Notes every call, and how many calls run at the same time, in a shared folder."""

    def __init__(self, folder, fail_once_at=None, pause=0.005):
        self.folder, self.fail_once_at, self.pause = folder, fail_once_at, pause

    def __call__(self, request, timeout=None):
        import os
        import uuid

        name = uuid.uuid4().hex
        mine = f"{self.folder}/now/{name}"
        open(mine, "w").close()
        n = len(os.listdir(f"{self.folder}/now"))
        open(f"{self.folder}/calls/{n}-{name}", "w").close()
        time.sleep(self.pause)
        os.remove(mine)
        calls = len(os.listdir(f"{self.folder}/calls"))
        if self.fail_once_at and calls >= self.fail_once_at and not os.path.exists(f"{self.folder}/failed"):
            open(f"{self.folder}/failed", "w").close()
            os._exit(1)                       # the worker dies: the task and its wave are lost
        return super().__call__(request, timeout)


def counted(tmp):
    import os

    for d in ("now", "calls"):
        os.makedirs(f"{tmp}/{d}")
    return lambda: [int(f.split("-")[0]) for f in os.listdir(f"{tmp}/calls")]


@pytest.mark.parametrize("concurrency", [5, 30])
def test_exactly_so_many_requests_are_in_flight(spark, tmp, concurrency):
    calls = counted(tmp)
    data = spark.createDataFrame([(i, f"text number {i}") for i in range(300)], "row_id long, content string")
    cache = ResponseCache(spark, scratch_path(spark, "cache-limit"))
    out = S.run_sweep(data, ["m"], "content", cache, lambda: CountingClient(tmp, pause=0.05), backoff_s=0.0,
                      concurrency=concurrency, attempts=1)
    assert out.count() == 300 and len(calls()) == 300 and max(calls()) == concurrency


def test_in_flight_shares_add_up():
    for concurrency in range(1, 70):
        for slots in (1, 3, 8, 200):
            share = in_flight(concurrency, 8, slots)
            assert sum(share) == concurrency and min(share) > 0 and len(share) <= slots


def test_a_killed_task_sends_at_most_its_chunk_again(spark, tmp):
    """The worker dies once: Spark tries its task again (a local master does so only with
    ``local[N, attempts]``, so here the sweep itself is run again)."""
    calls = counted(tmp)
    data = spark.createDataFrame([(i, f"text number {i}") for i in range(400)], "row_id long, content string")
    cache = ResponseCache(spark, scratch_path(spark, "cache-lost"))
    run = lambda: S.run_sweep(data, ["m"], "content", cache, lambda: CountingClient(tmp, 300), backoff_s=0.0,
                              concurrency=4, threads=2, chunk=10, attempts=1)
    with pytest.raises(Exception):
        run()
    before = cache.raw().count()
    assert 200 < before < 400                   # stored before the end, readable before they are settled
    assert run().where("response is not null or error is not null").count() == 400
    # two tasks with a chunk of 10 and 2 calls in flight each
    assert 400 < len(calls()) <= 400 + 2 * (10 + 2)
    assert cache.raw().count() == 400


def test_a_retried_task_skips_what_it_has_stored(spark, tmp):
    calls = counted(tmp)
    cache = ResponseCache(spark, scratch_path(spark, "cache-retry"))
    folder = cache.uri("pending", "append=x")
    req = spark.createDataFrame([(f"k{i}", "m", f"t{i}") for i in range(50)], "request_id string, chat_model string, t string")
    for _ in range(2):          # the second run stands for a second attempt of every task
        answer_requests(req, F.col("t"), folder, lambda: CountingClient(tmp), chunk=7, backoff_s=0.0, concurrency=3)
    assert len(calls()) == 50 and cache.raw().count() == 50


def test_two_sweeps_at_once_send_each_request_once(spark, tmp, monkeypatch):
    monkeypatch.setattr(S, "POLL_S", 0.2)
    calls = counted(tmp)
    path = scratch_path(spark, "cache-two")
    data = spark.createDataFrame([(i, f"text number {i}") for i in range(200)], "row_id long, content string")
    done = []

    def sweep():
        out = S.run_sweep(data, ["m"], "content", ResponseCache(spark, path), lambda: CountingClient(tmp), backoff_s=0.0,
                          concurrency=4, attempts=1)
        done.append(out.where("response is not null or error is not null").count())

    both = [threading.Thread(target=sweep) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert done == [200, 200]
    ok = ResponseCache(spark, path).keys().count()
    failing = 200 - ok                          # failed requests may be sent by both
    assert 200 <= len(calls()) <= 200 + failing


def test_claims_of_a_dead_owner_are_taken_over(spark, tmp):
    first, second = (KeyClaims(spark, f"{tmp}/claims", ttl_s=1.0) for _ in range(2))
    for name in range(3):
        assert first._create(f"range-{name:05d}")          # as by an owner that died: nobody touches them
    assert second.take([0, 1]) == set()
    time.sleep(1.5)
    assert second.take([0, 1]) == {0, 1}
    time.sleep(1.5)                                        # a live owner keeps its claims
    assert first.take([0, 1]) == set() and first.take([2]) == {2}
    first.release()
    second.release()
    assert first.take([0, 1, 2]) == {0, 1, 2}
    first.release()


class HangingClient(EchoClient):
    def __call__(self, request, timeout=None):
        if "hang" in request["messages"][0]["content"]:
            time.sleep(60)
        return super().__call__(request, timeout)


def test_a_client_that_ignores_the_timeout_ends_as_an_error(spark):
    data = spark.createDataFrame([(i, "hang" if i == 3 else f"text number {i}") for i in range(8)], "row_id long, content string")
    cache = ResponseCache(spark, scratch_path(spark, "cache-hang"))
    began = time.time()
    out = S.run_sweep(data, ["m"], "content", cache, HangingClient, backoff_s=0.0, timeout_s=1.0, attempts=2, concurrency=4)
    got = {r.row_id: r for r in out.collect()}
    assert time.time() - began < 40
    assert got[3].error.startswith("TimeoutError") and got[3].attempts == 2
    assert all(got[i].error is None for i in (0, 1, 2, 4, 5, 6, 7) if len(f"text number {i}") % 11)


def test_a_sweep_reads_the_texts_twice_whatever_its_size(spark, tmp):
    """Once for the digests, once for the calls."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slot(i):
        read.add(1)
        return f"text number {i}"

    data = spark.range(200).select(F.col("id").alias("row_id"), slot("id").alias("src"))
    cache = ResponseCache(spark, scratch_path(spark, "cache-scans"))
    keyed = S.request_keys(data, MODELS, F.concat(F.lit("prompt "), "src"))
    keyed = cut_lineage(keyed, "keys")
    assert read.value == 200
    assert S.fill_cache(S.unique_requests(keyed), data, F.concat(F.lit("prompt "), "src"), cache, EchoClient, slots=["src"],
                        concurrency=2, chunk=5, backoff_s=0.0, attempts=1) == 400
    assert read.value == 400


def test_a_text_is_shuffled_once_for_all_models_and_tasks_grow_with_requests(spark, monkeypatch):
    import glossa.operators.scoring as scoring
    monkeypatch.setattr(scoring, "TASK_REQUESTS", 50)
    dealt = []
    deal = type(spark.range(1)).repartition

    def seen(self, *args):
        dealt.append((args[0], self.count()))
        return deal(self, *args)

    monkeypatch.setattr(type(spark.range(1)), "repartition", seen)
    data = spark.createDataFrame([(i, f"text number {i % 290}") for i in range(300)], "row_id long, src string")
    cache = ResponseCache(spark, scratch_path(spark, "cache-once"))
    out = S.run_sweep(data, MODELS, F.concat(F.lit("prompt "), "src"), cache, EchoClient, backoff_s=0.0, attempts=1)
    assert len(MODELS) == 2 and (12, 290) in dealt          # 580 requests of 290 texts, 50 a task
    assert out.where("response is not null or error is not null").count() == 600
    assert cache.raw().count() == 580


def test_a_point_lookup_reads_a_small_part_of_the_cache(spark):
    cache = ResponseCache(spark, scratch_path(spark, "cache-big"))
    rows = spark.range(300_000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("request_id"), F.lit("m").alias("chat_model"),
        F.concat_ws(" ", F.sha2(F.concat(F.col("id"), F.lit("a")), 512), F.sha2(F.concat(F.col("id"), F.lit("b")), 512)).alias("full_response"),
        F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempts"))
    cache.append(rows)
    few = spark.range(100).select(F.sha2((F.col("id") * 2999).cast("string"), 256).alias("request_id"))
    few = cut_lineage(few, "few")

    def read_bytes():
        stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
        return sum(s.getBytesRead() for s in stats)

    fs, path = cache._fs("")
    size = fs.getContentSummary(path).getLength() - fs.getContentSummary(cache._fs("pending")[1]).getLength()
    before = read_bytes()
    got = cache.entries(few).collect()
    part = (read_bytes() - before) / size
    assert len(got) == 100 and all(r.full_response for r in got)
    assert part < 0.15, part         # pages of 500 answers; the share falls with the cache's size
    assert cache.keys(few).count() == 100
    many = cut_lineage(spark.range(5000).select(F.sha2((F.col("id") * 100).cast("string"), 256).alias("request_id")), "many")
    assert S.split_cache(many, cache.keys(many))[0].count() == 3000 and cache.entries(many).count() == 3000


def test_no_text_crosses_a_shuffle_before_the_call(spark):
    data = spark.createDataFrame([(1, "a", "b")], "row_id long, src string, tgt string")
    keyed = S.request_keys(data, MODELS, F.concat(F.lit("long prompt "), "src", "tgt"))
    plan = S.unique_requests(keyed)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Exchange")[0]
    assert "Exchange" in plan and "src" not in above and "tgt" not in above and "long prompt" not in above


def test_only_a_missing_path_is_an_empty_cache(spark, tmp):
    assert ResponseCache(spark, f"{tmp}/none").raw().count() == 0
    with pytest.raises(Exception):
        ResponseCache(spark, "no-such-scheme://x/y").raw().count()


def test_retry_if_stops_on_permanent_errors(spark):
    req = spark.createDataFrame([("k1", "m", "hello")], "request_id string, chat_model string, content string")
    out = score_requests(req, lambda: FlakyClient(9), backoff_s=0.0, attempts=5,
                         retry_if=lambda e: not isinstance(e, TimeoutError)).first()
    assert out.attempts == 1 and "TimeoutError" in out.error


def test_null_and_repeated_row_keys_raise_before_a_call(spark, tmp):
    calls = counted(tmp)
    cache = ResponseCache(spark, scratch_path(spark, "cache-keys"))
    for ids in ([1, 1, 2], [1, None, 2]):
        data = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "row_id long, content string")
        with pytest.raises(ValueError, match="row_id does not name the rows"):
            S.run_sweep(data, ["m"], "content", cache, lambda: CountingClient(tmp), backoff_s=0.0)
    assert not calls() and cache.raw().count() == 0
