"""Persistent response cache: Parquet tables keyed by ``request_id``.

Three folders under the cache's path:

* ``keys``: one narrow row per answer (no payload);
* ``payloads``: the answers' JSON, found by (request_id, entry);
* ``pending``: answers of sweeps that are still running or were cut off, in small files.

``settle`` turns a sweep's pending files into one ``append=<sweep>`` folder of the
other two, range-partitioned and sorted by key with small pages and a Bloom
filter on the key. A lookup of up to ``POINT_KEYS`` keys names them in the filter, so
Parquet's statistics, Bloom filters and page indexes leave a page or so per key to
be read; a larger one joins the narrow table. Payloads are read for the
entries that were picked, and only from the appends these lie in.

Append-only: a sweep writes the answers it got; two sweeps may answer the same key, so reads
pick one entry per key (a successful answer wins over an error, then the earliest). Failed
requests are kept for reporting but do not count as cached, so the next sweep sends them again.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_COLUMNS = ["request_id", "chat_model", "full_response", "error", "attempts", "written_at"]
KEY_COLUMNS = ["request_id", "chat_model", "entry", "error", "attempts", "written_at"]
KEY_SCHEMA = ("request_id string, chat_model string, entry long, error string, attempts int, "
              "written_at timestamp, append string")
PAYLOAD_SCHEMA = "request_id string, entry long, full_response string, append string"
ANSWER_SCHEMA = ("request_id string, chat_model string, entry long, full_response string, error string, "
                 "attempts int, written_at timestamp")

POINT_KEYS = 2000            # keys of a lookup that are named in the filter
FILE_ROWS = 500_000          # answers per settled file
PENDING_GRACE_S = 3600       # settled pending files stay for readers that have listed them
LAYOUT = {"parquet.bloom.filter.enabled#request_id": "true", "parquet.bloom.filter.expected.ndv#request_id": "20000",
          "parquet.page.size": str(32 * 1024), "parquet.page.row.count.limit": "500", "parquet.block.size": str(32 << 20),
          "compression": "zstd"}


class ResponseCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        # In-filters beyond this length are pushed to Parquet as their range only
        name = "spark.sql.parquet.pushdown.inFilterThreshold"
        if int(spark.conf.get(name)) < POINT_KEYS:
            spark.conf.set(name, str(POINT_KEYS))

    # folders -------------------------------------------------------------------------------

    def _fs(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def uri(self, *parts: str) -> str:
        """A place under the cache with its scheme, for readers and writers outside the JVM."""
        fs, path = self._fs(*parts)
        full = fs.makeQualified(path).toString()
        return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full

    def _appends(self, kind: str) -> dict[str, int]:
        """append id -> time of change (ms) of the folders below ``kind``."""
        fs, path = self._fs(kind)
        if not fs.exists(path):
            return {}
        found = {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(path) if s.isDirectory()}
        return {n.split("=", 1)[1]: t for n, t in found.items() if n.startswith("append=")}

    def version(self) -> frozenset[str]:
        """What the cache holds just now: its appends, settled or not."""
        return frozenset(self._appends("pending")) | frozenset(self._appends("keys"))

    # reading -------------------------------------------------------------------------------

    def _read(self, kind: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":      # any other trouble is not an empty cache
                raise
            return self.spark.createDataFrame([], schema)

    def _both(self, kind: str, columns: list[str], schema: str) -> DataFrame:
        """Settled rows and those of sweeps not settled yet (pending is listed first: an
        answer that settles meanwhile is seen in one place at least)."""
        pending = set(self._appends("pending"))
        open_ = sorted(pending - set(self._appends("keys")))
        rows = self._read(kind, schema).select(*columns, "append")
        if open_:
            waiting = self._read("pending", f"{ANSWER_SCHEMA}, append string").where(F.col("append").isin(open_))
            if kind == "payloads":
                waiting = waiting.where("full_response is not null")
            rows = rows.union(waiting.select(*columns, "append"))
        return rows

    def _named(self, wanted: DataFrame) -> list[str] | None:
        """The keys of a small lookup; None where there are more than ``POINT_KEYS``."""
        some = wanted.select("request_id").limit(POINT_KEYS + 1).collect()
        return sorted({r[0] for r in some}) if len(some) <= POINT_KEYS else None

    def _key_rows(self, wanted: DataFrame | None, named: list[str] | None) -> DataFrame:
        rows = self._both("keys", KEY_COLUMNS, KEY_SCHEMA)
        if named is not None:
            return rows.where(F.col("request_id").isin(named))
        return rows if wanted is None else rows.join(wanted.select("request_id"), "request_id", "left_semi")

    def _with_payloads(self, keys: DataFrame, named: list[str] | None) -> DataFrame:
        payloads = self._both("payloads", ["request_id", "entry", "full_response"], PAYLOAD_SCHEMA)
        if named is not None:
            payloads = payloads.where(F.col("request_id").isin(named))
        return keys.join(payloads.drop("append"), ["request_id", "entry"], "left").select(*CACHE_COLUMNS, "entry")

    def raw(self, wanted: DataFrame | None = None) -> DataFrame:
        """All answers, or those of the keys in ``wanted`` (a ``request_id`` column)."""
        named = None if wanted is None else self._named(wanted)
        return self._with_payloads(self._key_rows(wanted, named), named).drop("entry")

    def _best(self, keys: DataFrame) -> DataFrame:
        """One row per key, picked on narrow columns: success first, then the earliest."""
        rank = F.struct(F.col("error").isNotNull().alias("failed"), "written_at", "entry", "chat_model", "error", "attempts")
        return keys.groupBy("request_id").agg(F.min(rank).alias("b")).select(
            "request_id", "b.chat_model", "b.entry", "b.error", "b.attempts", "b.written_at")

    def entries(self, wanted: DataFrame | None = None) -> DataFrame:
        """One row per key: the best entry with its payload."""
        named = None if wanted is None else self._named(wanted)
        return self._with_payloads(self._best(self._key_rows(wanted, named)), named).drop("entry")

    def keys(self, wanted: DataFrame | None = None, since: frozenset[str] | None = None) -> DataFrame:
        """Keys with a successful answer: what counts as cached, of ``wanted`` or more (a larger
        lookup gets all, for the caller's join). ``since`` leaves out the appends of an earlier ``version``."""
        if not self.version():
            return self.spark.createDataFrame([], "request_id string")
        named = None if wanted is None else self._named(wanted)
        rows = self._key_rows(None, named)
        if since:
            rows = rows.where(~F.col("append").isin(sorted(since)))
        return rows.where(F.col("error").isNull()).select("request_id").distinct()

    # writing -------------------------------------------------------------------------------

    def settle(self, sweep: str, rows: DataFrame | None = None, n: int | None = None) -> None:
        """The answers of ``sweep`` (its pending files, or ``rows``; ``n``, if known) as sorted
        tables. Repeating it after a crash replaces what the first try wrote."""
        if rows is None:
            rows = self.spark.read.schema(ANSWER_SCHEMA).parquet(f"{self.path}/pending/append={sweep}")
        files = max(1, -(-(rows.count() if n is None else n) // FILE_ROWS))

        def write(part: DataFrame, kind: str, folder: str) -> None:
            part = part.repartitionByRange(files, "request_id") if files > 1 else part.repartition(1)
            part.sortWithinPartitions("request_id").write.mode("overwrite").options(**LAYOUT).parquet(
                f"{self.path}/{kind}/{folder}")

        # readers take the settled tables as soon as there are keys, so these are moved in last
        keys, staged = self._fs("keys", f"append={sweep}")[1], f"_settling-{sweep}"
        with ThreadPoolExecutor(2) as pool:
            for done in [pool.submit(write, rows.where("full_response is not null").select("request_id", "entry", "full_response"),
                                     "payloads", f"append={sweep}"),
                         pool.submit(write, rows.select(*KEY_COLUMNS), "keys", staged)]:
                done.result()
        fs, path = self._fs("keys", staged)
        fs.delete(keys, True)
        fs.rename(path, keys)
        self._clean_pending()

    def _clean_pending(self) -> None:
        """Pending files that nobody has touched for long: settled ones go, those of a sweep that
        was cut off are settled."""
        settled, now = self._appends("keys"), time.time() * 1000
        for sweep, changed in self._appends("pending").items():
            if now - max(changed, settled.get(sweep, 0)) < PENDING_GRACE_S * 1000:
                continue
            if sweep in settled:
                fs, path = self._fs("pending", f"append={sweep}")
                fs.delete(path, True)
            else:
                self.settle(sweep)

    def append(self, scored: DataFrame) -> str:
        """Add scored requests (``RESULT_SCHEMA``); they are evaluated once. Returns the append's id."""
        sweep = uuid.uuid4().hex[:16]
        entry = F.xxhash64("request_id", F.lit(sweep))
        rows = scored.select("request_id", "chat_model", entry.alias("entry"), "full_response", "error", "attempts",
                             F.current_timestamp().alias("written_at"))
        rows.write.parquet(f"{self.path}/pending/append={sweep}")
        self.settle(sweep)
        return sweep

    def compact(self, out_path: str) -> "ResponseCache":
        """Write one row per key (the entry reads would pick) to a new cache.

        Reads compare the entries of every append; a long-lived cache with many appends is
        compacted now and then, and the caller switches to the returned one.
        """
        out = ResponseCache(self.spark, out_path)
        out.settle("compacted", self._with_payloads(self._best(self._key_rows(None, None)), None))
        return out
