"""Claims on key ranges, so that concurrent sweeps never send the same request.

A claim is a file that is created only if it does not exist, in a shared
folder. Its owner touches it while it works and removes it at the end; one that
has not been touched for ``ttl_s`` belongs to a dead owner and may be taken over.

Creation is atomic on local and HDFS folders. On an object store it is as atomic as the
store's conditional put; where there is none, two sweeps may both get a range, and what
they both ask is sent twice (answers stay right: reads pick one entry per key).
"""

from __future__ import annotations

import os
import threading
import time
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

RANGES = 64
TTL_S = 600.0


class KeyClaims:
    def __init__(self, spark: SparkSession, folder: str, ttl_s: float = TTL_S):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.folder, self.ttl_s = folder, ttl_s
        self.held: set[int] = set()
        self._lock, self._stop = threading.Lock(), threading.Event()
        self._thread: threading.Thread | None = None

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self._conf), path

    def _create(self, name: str) -> bool:
        fs, path = self._path(name)
        if fs.getScheme() == "file":
            local = path.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return True
            except FileExistsError:
                return False
        try:
            fs.create(path, False).close()
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def _drop_stale(self, name: str) -> None:
        fs, path = self._path(name)
        try:
            age = time.time() - fs.getFileStatus(path).getModificationTime() / 1000
        except Py4JJavaError:          # released meanwhile
            return
        if age > self.ttl_s:
            # renamed first: of several takers one succeeds, and nobody removes a new claim
            gone = self._path(f"_stale-{name}-{uuid.uuid4().hex}")[1]
            if fs.rename(path, gone):
                fs.delete(gone, False)

    def take(self, ranges: Iterable[int]) -> set[int]:
        """Those of ``ranges`` that nobody else holds; they are ours until ``release``."""
        got = set()
        for r in sorted(set(ranges) - self.held):
            name = f"range-{r:05d}"
            if self._create(name):
                got.add(r)
                continue
            self._drop_stale(name)
            if self._create(name):
                got.add(r)
        with self._lock:
            self.held |= got
        if self.held and self._thread is None:
            self._thread = threading.Thread(target=self._keep, daemon=True)
            self._thread.start()
        return got

    def _keep(self) -> None:
        while not self._stop.wait(self.ttl_s / 4):
            with self._lock:
                for r in self.held:
                    fs, path = self._path(f"range-{r:05d}")
                    fs.setTimes(path, int(time.time() * 1000), -1)

    def release(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
            self._thread = None
        self._stop.clear()
        with self._lock:
            for r in self.held:
                fs, path = self._path(f"range-{r:05d}")
                fs.delete(path, False)
            self.held.clear()

    def __enter__(self) -> "KeyClaims":
        return self

    def __exit__(self, *_) -> None:
        self.release()
