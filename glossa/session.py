"""Session settings and the shared scratch folder.

Jobs never pick a machine-local folder on a cluster: written tables (response
cache, round-trip files, lineage cuts) go under ``spark.checkpoint.dir``, which
the cluster names. Only a local session without that setting (tests, the bench)
gets a private folder under the system temp directory.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans joins and shuffle sizes at runtime,
# splits skewed join partitions, and only broadcasts a side whose measured size
# is under the threshold (a checked broadcast; above it the join stays sort-merge).
SESSION_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches to Python model calls: at most 2048 rows and 64 MB, so batches
    # of long documents stay bounded in worker memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "glossa",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    if "spark.checkpoint.dir" not in conf and master.startswith("local"):
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="glossa-ckpt-")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for written tables (``spark.checkpoint.dir``).

    Read from the session; a local session that lacks it gets one here (and it
    becomes the checkpoint folder too); a cluster session must set it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for written tables")
        path = tempfile.mkdtemp(prefix="glossa-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_root(spark: SparkSession) -> str:
    """The run's folder for written tables: one per application, or per ``glossa.run``
    where the caller names runs within an application."""
    run = spark.conf.get("glossa.run", None) or spark.sparkContext.applicationId
    return os.path.join(shared_dir(spark), f"glossa-{run}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique table location under the run's folder."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def clear_scratch(spark: SparkSession) -> bool:
    """Remove the run's written tables. To be called when its results are stored
    elsewhere: DataFrames that still read a written table fail afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to the rows and bytes of ``SESSION_DEFAULTS``, so that a Python
    worker's memory does not grow with its partition. A session with smaller batches keeps them."""
    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        most = SESSION_DEFAULTS[name]
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= int(most):     # none, or a text with a unit
            spark.conf.set(name, most)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers (once per application).

    Operators that run Python on executors pickle references to functions and
    classes in ``glossa``; workers import them. When the package is not
    installed on the executors, a zip of its sources is added with
    ``addPyFile`` (Spark serves it to every executor, like ``--py-files``).
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = shared_dir(spark)
    folder = base if os.path.isdir(base) else tempfile.mkdtemp(prefix="glossa-py-")
    out = os.path.join(folder, f"glossa-py-{uuid.uuid4().hex[:12]}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)
