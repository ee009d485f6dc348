"""Driver contract, oracle agreement on the smallest data, and incremental streaming scoring."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from glossa.fixed_text import QUESTIONS, TEMPLATE_BASELINE
from glossa.operators.stubs import EchoClient
from glossa.sources.cache import ResponseCache
from glossa.streaming.incremental import read_scored, score_stream

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["model", "system_score", "n_scored", "n"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    from glossa.plans.catalog import QUERIES
    assert len(set(QUERIES) - set(E.oracle_sql())) <= 1


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("key", ["judge_score", "render_variants", "qa_score", "triplet_metrics", "assign_batches",
                                 "score_stub", "question_table", "pad_encode"])
def test_oracle_agrees_sf0001(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    res = con.execute(E.oracle_sql()[key])
    cols = [d[0] for d in res.description]
    want = sorted(tuple(norm(v) for v in r) for r in res.fetchall())
    got_df = E.queries()[key](spark, SF).select(*cols)
    got = sorted(tuple(norm(v) for v in r) for r in got_df.collect())
    assert got == want


def test_streaming_incremental_scoring(spark, tmp):
    src_dir = f"{tmp}/incoming"
    os.makedirs(src_dir)
    schema = "row_id long, src string, tgt string"
    spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], schema).write.parquet(f"{src_dir}/part1")
    kw = dict(schema=schema, template=TEMPLATE_BASELINE,
              slots={"source": F.col("src"), "translation": F.col("tgt"), "questions": QUESTIONS},
              models=["m1", "m2"], cache_path=f"{tmp}/cache", client_factory=EchoClient,
              output_path=f"{tmp}/scored", checkpoint_location=f"{tmp}/ckpt", backoff_s=0.0,
              keep=["row_id"])
    q = score_stream(spark, f"{src_dir}/*", **kw)
    q.awaitTermination(300)
    first = read_scored(spark, f"{tmp}/scored")
    assert first.count() == 4 and first.where(F.col("score").isNull()).count() == 0
    # a new file arrives: only its rows are processed, the old requests stay cached
    spark.createDataFrame([(3, "a", "b"), (4, "e", "f")], schema).write.parquet(f"{src_dir}/part2")
    q = score_stream(spark, f"{src_dir}/*", **kw)
    q.awaitTermination(300)
    out = read_scored(spark, f"{tmp}/scored")
    assert out.count() == 8
    assert ResponseCache(spark, f"{tmp}/cache").raw().count() == 6   # (a,b),(c,d),(e,f) x 2 models, each sent once


def test_stream_goes_on_after_rows_that_their_key_does_not_name(spark, tmp):
    src_dir = f"{tmp}/incoming"
    os.makedirs(src_dir)
    schema = "row_id long, src string, tgt string"
    spark.createDataFrame([(1, "a", "b"), (1, "c", "d"), (None, "e", "f")], schema).write.parquet(f"{src_dir}/part1")
    q = score_stream(spark, f"{src_dir}/*", schema, TEMPLATE_BASELINE,
                     {"source": F.col("src"), "translation": F.col("tgt"), "questions": QUESTIONS}, ["m1"], f"{tmp}/cache",
                     EchoClient, f"{tmp}/scored", f"{tmp}/ckpt", backoff_s=0.0, keep=["row_id", "src"])
    q.awaitTermination(300)
    got = read_scored(spark, f"{tmp}/scored").select("row_id", "src").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a"), (1, "c"), (None, "e")], key=str)


def test_python_workers_get_the_package(tmp):
    """A driver started outside the repo (package only on the driver's sys.path)
    still runs Python-UDF queries: the package is shipped with addPyFile."""
    import subprocess
    import sys as _sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false") \\
    .config("spark.checkpoint.dir", {tmp!r}).getOrCreate()
import __spark_entry__ as E
print("ROWS", E.queries()["segment_scores"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([_sys.executable, "-c", script], cwd=tmp, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ROWS 200" in out.stdout, out.stderr[-2000:]
