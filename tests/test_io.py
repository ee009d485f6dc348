"""Sources and sinks: CSV round trip, NA rules, whole-text and line scans, partitioned and JSON sinks."""

import json
import os

from pyspark.sql import functions as F

from glossa.functions.text import basename, has_suffix, slug, stem
from glossa.sources.sinks import with_output_name, write_counted, write_document, write_table
from glossa.sources.tables import read_lines, read_table

EDGE = [
    (1, 'quoted\nnewline', 'a "doubled" quote'),
    (2, 'back\\slash', 'comma, inside'),
    (3, 'NA', 'null'),
    (4, 'None', 'nan'),
    (5, '', 'plain'),
    (6, '  lead', 'trail \t'),
    (7, '\n x \n', '   '),
]


def test_csv_round_trip_and_na_rules(spark, tmp):
    df = spark.createDataFrame(EDGE, "row_id long, src string, tgt string")
    write_table(df, f"{tmp}/out", fmt="csv")
    back = read_table(spark, f"{tmp}/out", fmt="csv", schema="row_id long, src string, tgt string")
    got = {r.row_id: (r.src, r.tgt) for r in back.collect()}
    assert got[1] == ('quoted\nnewline', 'a "doubled" quote')
    assert got[2] == ('back\\slash', 'comma, inside')
    assert got[3] == ('NA', 'null')           # Spark rules: only empty is missing
    assert got[5] == (None, 'plain')
    assert got[6] == ('  lead', 'trail \t') and got[7] == ('\n x \n', '   ')
    pandas_like = read_table(spark, f"{tmp}/out", fmt="csv", na_rules="pandas",
                             schema="row_id long, src string, tgt string")
    got = {r.row_id: (r.src, r.tgt) for r in pandas_like.collect()}
    assert got[3] == (None, None) and got[4] == (None, None) and got[5][0] is None


def test_malformed_cells_are_counted(spark, tmp):
    from glossa.sources.tables import malformed

    with open(f"{tmp}/bad.csv", "w") as f:
        f.write("row_id,src\n1,a\nx,b\n3,c\n")
    df = read_table(spark, f"{tmp}/bad.csv", fmt="csv", schema="row_id long, src string", keep_corrupt=True)
    assert malformed(df) == 1
    assert {r.src: r.row_id for r in df.collect()} == {"a": 1, "b": None, "c": 3}


def test_long_model_lists(spark, tmp):
    from glossa.operators.sweep import expand_models, read_models

    with open(f"{tmp}/many.txt", "w") as f:
        f.writelines(f"org/model-{i}\n" for i in range(1500))
    models = read_models(spark, f"{tmp}/many.txt")
    assert len(models) == 1500 and expand_models(spark.range(2), models).count() == 3000


def test_model_list_lines(spark, tmp):
    path = f"{tmp}/models.txt"
    with open(path, "w") as f:
        f.write("meta-llama/llama-3.3-70b-instruct\n\nopenai/gpt-4o-mini\n")
    from glossa.operators.sweep import read_models
    assert read_models(spark, path) == ["meta-llama/llama-3.3-70b-instruct", "openai/gpt-4o-mini"]
    assert read_lines(spark, path).count() == 2


def test_name_functions(spark):
    df = spark.createDataFrame([("openai/gpt-4o-mini", "data/sets/pairs-set.csv", "outputs/run/")],
                               "m string, p string, d string")
    r = df.select(slug("m").alias("slug"), basename("p").alias("base"), stem("p").alias("stem"),
                  basename("d").alias("dir_base"), has_suffix("p", ".csv").alias("csv"),
                  has_suffix("p", ".ckpt").alias("ckpt")).first()
    assert (r.slug, r.base, r.stem, r.dir_base, r.csv, r.ckpt) == (
        "openai_gpt-4o-mini", "pairs-set.csv", "pairs-set", "run", True, False)


def test_partitioned_sink(spark, tmp):
    df = spark.createDataFrame([(1, "openai/gpt-4o-mini", "x"), (2, "Qwen/Qwen2.5-32B-Instruct", "y")],
                               "row_id long, chat_model string, response string")
    named = with_output_name(df, "chat_model", input_name="pairs-with_answers.csv")
    write_table(named, f"{tmp}/res", partition_by=["output_name"])
    dirs = sorted(os.listdir(f"{tmp}/res"))
    assert "output_name=openai_gpt-4o-mini_pairs-with_answers.csv" in dirs
    back = spark.read.parquet(f"{tmp}/res").where(F.col("output_name").startswith("openai"))
    assert [r.row_id for r in back.collect()] == [1]


def test_json_document_keeps_unicode(spark, tmp):
    summary = spark.createDataFrame([("m", 0.5, 2)], "model string, system_score double, n_segments long")
    segs = spark.createDataFrame([("m", 0, "下雨", "rain", 0.5)],
                                 "model string, segment_id long, source string, translation string, score double")
    write_document(summary, segs, f"{tmp}/doc")
    files = [f for f in os.listdir(f"{tmp}/doc/segments") if f.endswith(".json")]
    text = "".join(open(f"{tmp}/doc/segments/{f}", encoding="utf-8").read() for f in files)
    assert "下雨" in text
    assert json.loads(text.strip().splitlines()[0])["source"] == "下雨"


def test_csv_text_by_default_inference_opt_in(spark, tmp):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 1.5)], "id long, s string, x double")
    write_table(df.coalesce(1), f"{tmp}/typed", fmt="csv")
    plain = read_table(spark, f"{tmp}/typed", fmt="csv")
    assert dict(plain.dtypes) == {"id": "string", "s": "string", "x": "string"}
    inferred = read_table(spark, f"{tmp}/typed", fmt="csv", infer=True)
    assert dict(inferred.dtypes) == {"id": "int", "s": "string", "x": "double"}


def test_counts_come_from_the_write_itself(spark, tmp):
    calls = spark.sparkContext.accumulator(0)

    def model(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, id) as score", "id % 4 as part").mapInPandas(
        model, "id long, score double, part long")
    checks = {"n_null": F.col("score").isNull(), "n_large": F.col("score") > 900}
    got = write_counted(df, f"{tmp}/counted", checks, partition_by=["part"])
    want = {"n": 1000, "n_null": 334, "n_large": sum(i > 900 and i % 3 != 0 for i in range(1000))}
    assert got == want and calls.value == 1000          # the model ran once
    assert spark.read.parquet(f"{tmp}/counted").count() == 1000
    assert write_counted(df.where("false"), f"{tmp}/none", checks) == dict.fromkeys(want, 0)
